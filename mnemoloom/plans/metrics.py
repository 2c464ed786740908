"""Queries for answer and ranking metrics: answers are documents, hits from vectors and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions.columns import r6
from mnemoloom.operators import metrics as M
from mnemoloom.plans.registry import query
from mnemoloom.session import table

WS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and'))"
# Whole texts of all documents as predictions. Gold: by doc_id, the same text, the text without its first ten words, or that of the next document.
ANSWERS = f"w AS (SELECT doc_id, {WS} AS ws FROM documents), a AS (SELECT x.doc_id, x.ws AS p, CASE x.doc_id % 4 WHEN 0 THEN x.ws WHEN 2 THEN x.ws[11:] ELSE coalesce(y.ws, []) END AS g FROM w x LEFT JOIN w y ON y.doc_id = x.doc_id + 1)"


def shared(p: str = "p", g: str = "g", source: str = "a", k: str = "k") -> str:
    """CTEs ending in ``k`` (doc_id, k): the size of the intersection of two lists as multisets."""
    return f"""{k}_t AS (SELECT doc_id, 0 AS side, unnest({p}) AS t FROM {source} UNION ALL SELECT doc_id, 1, unnest({g}) FROM {source}), {k}_c AS (SELECT doc_id, t, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM {k}_t GROUP BY 1, 2),
    {k} AS (SELECT doc_id, sum(least(x, y))::BIGINT AS {k} FROM {k}_c GROUP BY 1)"""


def grams(name: str, n: int) -> str:
    return f"list_transform(range(1, len({name}) - {n - 2}), lambda i: array_to_string({name}[i:i + {n - 1}], ' '))"


def answers(spark, d):
    """Only documents whose gold is the next one's text meet it, as texts; the others' gold is made in their row."""
    words = lambda text: F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", ""), "\\s+"), lambda x: ~x.isin("", "a", "an", "the", "and"))
    rows, kind = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id") % 4
    own = F.coalesce(kind.isin(0, 2), F.lit(False))
    tail = F.slice("p", F.lit(11), F.greatest(F.size("p") - 10, F.lit(0)))
    alone = rows.where(own).select("doc_id", words("text").alias("p")).select("doc_id", "p", F.when(kind == 0, F.col("p")).otherwise(tail).alias("g"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")).where(~own)
    met = rows.where(~own).join(after, "doc_id", "left").select("doc_id", words("text").alias("p"), F.coalesce(words("next"), F.array().cast("array<string>")).alias("g"))
    return alone.unionByName(met).withColumns({"pred": F.array_join("p", " "), "gold": F.array_join("g", " ")})


@query(f"WITH {ANSWERS}, {shared()} SELECT doc_id, round(CASE WHEN k > 0 THEN 2.0 * k / (len(p) + len(g)) ELSE 0 END, 6)::DOUBLE AS f1 FROM a LEFT JOIN k USING (doc_id)")
def m1_token_f1(spark, d):
    return M.token_f1(answers(spark, d), "pred", "gold", stem=False).select("doc_id", r6("f1").alias("f1"))


@query()
def m1_token_f1_stemmed(spark, d):
    return M.token_f1(answers(spark, d), "pred", "gold").select("doc_id", r6("f1").alias("f1"))


@query(f"WITH {ANSWERS} SELECT doc_id, p = g AS exact, len(g) > 0 AND contains(array_to_string(p, ' '), array_to_string(g[1:5], ' ')) AS has_gold FROM a")
def m2_exact_match(spark, d):
    a = answers(spark, d).withColumn("part", F.array_join(F.slice("g", 1, 5), " "))
    return a.select("doc_id", M.exact_match("pred", "gold").alias("exact"), M.contains_gold("pred", "part").alias("has_gold"))


@query(f"WITH {ANSWERS}, x AS (SELECT doc_id, ' ' || array_to_string(p, ' ') || ' ' AS p, ' ' || array_to_string(g[greatest(1, len(g) - doc_id % 25):], ' ') || ' ' AS q FROM a) SELECT doc_id, trim(p) <> '' AND trim(q) <> '' AND (contains(p, q) OR contains(q, p)) AS span FROM x")
def m3_span_match(spark, d):
    n = (F.col("doc_id") % 25).cast("int")
    a = answers(spark, d).withColumn("part", F.array_join(F.slice("g", F.greatest(F.lit(1), F.size("g") - n), n + 1), " "))
    return a.select("doc_id", M.span_match("pred", "part").alias("span"))


@query(f"WITH {ANSWERS}, {shared()}, x AS (SELECT doc_id, k, len(p) AS n, len(g) AS m FROM a LEFT JOIN k USING (doc_id)) SELECT doc_id, round(CASE WHEN coalesce(k, 0) = 0 THEN 0 ELSE CASE WHEN n > m THEN 1 ELSE exp(1 - m / n) END * k / n END, 6)::DOUBLE AS bleu1 FROM x")
def m4_bleu1(spark, d):
    return answers(spark, d).select("doc_id", r6(M.bleu([F.col("p")], [F.col("g")])).alias("bleu1"))


@query(f"""WITH {ANSWERS}, b AS (SELECT doc_id, p, g, {grams("p", 2)} AS p2, {grams("g", 2)} AS g2, {grams("p", 3)} AS p3, {grams("g", 3)} AS g3, {grams("p", 4)} AS p4, {grams("g", 4)} AS g4 FROM a),
    {shared("p", "g", "b", "k1")}, {shared("p2", "g2", "b", "k2")}, {shared("p3", "g3", "b", "k3")}, {shared("p4", "g4", "b", "k4")},
    x AS (SELECT doc_id, len(p) AS n, len(g) AS m, [coalesce(k1, 0), coalesce(k2, 0), coalesce(k3, 0), coalesce(k4, 0)] AS k FROM b LEFT JOIN k1 USING (doc_id) LEFT JOIN k2 USING (doc_id) LEFT JOIN k3 USING (doc_id) LEFT JOIN k4 USING (doc_id)),
    y AS (SELECT doc_id, k[1] = 0 AS none, CASE WHEN n > m THEN 1 ELSE exp(1 - m / n) END AS brevity, list_sum(list_transform(range(1, 5), lambda i: ln(CASE WHEN k[i] > 0 THEN k[i] ELSE 0.1 END / greatest(n - i + 1, 1)) / 4)) AS one, list_sum(list_transform(range(1, 5), lambda i: ln(CASE WHEN k[i] > 0 THEN k[i] WHEN n < 2 THEN 0.1 ELSE ln(n) / (5 * 2 ** i) END / greatest(n - i + 1, 1)) / 4)) AS four FROM x WHERE n > 0)
    SELECT doc_id, round(CASE WHEN coalesce(none, TRUE) THEN 0 ELSE brevity * exp(one) END, 6)::DOUBLE AS method1, round(CASE WHEN coalesce(none, TRUE) THEN 0 ELSE brevity * exp(four) END, 6)::DOUBLE AS method4 FROM a LEFT JOIN y USING (doc_id)""")
def m4_bleu4(spark, d):
    a = M.with_ngrams(M.with_ngrams(answers(spark, d), "p", 4), "g", 4)
    p, g = ([F.col(x), *(F.col(f"{x}_{k}") for k in (2, 3, 4))] for x in "pg")
    return a.select("doc_id", r6(M.bleu(p, g)).alias("method1"), r6(M.bleu(p, g, smoothing=4)).alias("method4"))


@query(f"""WITH {ANSWERS}, x AS (SELECT doc_id, list_distinct(list_filter(p, lambda t: t NOT IN ('of', 'to', 'in'))) AS p, list_distinct(list_filter(g, lambda t: t NOT IN ('of', 'to', 'in'))) AS g FROM a),
    y AS (SELECT doc_id, len(list_intersect(p, g)) AS k, len(p) AS n, len(g) AS m FROM x)
    SELECT doc_id, round(coalesce(k / nullif(n, 0), 0), 6)::DOUBLE AS precision, round(coalesce(k / nullif(m, 0), 0), 6)::DOUBLE AS recall, round(CASE WHEN k > 0 THEN 2.0 * k / (n + m) ELSE 0 END, 6)::DOUBLE AS f1 FROM y""")
def m5_set_prf(spark, d):
    x = answers(spark, d).select("doc_id", M.set_prf(F.col("p"), F.col("g"), ["of", "to", "in"]).alias("s"))
    return x.select("doc_id", *(r6(f"s.{n}").alias(n) for n in ("precision", "recall", "f1")))


@query(f"""WITH {ANSWERS}, b AS (SELECT doc_id, p, g, {grams("p", 2)} AS p2, {grams("g", 2)} AS g2 FROM a), {shared("p", "g", "b", "k1")}, {shared("p2", "g2", "b", "k2")}
    SELECT doc_id, round(CASE WHEN k1 > 0 THEN 2.0 * k1 / (len(p) + len(g)) ELSE 0 END, 6)::DOUBLE AS rouge1, round(CASE WHEN k2 > 0 THEN 2.0 * k2 / (len(p2) + len(g2)) ELSE 0 END, 6)::DOUBLE AS rouge2 FROM b LEFT JOIN k1 USING (doc_id) LEFT JOIN k2 USING (doc_id)""")
def m6_rouge(spark, d):
    a = M.with_ngrams(M.with_ngrams(answers(spark, d), "p", 2), "g", 2)
    return a.select("doc_id", r6(M.rouge_n(F.col("p"), F.col("g"))).alias("rouge1"), r6(M.rouge_n(F.col("p_2"), F.col("g_2"))).alias("rouge2"))


@query()
def m6_rouge_l(spark, d):
    return answers(spark, d).select("doc_id", r6(M.rouge_l(F.col("p"), F.col("g"))).alias("rouge_l"))


# Hits per user: the first events by value; gold: purchases.
RANKED = "h AS (SELECT user_id AS query_id, event_id AS item, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"
GOLD = "g AS (SELECT user_id AS query_id, event_id AS item, 1 + event_id % 3 AS grade FROM events WHERE event_type = 'purchase')"


def hits(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item"), "event_type", F.row_number().over(w).alias("rank"))


def gold(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item"), (F.col("event_id") % 3 + 1).alias("grade"))


@query("""WITH r AS (SELECT user_id, list(event_type ORDER BY event_id) AS got FROM events GROUP BY 1), x AS (SELECT user_id, list_distinct(got[1:4]) AS got, ['purchase', 'click'] AS gold FROM r),
    y AS (SELECT user_id, len(got) AS n, len(list_intersect(got, gold)) AS k FROM x) SELECT user_id, round(k / n, 6)::DOUBLE AS precision, round(k / 2, 6)::DOUBLE AS recall, k > 0 AS hit FROM y""")
def m7_retrieval_prf(spark, d):
    from mnemoloom.functions.columns import ordered_collect

    r = table(spark, d, "events").groupBy("user_id").agg(ordered_collect("event_type", "event_id").alias("got"))
    x = r.select("user_id", M.retrieval_prf("got", F.array(F.lit("purchase"), F.lit("click")), 4).alias("s"))
    return x.select("user_id", r6("s.precision").alias("precision"), r6("s.recall").alias("recall"), "s.hit")


@query(f"""WITH {RANKED}, {GOLD}, m AS (SELECT h.query_id, h.rank, coalesce(g.grade, 0) AS rel FROM h LEFT JOIN g USING (query_id, item)),
    f AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM m),
    ks(k) AS (VALUES (5), (20)),
    p AS (SELECT query_id, k, count(*) FILTER (rel > 0) AS n_hit, sum(CASE WHEN rel > 0 THEN found / rank ELSE 0 END) AS ap, coalesce(max(CASE WHEN rel > 0 THEN 1.0 / rank END), 0) AS rr, sum(rel / log2(rank + 1)) AS dcg, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg_exp FROM f, ks WHERE rank <= k GROUP BY 1, 2),
    i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pos, count(*) OVER (PARTITION BY query_id) AS n_gold FROM g),
    j AS (SELECT query_id, k, max(n_gold) AS n_gold, sum(grade / log2(pos + 1)) AS idcg, sum((2 ** grade - 1) / log2(pos + 1)) AS idcg_exp FROM i, ks WHERE pos <= k GROUP BY 1, 2)
    SELECT query_id, k::INT AS k, round(n_hit / k, 6)::DOUBLE AS precision, round(CASE WHEN n_gold IS NULL THEN 1 ELSE n_hit / n_gold END, 6)::DOUBLE AS recall, (n_hit > 0)::INT::DOUBLE AS hit,
      round(CASE WHEN n_hit > 0 THEN 2 * (n_hit / k) * (n_hit / n_gold) / (n_hit / k + n_hit / n_gold) ELSE 0 END, 6)::DOUBLE AS f1, round(coalesce(ap / least(n_gold, k), 0), 6)::DOUBLE AS ap, round(rr, 6)::DOUBLE AS rr,
      round(coalesce(dcg / idcg, 0), 6)::DOUBLE AS ndcg, round(coalesce(dcg_exp / idcg_exp, 0), 6)::DOUBLE AS ndcg_exp FROM p LEFT JOIN j USING (query_id, k)""")
def m8_ranking_metrics(spark, d):
    x = M.ranking_metrics(hits(spark, d), gold(spark, d), [5, 20])
    return x.select("query_id", "k", *(r6(n).alias(n) for n in ("precision", "recall", "hit", "f1", "ap", "rr", "ndcg", "ndcg_exp")))


@query(f"""WITH {RANKED}, m AS (SELECT query_id, rank, item % 4 AS gold_no FROM h WHERE event_type IN ('purchase', 'click')), f AS (SELECT query_id, gold_no, min(rank) AS rank FROM m GROUP BY 1, 2), ks(k) AS (VALUES (1), (3), (10)),
    a AS (SELECT query_id, rank, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT query_id, k, sum(n) AS covered, sum(CASE WHEN rank <= 2 THEN 1 ELSE 1 / log2(rank) END) AS dcg FROM a, ks WHERE rank <= k GROUP BY 1, 2),
    t AS (SELECT DISTINCT query_id, k FROM h, ks), b AS (SELECT k, sum(CASE WHEN i <= 2 THEN 1 ELSE 1 / log2(i) END) AS best FROM ks, range(1, 5) r(i) WHERE i <= k GROUP BY 1)
    SELECT query_id, k::INT AS k, round(coalesce(covered / 4, 0), 6)::DOUBLE AS recall, round(coalesce(dcg / best, 0), 6)::DOUBLE AS ndcg FROM t LEFT JOIN p USING (query_id, k) JOIN b USING (k)""")
def m9_checkpoint_ranking(spark, d):
    h = hits(spark, d)
    m = h.where("event_type in ('purchase', 'click')").select("query_id", "rank", (F.col("item") % 4).alias("gold_no"))
    x = M.checkpoint_ranking(m, h.select("query_id").distinct().withColumn("n_gold", F.lit(4)), [1, 3, 10])
    return x.select("query_id", "k", r6("recall").alias("recall"), r6("ndcg").alias("ndcg"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm FROM conversations),
    g AS (SELECT conv_id, turn AS gold_no, 'm' || turn AS gold_id, 's' || turn AS session, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm FROM conversations WHERE turn % 2 = 0),
    b AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS bag FROM g)
    SELECT t.conv_id AS query_id, t.turn + 1 AS rank, gold_no FROM t JOIN b ON t.conv_id = b.conv_id AND ('i' || t.turn = gold_id OR contains(lower('i' || t.turn || chr(10) || t.text), gold_id) OR (t.turn % 3 = 0 AND gold_no = t.turn + 1)
      OR (b.norm <> '' AND t.norm <> '' AND (contains(t.norm, b.norm) OR len(list_intersect(bag, string_split(t.norm, ' '))) / len(bag) >= 0.75)))""")
def m10_match_gold(spark, d):
    t = table(spark, d, "conversations")
    items = t.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat(F.lit("i"), F.col("turn").cast("string")).alias("item_id"), "text", F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("s"), (F.col("turn") + 1).cast("string")))).alias("sessions"))
    gold_points = t.where("turn % 2 = 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("gold_no"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("gold_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("session"), F.col("text").alias("content"))
    return M.match_gold(items, gold_points)


@query("""WITH r AS (SELECT user_id, list([event_type, 'x' || event_id % 3] ORDER BY event_id) AS gs FROM events GROUP BY 1) SELECT user_id, len(list_filter(gs[1:3], lambda g: list_has_any(g, ['purchase', 'x0']))) > 0 AS hit FROM r""")
def m11_provenance_hit(spark, d):
    from mnemoloom.functions.columns import ordered_collect

    r = table(spark, d, "events").groupBy("user_id").agg(ordered_collect(F.array("event_type", F.concat(F.lit("x"), (F.col("event_id") % 3).cast("string"))), "event_id").alias("gs"))
    return r.select("user_id", M.provenance_hit("gs", F.array(F.lit("purchase"), F.lit("x0")), 3).alias("hit"))


@query(f"""WITH {RANKED}, f AS (SELECT query_id, min(rank) FILTER (event_type = 'purchase') AS first FROM h GROUP BY 1), ks(k) AS (VALUES (1), (5), (10))
    SELECT k::INT AS k, round(avg(CASE WHEN first <= k THEN 1 ELSE 0 END), 6)::DOUBLE AS recall FROM f, ks GROUP BY 1""")
def m12_recall_any(spark, d):
    x = M.recall_any(hits(spark, d).withColumn("relevant", F.col("event_type") == "purchase"), [1, 5, 10])
    return x.select("k", r6("recall").alias("recall"))


@query("""WITH p AS (SELECT user_id, event_type <> 'error' AS covered, CASE WHEN user_id % 10 = 0 THEN 0 ELSE value END AS w FROM events), m AS (SELECT user_id, max(coalesce(w, 0)) > 0 AS any_w FROM p GROUP BY 1),
    x AS (SELECT user_id, covered, CASE WHEN any_w THEN coalesce(w, 0) ELSE 1 END AS w FROM p JOIN m USING (user_id))
    SELECT user_id, round(avg(covered::INT), 6)::DOUBLE AS recall, round(sum(CASE WHEN covered THEN w ELSE 0 END) / nullif(sum(w), 0), 6)::DOUBLE AS weighted_recall FROM x GROUP BY 1""")
def m13_weighted_recall(spark, d):
    p = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("covered"), F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("importance"))
    x = M.weighted_recall(p, ["user_id"])
    return x.select("user_id", r6("recall").alias("recall"), r6("weighted_recall").alias("weighted_recall"))


def labelled_points(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ["memory", "memory", "update", "interference"])), (F.col("event_id") % 4 + 1).cast("int"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 3 + 1).cast("int"))
    label = F.when(kinds == "memory", pick("correct", "hallucination", "error")).when(kinds == "update", pick("updated", "both", "outdated")).otherwise(pick("rejected", "memorized", "rejected"))
    return table(spark, d, "events").select("user_id", kinds.alias("kind"), label.alias("label"))


@query("""WITH p AS (SELECT user_id, event_id % 4 AS k, event_id % 3 AS l FROM events), x AS (SELECT user_id, count(*) FILTER (k < 2) AS n, count(*) FILTER (k < 2 AND l = 0) AS a, count(*) FILTER (k < 2 AND l = 1) AS b, count(*) FILTER (k < 2 AND l = 2) AS c,
    count(*) FILTER (k = 2) AS u, count(*) FILTER (k = 2 AND l = 0) + 0.5 * count(*) FILTER (k = 2 AND l = 1) AS us, count(*) FILTER (k = 3) AS i, count(*) FILTER (k = 3 AND l <> 1) AS ir FROM p GROUP BY 1)
    SELECT user_id, round(coalesce(a / nullif(n, 0), 0), 6)::DOUBLE AS correct_rate, round(coalesce(b / nullif(n, 0), 0), 6)::DOUBLE AS hallucination_rate, round(coalesce(c / nullif(n, 0), 0), 6)::DOUBLE AS error_rate,
      round(us / nullif(u, 0), 6)::DOUBLE AS update_score, round(ir / nullif(i, 0), 6)::DOUBLE AS interference_score FROM x""")
def m14_session_quality(spark, d):
    x = M.session_quality(labelled_points(spark, d), ["user_id"])
    return x.select("user_id", *(r6(n).alias(n) for n in x.columns if n != "user_id"))


@query("SELECT conv_id, len(list_intersect(list(turn), [0, 2, 4, 6]))::INT AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def m15_clue_hits(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.collect_list("turn").alias("got")).select("conv_id", M.clue_hits("got", F.array(*(F.lit(x).cast("long") for x in (0, 2, 4, 6)))).alias("n"))


@query("""WITH e AS (SELECT event_id, ['plain', 'ambiguous', 'unknowable'][event_id % 3 + 1] AS logic, CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS truth, ['it is true', 'False', 'unclear', 'UNKNOWN'][event_id % 4 + 1] AS v,
      (event_id % 5) * 10.0 AS a, (event_id % 7) * 5.0 AS b, (event_id % 3) * 20.0 AS r FROM events),
    x AS (SELECT *, CASE WHEN contains(upper(v), 'TRUE') THEN 'TRUE' WHEN contains(upper(v), 'FALSE') THEN 'FALSE' ELSE 'UNKNOWN' END AS said, logic <> 'plain' AS unk, a + b + r AS t FROM e),
    y AS (SELECT *, CASE WHEN unk THEN said = 'UNKNOWN' ELSE said = truth END AS ok, CASE WHEN t > 0 THEN 100 * r / t ELSE 100 END AS safe FROM x)
    SELECT event_id, ok::INT::DOUBLE AS accuracy, (CASE WHEN ok THEN 1 WHEN said = 'UNKNOWN' AND NOT unk THEN -0.2 ELSE -1 END)::DOUBLE AS robustness,
      round(safe + CASE WHEN unk OR t = 0 THEN 0 WHEN truth = 'TRUE' THEN 200 * a / t ELSE 200 * b / t END, 6)::DOUBLE AS wealth, (unk AND safe > 80)::INT::DOUBLE AS prudent FROM y""")
def m16_robustness(spark, d):
    i = F.col("event_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", pick(3, "plain", "ambiguous", "unknowable").alias("logic"), F.when(i % 2 == 0, "TRUE").otherwise("FALSE").alias("truth"), pick(4, "it is true", "False", "unclear", "UNKNOWN").alias("v"), (i % 5 * 10.0).alias("a"), (i % 7 * 5.0).alias("b"), (i % 3 * 20.0).alias("r"))
    x = e.select("event_id", M.robustness("logic", "truth", "v", "a", "b", "r", ["ambiguous", "unknowable"]).alias("s")).select("event_id", "s.*")
    return x.withColumn("wealth", r6("wealth"))


@query("""WITH q AS (SELECT conv_id AS question_id, 2 AS checkpoint, unnest(list_distinct(list(turn % 9))) AS session FROM conversations GROUP BY conv_id)
    SELECT question_id, count(*) FILTER (session <= 2) AS n_visible, count(*) FILTER (session > 2 AND session < 6) AS n_future, count(*) FILTER (session >= 6) AS n_unmapped FROM q GROUP BY 1""")
def m17_gold_visibility(spark, d):
    t = table(spark, d, "conversations")
    q = t.groupBy("conv_id").agg(F.collect_list(F.col("turn") % 9).alias("gold")).select(F.col("conv_id").alias("question_id"), F.lit(2).alias("checkpoint"), "gold")
    sessions = t.where("turn < 6").select((F.col("turn")).alias("session")).distinct().withColumn("ordinal", F.col("session"))
    return M.gold_visibility(q, sessions)
