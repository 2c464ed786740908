"""Queries for retrieval: ``embeddings`` as memories, every 50th as a query against all others; ``benchmark`` against ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions.columns import norm, ordered_collect, r6, rounded, words
from mnemoloom.operators import chunking, inverted_file as I, lexical_index as LI, retrieval as R
from mnemoloom.plans.chunking import ROUNDS
from mnemoloom.plans.registry import query
from mnemoloom.session import new_folder, table

Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS ql FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT vec_id AS memory_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
S = f"{Q}, s AS (SELECT query_id, memory_id, ql, label, list_cosine_similarity(q.v, m.v) AS score FROM q JOIN m ON query_id <> memory_id)"
H = f"{S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s), h AS (SELECT query_id, memory_id, score, rank FROM r WHERE rank <= 5)"
E = "e AS (SELECT a.vec_id AS source, b.vec_id AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7), e2 AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"
NEAR = "n AS (SELECT h.query_id, target AS memory_id, max(h.score) AS seed FROM h JOIN e2 ON h.memory_id = source GROUP BY 1, 2), f AS (SELECT n.query_id, n.memory_id, s.score + 0.2 * seed AS score FROM n JOIN s USING (query_id, memory_id) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = n.query_id AND h.memory_id = n.memory_id))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"), "label")


def queries(spark, d):
    return vectors(spark, d).where("memory_id % 50 = 0").withColumnRenamed("memory_id", "query_id")


memories = vectors


def top(spark, d, k=5, metric="cosine"):
    return R.vector_topk(queries(spark, d), memories(spark, d), k, metric, own=False)


def score_of(spark, d):
    """Scores of given pairs of a query and another memory."""
    return lambda pairs: R.pair_scores(pairs.where("query_id <> memory_id"), queries(spark, d), memories(spark, d))


def edges(spark, d):
    a = memories(spark, d).select(F.col("memory_id").alias("source"))
    return a.withColumn("target", F.col("source") + 7).join(a.select(F.col("source").alias("target")), "target").select("source", "target")


def shown(df):
    return df.withColumn("score", r6("score"))


@query(f"""WITH {H}, x AS (SELECT h.query_id, ql, max((label = ql)::INT) AS hit, avg((label = ql)::INT) AS precision FROM h JOIN m USING (memory_id) JOIN q ON q.query_id = h.query_id GROUP BY 1, 2)
    SELECT coalesce(ql::VARCHAR, 'ALL') AS label, count(*) AS n, round(avg(hit), 6)::DOUBLE AS hit_rate, round(avg(precision), 6)::DOUBLE AS mean_precision FROM x GROUP BY GROUPING SETS ((), (ql))""")
def v1_vector_topk(spark, d):
    """The flagship: dense top 5, gold is an equal label, means overall and by label."""
    q = queries(spark, d).select("query_id", F.col("label").alias("ql"))
    h = top(spark, d).join(memories(spark, d).select("memory_id", "label"), "memory_id").join(q, "query_id")
    same = (F.col("label") == F.col("ql")).cast("int")
    per = h.groupBy("query_id", "ql").agg(F.max(same).alias("hit"), F.avg(same).alias("precision"))
    sets = per.groupingSets([[], ["ql"]], "ql").agg(F.count("*").alias("n"), r6(F.avg("hit")).alias("hit_rate"), r6(F.avg("precision")).alias("mean_precision"))
    return sets.select(F.coalesce(F.col("ql").cast("string"), F.lit("ALL")).alias("label"), "n", "hit_rate", "mean_precision")


@query(f"WITH {H} SELECT query_id, memory_id, rank::INT AS rank, round(score, 6) AS score FROM h")
def v1_hits(spark, d):
    return shown(top(spark, d))


@query(f"WITH {S}, b AS (SELECT query_id, memory_id, CASE WHEN ql < 3 AND memory_id % 4 = 0 THEN greatest(score, 0.1 * (memory_id % 8)) ELSE score END AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM b) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def v2_visual_boost(spark, d):
    """Every fourth memory has an image, of the same similarity to all visual queries (those of the first three labels)."""
    visual = queries(spark, d).where("label < 3").select("query_id")
    image = lambda df: df.where("memory_id % 4 = 0").withColumn("score", 0.1 * (F.col("memory_id") % 8))
    best = image(memories(spark, d).select("memory_id")).orderBy(F.desc("score"), "memory_id").limit(6)
    image_hits = R.ranked(visual.join(best, F.col("query_id") != F.col("memory_id")), 5)
    image_of = lambda pairs: image(pairs).join(visual, "query_id", "left_semi")
    return shown(R.boosted_topk(top(spark, d), image_hits, score_of(spark, d), image_of, 5))


@query(f"WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE memory_id % 3 <> 0 AND label < 5) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def v3_eligible(spark, d):
    m = memories(spark, d).withColumn("status", F.when(F.col("memory_id") % 3 == 0, "ARCHIVED").otherwise("ACTIVE")).withColumn("session_id", F.col("label"))
    return shown(R.vector_topk(queries(spark, d), R.eligible(m, m.where("label < 5").select("session_id")), 5, own=False))


@query(f"WITH {H}, {E}, {NEAR}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS k FROM f) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank, 'vector' AS via FROM h UNION ALL SELECT query_id, memory_id, round(score, 6), (k + 5)::INT, 'graph' FROM g WHERE k <= 2")
def v4_graph_append(spark, d):
    return shown(R.graph_append(top(spark, d), edges(spark, d), score_of(spark, d)))


@query(f"""WITH {H}, {E}, a AS (SELECT DISTINCT h.query_id, target AS memory_id, unnest([source % 6, target % 6]) AS attr FROM h JOIN e2 ON h.memory_id = source), c AS (SELECT query_id, memory_id, attr FROM a WHERE query_id <> memory_id AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = a.query_id AND h.memory_id = a.memory_id)),
    t AS (SELECT query_id, memory_id, sum(0.1 * attr + 0.01 * (query_id % 7)) AS score FROM c GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rank FROM t) SELECT query_id, memory_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM rk WHERE rank <= 2""")
def v5_attribute_append(spark, d):
    e = edges(spark, d).withColumn("attributes", F.array((F.col("source") % 6), (F.col("target") % 6)))
    a = queries(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("attribute")).withColumn("score", 0.1 * F.col("attribute") + 0.01 * (F.col("query_id") % 7))
    return shown(R.attribute_append(top(spark, d), e, a))


@query(f"WITH {H}, {E}, {NEAR}, u AS (SELECT query_id, memory_id, score, 'vector' AS via FROM h UNION ALL SELECT query_id, memory_id, score, 'graph' FROM f), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, via DESC, memory_id) AS rank FROM u) SELECT query_id, memory_id, round(score, 6) AS score, via, rank::INT AS rank FROM rk WHERE rank <= 5")
def v6_graph_rerank(spark, d):
    return shown(R.graph_rerank(top(spark, d), edges(spark, d), score_of(spark, d), 5))


@query(f"""WITH {H}, o AS (SELECT label, memory_id, row_number() OVER (PARTITION BY label ORDER BY sha256('7|' || memory_id), memory_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS size FROM m),
    p AS (SELECT q.query_id, o.memory_id, (place - ('0x' || substr(sha256('7|' || q.query_id), 1, 12))::BIGINT % size + size) % size AS step FROM q JOIN o ON ql = o.label WHERE q.query_id <> o.memory_id AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = q.query_id AND h.memory_id = o.memory_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step) AS rank FROM p) SELECT query_id, memory_id, rank::INT AS rank FROM rk WHERE rank <= 3""")
def v7_random_append(spark, d):
    h = top(spark, d).join(queries(spark, d).select("query_id", F.col("label").alias("bank")), "query_id")
    return R.random_append(h, memories(spark, d).withColumnRenamed("label", "bank"), 3, "7").select("query_id", "memory_id", "rank")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def v8_similarity_join(spark, d):
    return shown(R.similarity_join(vectors(spark, d), 0.35, "label"))


def indexed(spark, d, k=5):
    """An index of all memories, the probes that find 0.97 of the exact hits of a sample, and what the queries find with them."""
    path = I.build_index(memories(spark, d), new_folder(spark, "ann-index"))
    probes = I.probes_for(spark, path, memories(spark, d), k, target=0.97)
    return path, probes, I.index_topk(spark, path, queries(spark, d), k, probes, refine=20, own=False)


@query()
def v8_ann_topk(spark, d):
    return shown(indexed(spark, d)[2])


@query("WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 50 = 0) AS q FROM embeddings) SELECT q AS queries, q * least(5, n - 1) AS wanted, true AS reached, true AS scanned_less FROM n")
def v8_ann_quality(spark, d):
    """Exact hits over all rows; whether 0.9 of them are found; whether fewer rows than all are looked at. The SQL counts and expects both."""
    path, probes, found = indexed(spark, d)
    quality = I.recall(found, top(spark, d)).crossJoin(I.scanned_share(spark, path, queries(spark, d), probes))
    return quality.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"), (F.col("share") < 1).alias("scanned_less"))


# Documents of twelve vectors; a query has two parts.
PARTS = "q2 AS (SELECT vec_id // 50 AS query_id, vec_id % 50 AS part, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 < 2), s2 AS (SELECT query_id, part, vec_id // 12 AS memory_id, list_cosine_similarity(q2.v, embedding::DOUBLE[]) AS score FROM q2, embeddings)"

for mode, how in (("max", "max(score)"), ("mean", "avg(score)"), ("min", "min(score)"), ("sum", "sum(score) / count(DISTINCT vec) ")):

    def multivector(spark, d, mode=mode):
        v = vectors(spark, d)
        asked = v.where("memory_id % 50 < 2").select(F.floor(F.col("memory_id") / 50).alias("query_id"), (F.col("memory_id") % 50).alias("part"), "vector")
        return shown(R.multivector_topk(asked, v.select(F.floor(F.col("memory_id") / 12).alias("memory_id"), "vector"), 5, mode))

    multivector.__name__ = f"v9_multivector_{mode}"
    query(f"WITH {PARTS.replace('vec_id // 12 AS memory_id,', 'vec_id // 12 AS memory_id, vec_id AS vec,')}, t AS (SELECT query_id, memory_id, {how} AS score FROM s2 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM t) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")(multivector)

for metric, how in (("l2", "-list_distance(q.v, m.v)"), ("dot", "list_dot_product(q.v, m.v)")):

    def by_metric(spark, d, metric=metric):
        return shown(top(spark, d, 5, metric))

    by_metric.__name__ = f"v10_metric_{metric}"
    query(f"WITH {Q}, s AS (SELECT query_id, memory_id, {how} AS score FROM q JOIN m ON query_id <> memory_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")(by_metric)

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
INDEX = f"""d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p0 AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM d), p AS (SELECT id, token, dl, count(*) AS tf FROM p0 GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM p GROUP BY 1), q0 AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS t FROM benchmark), q AS (SELECT query_id, len(t) AS ql, unnest(t) AS token FROM q0), qt AS (SELECT query_id, ql, token, count(*) AS qtf FROM q GROUP BY ALL)"""


@query(f"""WITH {INDEX}, w AS (SELECT id, p.token, tf / dl * (ln((1 + n) / (1 + df)) + 1) AS w FROM p JOIN df USING (token), st), dn AS (SELECT id, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1),
    qw AS (SELECT query_id, qt.token, qtf / ql * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS qw FROM qt LEFT JOIN df USING (token), st), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn, count(*) AS nt FROM qw GROUP BY 1),
    x AS (SELECT query_id, id, sum(qw * w) AS dot, count(*) AS shared FROM qw JOIN w USING (token) GROUP BY 1, 2), s AS (SELECT query_id, id AS memory_id, 0.35 * shared / nt + 0.65 * dot / (qn * dn) AS score FROM x JOIN qn USING (query_id) JOIN dn USING (id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rank FROM s WHERE score > 0) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def v11_tfidf_topk(spark, d):
    return lexical(spark, d, "tfidf", 5)


@query(f"""WITH {INDEX}, s AS (SELECT query_id, id AS memory_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (token) JOIN p USING (token), st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rank FROM s WHERE score > 0) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def v12_bm25_topk(spark, d):
    return lexical(spark, d, "bm25", 5)


def lexical(spark, d, how, k):
    """Hits from a new index of all documents."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    path = LI.add_documents(spark, new_folder(spark, "lexical-index"), table(spark, d, "documents"), words)
    search = LI.bm25_search if how == "bm25" else LI.tfidf_search
    return shown(search(spark, path, q, words, k))


@query(f"""WITH {INDEX}, s AS (SELECT query_id, id AS memory_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (token) JOIN p USING (token), st GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS w FROM s WHERE score > 0), r AS (SELECT w.*, row_number() OVER (PARTITION BY query_id ORDER BY w) AS rank FROM w JOIN documents ON doc_id = memory_id WHERE w <= 10 AND source IN ('src1', 'src2', 'src3')) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def v12_bm25_tags(spark, d):
    """Twice the wanted number is fetched, and what has none of the asked tags (here sources) is left out."""
    docs = table(spark, d, "documents")
    asked = docs.where(F.col("source").isin("src1", "src2", "src3")).select(F.col("doc_id").alias("id"), F.col("source").alias("tag"))
    return R.with_tags(lexical(spark, d, "bm25", 10), asked, 5)


@query(f"""WITH {S}, i AS (SELECT query_id, a.vec_id AS memory_id, max([list_cosine_similarity(q.v, b.embedding::DOUBLE[]), b.vec_id - a.vec_id]) AS b FROM q, embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 WHERE a.vec_id % 5 = 0 GROUP BY 1, 2),
    t AS (SELECT s.query_id, s.memory_id, CASE WHEN b IS NULL THEN 0.5 * score ELSE 0.5 * score + 0.5 * b[1] END AS score, b[2]::BIGINT AS image_no FROM s LEFT JOIN i USING (query_id, memory_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM t) SELECT query_id, memory_id, round(score, 6) AS score, image_no, rank::INT AS rank FROM r WHERE rank <= 5""")
def v13_weighted_topk(spark, d):
    """Every fifth memory has up to three images: the vectors of the three memories after it."""
    v = memories(spark, d)
    after = v.select("memory_id", "vector", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("image_no")).withColumn("memory_id", F.col("memory_id") - F.col("image_no"))
    images = after.where("memory_id % 5 = 0").groupBy("memory_id").agg(ordered_collect("vector", "image_no").alias("images"))
    return shown(R.weighted_topk(queries(spark, d), v.join(images, "memory_id", "left"), 5))


@query(f"WITH {ROUNDS}, s AS (SELECT conv_id AS query_id, conv_id, unnest(range(round - 1, round + 2)) AS round FROM rounds WHERE round % 3 = 0) SELECT DISTINCT query_id, conv_id, round, first_turn FROM s JOIN rounds USING (conv_id, round)")
def v14_expand_neighbors(spark, d):
    r = chunking.pair_rounds(table(spark, d, "conversations"))
    return R.expand_neighbors(r.where("round % 3 = 0").select(F.col("conv_id").alias("query_id"), "conv_id", "round"), r.select("conv_id", "round", "first_turn"))


THREE = f"""{Q}, s1 AS (SELECT query_id, memory_id, list_cosine_similarity(q.v, m.v) AS c, -list_distance(q.v[1:16], m.v[1:16]) AS l, list_dot_product(q.v[33:64], m.v[33:64]) AS o FROM q JOIN m ON query_id <> memory_id),
    a AS (SELECT * FROM (SELECT query_id, memory_id, c AS score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, memory_id) AS rank FROM s1) WHERE rank <= 10), b AS (SELECT * FROM (SELECT query_id, memory_id, l AS score, row_number() OVER (PARTITION BY query_id ORDER BY l DESC, memory_id) AS rank FROM s1) WHERE rank <= 10),
    o AS (SELECT * FROM (SELECT query_id, memory_id, o AS score, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, memory_id) AS rank FROM s1) WHERE rank <= 10)"""


def three(spark, d):
    cut = lambda df, a, n: df.withColumn("vector", F.slice("vector", a, n))
    q, m = queries(spark, d), memories(spark, d)
    return top(spark, d, 10), R.vector_topk(cut(q, 1, 16), cut(m, 1, 16), 10, "l2", own=False), R.vector_topk(cut(q, 33, 32), cut(m, 33, 32), 10, "dot", own=False)


@query(f"WITH {THREE}, u AS (SELECT query_id, memory_id, rank FROM a UNION ALL SELECT query_id, memory_id, rank FROM b), f AS (SELECT query_id, memory_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1, 2) SELECT query_id, memory_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, memory_id))::INT AS rank FROM f")
def v15_rrf(spark, d):
    a, b, _ = three(spark, d)
    return shown(R.rrf([a, b]))


@query(f"""WITH {THREE}, u AS (SELECT query_id, memory_id, rank FROM a WHERE rank <= 5 UNION ALL SELECT query_id, memory_id, rank FROM b WHERE rank <= 5), f AS (SELECT query_id, memory_id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1, 2), g AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, memory_id) AS rank FROM f),
    x AS (SELECT * FROM g UNION ALL SELECT query_id, memory_id, rank FROM o WHERE rank <= 3), y AS (SELECT query_id, memory_id, sum(1.0 / (60 + rank)) AS score FROM x GROUP BY 1, 2) SELECT query_id, memory_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, memory_id))::INT AS rank FROM y""")
def v16_hybrid_search(spark, d):
    return shown(R.hybrid_search(*three(spark, d)))


@query(f"WITH {THREE}, u AS (SELECT query_id, memory_id, score FROM a UNION ALL SELECT query_id, memory_id, score FROM o), f AS (SELECT query_id, memory_id, max(score) AS score FROM u GROUP BY 1, 2) SELECT query_id, memory_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id))::INT AS rank FROM f")
def v17_merge_max(spark, d):
    a, _, o = three(spark, d)
    return shown(R.merge_hits([a, o], "max"))


@query(f"WITH {THREE}, u AS (SELECT query_id, memory_id, score, 0 AS l, rank FROM a UNION ALL SELECT query_id, memory_id, score, 1, rank FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, memory_id ORDER BY l, rank) AS k FROM u) SELECT query_id, memory_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY l, rank))::INT AS rank FROM f WHERE k = 1")
def v17_merge_first(spark, d):
    a, _, o = three(spark, d)
    return shown(R.merge_hits([a, o], "first"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND contains(lower(props), 'k') AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'")
def v18_structured_search(spark, d):
    import datetime

    e = table(spark, d, "events").withColumn("persons", F.array("event_type")).withColumn("location", F.col("props"))
    return R.structured_search(e, ["click", "purchase"], "K", datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 20)).select("event_id")


@query("SELECT doc_id AS memory_id FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 20")
def v19_list_memories(spark, d):
    return R.list_memories(table(spark, d, "documents").withColumnRenamed("doc_id", "memory_id"), "TION", "text", 20).select("memory_id")


@query("SELECT vec_id AS memory_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: (i % 5 - 2)::DOUBLE)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: (i % 5 - 2)::DOUBLE)) DESC, vec_id LIMIT 20")
def v19_list_by_vector(spark, d):
    asked = [float(i % 5 - 2) for i in range(1, 65)]
    return shown(R.list_memories(memories(spark, d), "", k=20, method="vector", vector=asked).select("memory_id", "score"))


@query(f"""WITH d AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), p0 AS (SELECT id, len(t) AS dl, unnest(t) AS token FROM d), p AS (SELECT id, token, dl, count(*) AS tf FROM p0 GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM p GROUP BY 1), s AS (SELECT id AS memory_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM p JOIN df USING (token), st WHERE token IN ('the', 'ing', 'avec', 'die') GROUP BY 1)
    SELECT memory_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, memory_id LIMIT 20""")
def v19_list_by_bm25(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("doc_id", "memory_id")
    return shown(R.list_memories(rows, "The ing, avec die", "text", 20, "bm25", words).select("memory_id", "score"))


@query("SELECT doc_id AS memory_id FROM documents ORDER BY doc_id LIMIT 20")
def v19_list_stored_order(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("doc_id", "memory_id")
    return R.list_memories(rows, " ?! ", "text", 20, "bm25", words).select("memory_id")


@query("WITH x AS (SELECT user_id AS bank, event_id AS memory_id, ts, (floor(epoch(max(ts) OVER (PARTITION BY user_id))) - floor(epoch(ts))) / 3600.0 AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY ts DESC, memory_id) AS rank FROM x) SELECT bank, memory_id, round(0.99 ** h, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3")
def v20_recency_topk(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("bank"), F.col("event_id").alias("memory_id"), "ts")
    return shown(R.recency_topk(e, 3)).select("bank", "memory_id", "score", "rank")


@query("WITH x AS (SELECT user_id AS query_id, event_id AS memory_id, (event_id % 10) / 10.0 + 0.995 ** ((epoch(TIMESTAMP '2024-06-01') - floor(epoch(ts))) / 3600.0) + (event_id % 4) / 4.0 AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM x) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3")
def v21_weighted_recall(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("memory_id"), (F.col("event_id") % 10 / 10.0).alias("relevance"), (F.col("event_id") % 4 / 4.0).alias("importance"), F.col("ts").alias("last_access"))
    hits, _ = R.weighted_recall_search(e, F.to_timestamp(F.lit("2024-06-01")), 3)
    return shown(hits).select("query_id", "memory_id", "score", "rank")


@query(f"WITH {Q}, s AS (SELECT query_id, memory_id, list_cosine_similarity(q.v, m.v) AS score FROM q, m), ss AS (SELECT query_id, memory_id // 10 AS session_id, avg(score) AS score FROM s GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS rank FROM ss WHERE score >= 0.05), r AS (SELECT b.query_id, session_id, b.score, rank, memory_id, s.score AS page FROM b JOIN s ON s.query_id = b.query_id AND s.memory_id // 10 = session_id AND s.score >= 0.1 WHERE rank <= 5) SELECT query_id, session_id, round(score, 6) AS score, rank::INT AS rank, list(memory_id ORDER BY page DESC, memory_id) AS pages FROM r GROUP BY query_id, session_id, score, rank")
def v22_two_level_search(spark, d):
    """Sessions of ten memories, by the mean similarity of their pages."""
    q, m = queries(spark, d), memories(spark, d)
    pages = m.select((F.floor(F.col("memory_id") / 10)).alias("session_id"), F.col("memory_id").alias("page_id"), "vector")
    unit = q.select("query_id", F.transform("vector", lambda x: x.cast("double") / norm(F.col("vector"))).alias("vector"))
    sessions = R.vector_topk(unit, R.session_vectors(pages).withColumnRenamed("session_id", "memory_id"), 5, "dot", min_score=0.05).withColumnRenamed("memory_id", "session_id")
    return shown(R.two_level_search(sessions, pages, lambda pairs: R.pair_scores(pairs, q, m), 0.1))


WALK = f"{S}, {E}, t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 5)"


@query(f"""WITH RECURSIVE {WALK}, g AS (SELECT query_id, memory_id, 0 AS hop FROM t5 UNION SELECT g.query_id, e2.target, g.hop + 1 FROM g JOIN e2 ON g.memory_id = e2.source JOIN s ON s.query_id = g.query_id AND s.memory_id = e2.target AND s.score >= 0 WHERE g.hop < 3),
    f AS (SELECT query_id, memory_id, min(hop) AS hop FROM g GROUP BY 1, 2), dg AS (SELECT source, count(*) AS n FROM e2 GROUP BY 1) SELECT f.query_id, f.memory_id, f.hop::INT AS hop, round(score * (1 + 0.1 * coalesce(n, 0)), 6) AS score FROM f JOIN s USING (query_id, memory_id) LEFT JOIN dg ON dg.source = f.memory_id""")
def v23_graph_traverse(spark, d):
    return shown(R.graph_traverse(top(spark, d), edges(spark, d), score_of(spark, d), 3, 0.0))


@query(f"""WITH {S}, {E}, t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 2), w AS (SELECT source, target, 0.2 + 0.1 * ((source + target) % 7) AS weight FROM e2),
    a AS (SELECT t2.query_id, [t2.memory_id, target] AS path, (s.score + weight) / 2 AS score FROM t2 JOIN w ON source = t2.memory_id JOIN s ON s.query_id = t2.query_id AND s.memory_id = target), a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path[1] ORDER BY score DESC, path[2]) AS k FROM a) WHERE k <= 2),
    b AS (SELECT a2.query_id, list_append(path, target) AS path, a2.score * (s.score + weight) / 2 AS score FROM a2 JOIN w ON source = path[2] AND NOT list_contains(path, target) JOIN s ON s.query_id = a2.query_id AND s.memory_id = target), b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path[1:2] ORDER BY score DESC, path[3]) AS k FROM b) WHERE k <= 2),
    c AS (SELECT b2.query_id, list_append(path, target) AS path, b2.score * (s.score + weight) / 2 AS score FROM b2 JOIN w ON source = path[3] AND NOT list_contains(path, target) JOIN s ON s.query_id = b2.query_id AND s.memory_id = target), c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path[1:3] ORDER BY score DESC, path[4]) AS k FROM c) WHERE k <= 2),
    u AS (SELECT query_id, path, score FROM a2 UNION ALL SELECT query_id, path, score FROM b2 UNION ALL SELECT query_id, path, score FROM c2), z AS (SELECT *, path[-1] AS memory_id, row_number() OVER (PARTITION BY query_id, path[-1] ORDER BY score DESC, path DESC) AS k FROM u WHERE score >= 0.05) SELECT query_id, memory_id, round(score, 6) AS score, path FROM z WHERE k = 1""")
def v24_path_expand(spark, d):
    e = edges(spark, d).withColumn("weight", 0.2 + 0.1 * ((F.col("source") + F.col("target")) % 7))
    return shown(R.path_expand(top(spark, d, 2), e, score_of(spark, d), 3, 2, 0.05))


@query(f"""WITH RECURSIVE {S}, h10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 10), c AS (SELECT query_id, rank, memory_id, CASE WHEN memory_id % 3 = 0 THEN 500 ELSE 100 END AS cost FROM h10),
    x AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, 1000::BIGINT AS "left", []::BIGINT[] AS taken FROM c UNION ALL SELECT x.query_id, c.rank, CASE WHEN cost <= "left" THEN "left" - cost ELSE "left" END, CASE WHEN cost <= "left" THEN list_append(taken, memory_id) ELSE taken END FROM x JOIN c ON c.query_id = x.query_id AND c.rank = x.rank + 1)
    SELECT query_id, taken, "left" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS k FROM x) WHERE k = 1""")
def v25_expand_with_budget(spark, d):
    h = top(spark, d, 10)
    return R.expand_with_budget(h, 1000, F.when(F.col("memory_id") % 3 == 0, 500).otherwise(100))


@query("SELECT doc_id, part, 'doc_' || doc_id AS parent FROM (SELECT doc_id, unnest(range(0, 3)) AS part FROM documents)")
def v26_collapse_parts(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("part"))
    return x.select("doc_id", "part", R.collapse_parts(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_part"), F.col("part").cast("string"))).alias("parent"))


@query("SELECT a.vec_id, list_transform(range(1, 65), lambda i: round(CASE WHEN b.vec_id IS NULL THEN a.embedding[i]::DOUBLE ELSE 0.3 * b.embedding[i]::DOUBLE + 0.7 * a.embedding[i]::DOUBLE END, 6)) AS fused FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 3")
def v27_fuse_vectors(spark, d):
    e = table(spark, d, "embeddings")
    s = e.select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("script"))
    x = e.join(s, "vec_id", "left")
    return x.select("vec_id", F.transform(R.fuse_vectors(F.col("script").cast("array<double>"), F.col("embedding").cast("array<double>"), 0.3), lambda v: rounded(v)).alias("fused"))


@query("SELECT event_id, [['text', 'image'], ['no'], ['table'], ['no'], ['clip', 'text']][event_id % 5 + 1] AS routes FROM events")
def v28_route_modalities(spark, d):
    forms = F.array(*map(F.lit, ["text+Image", "no", "['table', 'no']", "audio", "clip, text, clip"]))
    return table(spark, d, "events").select("event_id", R.route_modalities(F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int")), ["no", "text", "image", "table", "clip"]).alias("routes"))


@query("WITH c AS (SELECT DISTINCT user_id AS bank, unnest([3, 7]) AS checkpoint FROM events) SELECT bank, checkpoint, count(*) AS n, bank || '@' || checkpoint AS bank_at FROM events JOIN c ON user_id = bank AND event_id % 10 <= checkpoint GROUP BY ALL")
def v29_as_of_bank(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("bank"), (F.col("event_id") % 10).alias("session_id"), F.col("event_id").alias("memory_id"))
    c = m.select("bank").distinct().withColumn("checkpoint", F.explode(F.array(F.lit(3), F.lit(7)))).withColumn("session_id", F.explode(F.sequence(F.lit(0), F.col("checkpoint")).cast("array<bigint>")))
    return R.as_of_bank(m, c).groupBy("bank", "checkpoint", "bank_at").agg(F.count("*").alias("n"))


@query(f"WITH {H}, g AS (SELECT * FROM h WHERE score >= 0.45) SELECT q.query_id, memory_id, coalesce(rank, 0)::INT AS rank, memory_id IS NULL AS zero_hit FROM q LEFT JOIN g USING (query_id)")
def v30_zero_hits(spark, d):
    return R.with_zero_hits(queries(spark, d), top(spark, d).where("score >= 0.45")).select("query_id", "memory_id", "rank", "zero_hit")


@query(f"WITH {S}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS w FROM s), r AS (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM w WHERE w <= 10 AND label IN (0, 1, 2, 3)) SELECT query_id, memory_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def v31_filtered_topk(spark, d):
    h = top(spark, d, 10).join(memories(spark, d).select("memory_id", "label"), "memory_id")
    return shown(R.filtered_topk(h, 5, F.col("label").isin(0, 1, 2, 3))).select("query_id", "memory_id", "score", "rank")


@query(f"WITH {S}, r AS (SELECT *, CASE WHEN label < 5 THEN 'text' ELSE 'clip' END AS corpus FROM s WHERE (ql % 2 = 0 AND label < 5) OR label >= 5), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, memory_id) AS rank FROM r) SELECT query_id, corpus, memory_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 3")
def v32_routed_topk(spark, d):
    q, m = queries(spark, d), memories(spark, d)
    text = R.vector_topk(q.where("label % 2 = 0"), m.where("label < 5"), 3, own=False).withColumn("corpus", F.lit("text"))
    clip = R.vector_topk(q, m.where("label >= 5"), 3, own=False).withColumn("corpus", F.lit("clip"))
    return shown(text.unionByName(clip))
