"""Answer and ranking metrics: a score per row, aggregated elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import c, ngrams, ratio, words
from mnemoloom.functions.words import lcs, overlap, stems
from mnemoloom.operators.text import normalize_answer


def answer_tokens(text: Column | str) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda x: x != "")


def f_measure(common: Column, n: Column, m: Column) -> Column:
    """2PR / (P + R) = 2 common / (n + m); 0 where nothing is shared."""
    return F.when(common > 0, 2.0 * common / (n + m)).otherwise(0.0)


def token_f1(df: DataFrame, pred: str, gold: str, stem: bool = True, out: str = "f1") -> DataFrame:
    """Adds the F1 of the multisets of normalised tokens, stemmed or not. Token arrays become columns first, so that they are made once a row."""
    p, g = answer_tokens(pred), answer_tokens(gold)
    rows = df.withColumns({"_p": stems()(p) if stem else p, "_g": stems()(g) if stem else g})
    return rows.withColumn(out, f_measure(overlap()(F.col("_p"), F.col("_g")), F.size("_p"), F.size("_g"))).drop("_p", "_g")


def exact_match(pred: str, gold: str, strict: bool = False) -> Column:
    p, g = normalize_answer(pred), normalize_answer(gold)
    return (p == g) & (p != "") if strict else p == g


def contains_gold(pred: str, gold: str) -> Column:
    g = normalize_answer(gold)
    return (g != "") & normalize_answer(pred).contains(g)


def span_match(a: str, b: str) -> Column:
    """Whether the tokens of one are a contiguous run of the other's."""
    pad = lambda x: F.concat(F.lit(" "), normalize_answer(x), F.lit(" "))
    return (normalize_answer(a) != "") & (normalize_answer(b) != "") & (pad(a).contains(pad(b)) | pad(b).contains(pad(a)))


def bleu(pred: list[Column], gold: list[Column], smoothing: int = 1) -> Column:
    """Sentence BLEU from the 1..n-gram arrays of both texts (as columns, see ``with_ngrams``).

    Zero counts become 0.1 (method 1), or 1 / (2**k * 5 / ln(length)), less for longer texts (method 4; 0.1 for a single word).
    """
    logs, n = [], len(pred)
    for k, (p, g) in enumerate(zip(pred, gold, strict=True), 1):
        hit, total = overlap()(p, g).cast("double"), F.greatest(F.size(p), F.lit(1))
        low = F.lit(0.1) if smoothing == 1 else F.when(F.size(pred[0]) < 2, 0.1).otherwise(F.log(F.greatest(F.size(pred[0]), F.lit(2)).cast("double")) / (F.pow(F.lit(2.0), F.lit(k)) * 5))
        logs.append(F.log(F.when(hit > 0, hit).otherwise(low) / total) / n)
    p, g = F.size(pred[0]), F.size(gold[0])
    brevity = F.when(p > g, F.lit(1.0)).otherwise(F.exp(1 - g / p))
    none = (p == 0) | (g == 0) | ~F.arrays_overlap(pred[0], gold[0])
    return F.when(none, 0.0).otherwise(brevity * F.exp(sum(logs[1:], logs[0])))


def with_ngrams(df: DataFrame, tokens: str, n: int) -> DataFrame:
    """Adds ``tokens_2`` .. ``tokens_n``: the n-grams of a token array, made once a row."""
    return df.withColumns({f"{tokens}_{k}": ngrams(F.col(tokens), k) for k in range(2, n + 1)})


def set_prf(pred: Column, gold: Column, stopwords: list[str]) -> Column:
    stop = F.array(*map(F.lit, stopwords))
    p, g = F.array_except(pred, stop), F.array_except(gold, stop)
    hit = F.size(F.array_intersect(p, g))
    return F.struct(F.coalesce(ratio(hit, F.size(p)), F.lit(0.0)).alias("precision"), F.coalesce(ratio(hit, F.size(g)), F.lit(0.0)).alias("recall"), f_measure(hit, F.size(p), F.size(g)).alias("f1"))


def rouge_n(pred: Column, gold: Column) -> Column:
    """F-measure on two arrays of n-grams."""
    return f_measure(overlap()(pred, gold), F.size(pred), F.size(gold))


def rouge_l(pred: Column, gold: Column) -> Column:
    """F-measure on the longest common subsequence of two token arrays."""
    return f_measure(lcs()(pred, gold), F.size(pred), F.size(gold))


def retrieval_prf(retrieved: Column | str, gold: Column | str, k: int) -> Column:
    """Precision (by the number returned), recall, hit on distinct ids; the list is cut to ``k`` before duplicates go."""
    got = F.array_distinct(F.slice(c(retrieved), 1, k))
    hit = F.size(F.array_intersect(got, c(gold)))
    return F.struct(F.coalesce(ratio(hit, F.size(got)), F.lit(0.0)).alias("precision"), F.coalesce(ratio(hit, F.size(F.array_distinct(c(gold)))), F.lit(0.0)).alias("recall"), (hit > 0).alias("hit"))


def ranking_metrics(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per (query_id, k): precision, recall, hit, f1, ap, rr, ndcg (linear gain), ndcg_exp.

    hits: (query_id, item, rank from 1); gold: (query_id, item, grade). A query without gold has recall 1
    and 0 elsewhere; average precision divides by min(#gold, k).
    """
    g = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sort_array(F.collect_list(F.col("grade").cast("double")), False).alias("ideal"))
    marked = hits.join(gold, ["query_id", "item"], "left").withColumn("rel", F.coalesce(F.col("grade").cast("double"), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("found", F.sum((F.col("rel") > 0).cast("int")).over(w)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    is_hit = F.col("rel") > 0
    gain = lambda x: x / F.log2(F.col("rank") + 1)
    per = marked.groupBy("query_id", "k").agg(
        F.sum(is_hit.cast("int")).alias("n_hit"), F.sum(F.when(is_hit, F.col("found") / F.col("rank"))).alias("ap_sum"), F.max(F.when(is_hit, 1.0 / F.col("rank"))).alias("rr"),
        F.sum(gain(F.col("rel"))).alias("dcg"), F.sum(gain(F.pow(F.lit(2.0), "rel") - 1)).alias("dcg_exp"),
    )
    every = hits.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    x = every.join(per, ["query_id", "k"], "left").join(g, "query_id", "left").fillna(0, ["n_hit", "n_gold"]).fillna(0.0, ["ap_sum", "rr", "dcg", "dcg_exp"])
    ideal = lambda f: F.aggregate(F.transform(F.slice(F.coalesce("ideal", F.array().cast("array<double>")), 1, F.col("k")), lambda v, i: f(v) / F.log2(i + 2)), F.lit(0.0), lambda s, v: s + v)
    precision, recall = F.col("n_hit") / F.col("k"), F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_gold"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return x.select(
        "query_id", "k", precision.alias("precision"), recall.alias("recall"), (F.col("n_hit") > 0).cast("double").alias("hit"),
        F.when(F.col("n_hit") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        zero(ratio(F.col("ap_sum"), F.least("n_gold", "k"))).alias("ap"), F.col("rr"), zero(ratio(F.col("dcg"), ideal(lambda v: v))).alias("ndcg"), zero(ratio(F.col("dcg_exp"), ideal(lambda v: F.pow(F.lit(2.0), v) - 1))).alias("ndcg_exp"),
    )


def checkpoint_ranking(matches: DataFrame, totals: DataFrame, ks: list[int]) -> DataFrame:
    """Per (query_id, k): recall and nDCG where gold counts once, at the first rank that matches it, and ranks 1 and 2 are not discounted.

    matches: (query_id, rank, gold_no); totals: (query_id, n_gold).
    """
    first = matches.groupBy("query_id", "gold_no").agg(F.min("rank").alias("rank"))
    at = first.groupBy("query_id", "rank").agg(F.count("*").alias("n"))
    weight = lambda rank: F.when(rank <= 2, 1.0).otherwise(1.0 / F.log2(rank))
    per = at.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("query_id", "k").agg(F.sum("n").alias("covered"), F.sum(weight(F.col("rank"))).alias("dcg"))
    x = totals.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(per, ["query_id", "k"], "left")
    best = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", "k")).cast("int")), lambda i: weight(i)), F.lit(0.0), lambda s, v: s + v)
    none = F.col("n_gold") == 0
    return x.select("query_id", "k", F.when(none, 0.0).otherwise(F.coalesce(F.col("covered") / F.col("n_gold"), F.lit(0.0))).alias("recall"), F.when(none, 0.0).otherwise(F.coalesce(F.col("dcg") / best, F.lit(0.0))).alias("ndcg"))


def match_gold(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs (query_id, rank, gold_no) where an item is a gold point: equal id, id named in the text, session in the item's sources, normalised containment, or 75 % of the gold's tokens.

    items: (query_id, rank, item_id, text, sessions array); gold: (query_id, gold_no, gold_id, session, content).
    """
    plain = lambda x: F.array_join(words(F.coalesce(x, F.lit("")), "a-z0-9"), " ")
    i = items.withColumn("norm", plain(F.col("text"))).alias("i")
    g = gold.withColumn("norm", plain(F.col("content"))).withColumn("bag", F.array_distinct(F.filter(F.split("norm", " "), lambda x: x != ""))).alias("g")
    share = F.size(F.array_intersect(F.col("g.bag"), F.split("i.norm", " "))) / F.size("g.bag")
    by_text = (F.col("g.norm") != "") & (F.col("i.norm") != "") & (F.col("i.norm").contains(F.col("g.norm")) | (share >= 0.75))
    by_id = (F.col("i.item_id") == F.col("g.gold_id")) | ((F.col("g.gold_id") != "") & F.lower(F.concat_ws("\n", "i.item_id", "i.text")).contains(F.lower("g.gold_id")))
    cond = by_id | F.coalesce(F.array_contains("i.sessions", F.col("g.session")), F.lit(False)) | by_text
    return i.join(g, (F.col("i.query_id") == F.col("g.query_id")) & cond).select("i.query_id", "i.rank", "g.gold_no")


def provenance_hit(groups: Column | str, clues: Column | str, k: int) -> Column:
    """Whether one of the first ``k`` groups of ids meets the clues."""
    return F.exists(F.slice(c(groups), 1, k), lambda g: F.arrays_overlap(g, c(clues)))


def recall_any(hits: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with any relevant item in the first k: hits (query_id, rank, relevant)."""
    per = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return per.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")).alias("recall"))


def weighted_recall(points: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and importance-weighted recall of points (by.., covered, importance); all-zero weights count as equal."""
    some = F.max(F.coalesce("importance", F.lit(0.0))).over(Window.partitionBy(*by)) > 0
    x = points.withColumn("w", F.when(some, F.coalesce("importance", F.lit(0.0))).otherwise(1.0))
    return x.groupBy(*by).agg(F.avg(F.col("covered").cast("double")).alias("recall"), ratio(F.sum(F.when(F.col("covered"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("weighted_recall"))


def session_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of labels per group: rows (by.., kind in memory/update/interference, label)."""
    n = lambda kind, *labels: F.count_if((F.col("kind") == kind) & (F.col("label").isin(*labels) if labels else F.lit(True)))
    total = n("memory")
    share = lambda label: F.coalesce(ratio(n("memory", label), total), F.lit(0.0))
    return rows.groupBy(*by).agg(share("correct").alias("correct_rate"), share("hallucination").alias("hallucination_rate"), share("error").alias("error_rate"), ratio(n("update", "updated") + 0.5 * n("update", "both"), n("update")).alias("update_score"), ratio(n("interference", "rejected"), n("interference")).alias("interference_score"))


def clue_hits(selected: Column | str, clues: Column | str) -> Column:
    return F.size(F.array_intersect(c(selected), c(clues)))


def robustness(logic: str, truth: str, verdict: str, on_true: str, on_false: str, reserve: str, unknowable_kinds: list[str]) -> Column:
    """Struct (accuracy, robustness, wealth, prudent). On unknowable questions (those whose ``logic`` is one of the kinds) only UNKNOWN is right; a wrong UNKNOWN costs 0.2, any other wrong verdict 1; stakes are normalised to 100 and pay double on the truth."""
    said = F.upper(c(verdict))
    said = F.when(said.contains("TRUE"), "TRUE").when(said.contains("FALSE"), "FALSE").otherwise("UNKNOWN")
    gold = F.upper(c(truth))
    unknowable = c(logic).isin(unknowable_kinds)
    right = F.when(unknowable, said == "UNKNOWN").otherwise(said == gold)
    total = c(on_true) + c(on_false) + c(reserve)
    part = lambda x, empty: F.when(total > 0, 100.0 * c(x) / total).otherwise(empty)
    safe = part(reserve, 100.0)
    won = F.when(unknowable, 0.0).when(gold == "TRUE", 2 * part(on_true, 0.0)).when(gold == "FALSE", 2 * part(on_false, 0.0)).otherwise(0.0)
    score = F.when(right, 1.0).when((said == "UNKNOWN") & ~unknowable, -0.2).otherwise(-1.0)
    return F.struct(right.cast("double").alias("accuracy"), score.alias("robustness"), (safe + won).alias("wealth"), (unknowable & (safe > 80)).cast("double").alias("prudent"))


def gold_visibility(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per question the gold sessions that are visible, lie after the checkpoint, or are unknown: questions (question_id, checkpoint, gold array), sessions (session, ordinal)."""
    g = questions.select("question_id", "checkpoint", F.explode_outer(F.array_distinct("gold")).alias("session")).join(sessions, "session", "left")
    count = lambda cond: F.count_if(F.col("session").isNotNull() & cond)
    return g.groupBy("question_id").agg(count(F.col("ordinal") <= F.col("checkpoint")).alias("n_visible"), count(F.col("ordinal") > F.col("checkpoint")).alias("n_future"), count(F.col("ordinal").isNull()).alias("n_unmapped"))
