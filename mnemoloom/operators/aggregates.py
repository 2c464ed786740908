"""Grouped quality, cost and latency summaries. Means of nothing are 0 in A1-style summaries, null elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import ratio
from mnemoloom.session import stage


def summarize(df: DataFrame, metrics: list[str], sets: list[list[str]]) -> DataFrame:
    """Means per grouping set (``[]`` is overall), empty means 0; columns not in a set are null."""
    every = list(dict.fromkeys(x for s in sets for x in s))
    return df.groupingSets([[F.col(x) for x in s] for s in sets], *every).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics))


def qa_breakdown(df: DataFrame, by: str) -> DataFrame:
    """Overall and by type (``UNKNOWN`` without): label ratios over valid labels, mean recall, and omissions although evidence was retrieved."""
    x = df.withColumn(by, F.coalesce(by, F.lit("UNKNOWN")))
    valid = F.col("label").isin("correct", "hallucination", "omission")
    n = F.count_if(valid)
    share = lambda v: ratio(F.count_if(F.col("label") == v), n)
    missed = ratio(F.count_if((F.col("label") == "omission") & (F.col("recall") > 0)), F.count_if(F.col("label") == "omission"))
    return x.groupingSets([[], [F.col(by)]], by).agg(F.count("*").alias("n"), n.alias("n_valid"), share("correct").alias("correct"), share("hallucination").alias("hallucination"), share("omission").alias("omission"), F.avg("recall").alias("recall"), missed.alias("omitted_despite_retrieval"))


def aggregate_sessions(df: DataFrame) -> DataFrame:
    """Sessions pooled both ways: the mean of their ratios, and the ratio of their sums."""
    return df.agg(F.count("*").alias("n_sessions"), F.avg(ratio(F.col("covered"), F.col("total"))).alias("mean_of_ratios"), ratio(F.sum("covered"), F.sum("total")).alias("ratio_of_sums"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"))


def cell_matrix(df: DataFrame, ident: str, xs: str, ys: str, score: str) -> DataFrame:
    """Means per x, per y and per cell of rows that carry arrays of x and y values; a row counts once for each distinct x, y and cell."""
    x = df.select(ident, score, F.explode(F.array_distinct(xs)).alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.avg(score).alias("mean")).withColumn("y", F.lit(None).cast("string"))
    y = df.select(ident, score, F.explode(F.array_distinct(ys)).alias("y")).groupBy("y").agg(F.count("*").alias("n"), F.avg(score).alias("mean")).withColumn("x", F.lit(None).cast("string"))
    cells = df.select(ident, score, F.explode(F.array_distinct(xs)).alias("x"), ys).select(ident, score, "x", F.explode(F.array_distinct(ys)).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    tag = lambda d, axis: d.select(F.lit(axis).alias("axis"), "x", "y", "n", "mean")
    return tag(x, "x").unionByName(tag(y, "y")).unionByName(tag(cells, "cell"))


def position_accuracy(df: DataFrame, rotations: str) -> DataFrame:
    """Accuracy by the place of the right option, over exploded (position, correct) rotations."""
    return df.select(F.explode(rotations).alias("r")).groupBy("r.position").agg(F.count("*").alias("n"), F.avg(F.col("r.correct").cast("double")).alias("accuracy"))


#: Rank error of the sketches that bracket a quantile, as a share of the group.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Interpolated quantiles of ``value`` in each group (nulls are none): (by.., a column for each name in ``shares``), exact whatever a group's size.

    A mergeable sketch brackets the two order statistics that a quantile lies between; a second pass counts what is below the bracket, combined
    before its shuffle, and the values inside it, one row for each distinct value; running counts name the two. Groups whose sketch missed are
    done again with all their values in the bracket. Only what lies in a bracket is ever sorted: about 6 / ``accuracy`` of a group, and equal values are one row.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = df.where(F.col(value).isNotNull()).select(key.alias("k"), F.col(value).cast("double").alias("v"))
    names, slack = list(shares), 3.0 / accuracy
    edges = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-slack, slack)]
    sketch = rows.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("v", edges, accuracy).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    sketch = stage(sketch, "quantile-brackets")
    brackets = lambda low, high: F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.lit(float(p)).alias("p"), low(i).alias("low"), high(i).alias("high")) for i, (m, p) in enumerate(shares.items()))))
    asked = sketch.select("k", "n", brackets(lambda i: F.col("e")[2 * i], lambda i: F.col("e")[2 * i + 1]).alias("b")).select("k", "n", "b.*")

    def settled(asked: DataFrame) -> DataFrame:
        met = rows.join(asked.select("k", "name", "low", "high"), "k")
        below = met.groupBy("k", "name").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
        inside = met.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).groupBy("k", "name", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("k", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = inside.withColumn("upto", upto).join(asked.select("k", "name", "n", "p"), ["k", "name"]).join(below, ["k", "name"])
        at = F.col("p") * (F.col("n") - 1)
        holds = lambda rank: F.when((F.col("below") + F.col("upto") > rank) & (F.col("below") + F.col("upto") - F.col("c") <= rank), F.col("v"))
        found = placed.groupBy("k", "name").agg(F.max(holds(F.floor(at))).alias("x"), F.max(holds(F.ceil(at))).alias("y"), F.first(at - F.floor(at)).alias("part"))
        return found.select("k", "name", (F.col("x") + F.col("part") * (F.col("y") - F.col("x"))).alias("q"))

    done = stage(settled(asked), "quantiles")
    missed = asked.select("k", "name").join(done.where("q is not null"), ["k", "name"], "left_anti")
    if not missed.isEmpty():
        whole = sketch.select("k", "n", brackets(lambda i: F.col("least"), lambda i: F.col("most")).alias("b")).select("k", "n", "b.*").join(missed, ["k", "name"], "left_semi")
        done = done.where("q is not null").unionByName(settled(whole))
    wide = done.groupBy("k").agg(*(F.max(F.when(F.col("name") == m, F.col("q"))).alias(m) for m in names))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return groups.withColumn("k", F.to_json(F.struct(*by)) if by else F.lit("")).join(wide, "k", "left").drop("k")


def _with_quantiles(means: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """Joined on keys that may be null."""
    x, y = means.alias("x"), quantiles.alias("y")
    if not by:
        return x.crossJoin(y)
    return x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]).drop(*(F.col(f"y.{c}") for c in by))


def describe_metrics(df: DataFrame, metrics: list[str], by: list[str], ddof: int = 0) -> DataFrame:
    """Mean, deviation, least, largest and median of each metric; a single value deviates by 0."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    x = df.select(*by, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    std = F.stddev_pop("value") if ddof == 0 else F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    means = x.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), std.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return _with_quantiles(means, exact_quantiles(x, [*by, "metric"], "value", {"median": 0.5}), [*by, "metric"])


def compare_methods(df: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per method, and whether the method is its best (first by name on ties)."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    means = df.select(method, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")).groupBy("metric", method).agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("metric").orderBy(F.desc("mean"), method)
    return means.withColumn("best", F.row_number().over(w) == 1)


def pool_results(df: DataFrame, lists: str, by: str) -> DataFrame:
    """Micro average of per-row lists of scores, overall and by category."""
    x = df.select(by, F.explode(lists).alias("value"))
    return x.groupingSets([[], [F.col(by)]], by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def judge_summary(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Judged rows per category against the expected counts: scores over rows without error; calls only where every row has them."""
    x = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("error")).alias("valid"), F.avg(F.when(~F.col("error"), F.col("score"))).alias("score"), F.when(F.count("calls") == F.count("*"), F.sum("calls")).alias("calls"))
    y = expected.join(x, by, "left").fillna(0, ["n", "valid"])
    return y.select(by, "expected", "n", "valid", "score", F.col("score").alias("accuracy"), ratio(F.col("valid"), F.col("n")).alias("coverage"), ratio(F.col("n"), F.col("expected")).alias("completion"), (F.col("n") < F.col("expected")).alias("provisional"), "calls")


def merge_judge(metrics: DataFrame, judge: DataFrame, by: str) -> DataFrame:
    """Judge scores beside the metrics of the same category, null where the judge is provisional."""
    return metrics.join(judge.select(by, "score", "provisional"), by, "full").select(by, *[x for x in metrics.columns if x != by], F.when(~F.col("provisional"), F.col("score")).alias("judge"))


def size_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Counts, failures (null values), mean, deviation, median and interpolated 95th percentile; groups without a value stay."""
    means = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("failed"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _with_quantiles(means, exact_quantiles(df, by, value, {"median": 0.5, "p95": 0.95}), by)


def compare_sizes(items: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """Totals and means of item sizes against the sums of their parts: items (item, size, by), parts (item, size)."""
    p = parts.groupBy("item").agg(F.sum("size").alias("parts"), F.count("*").alias("n_parts"))
    x = items.join(p, "item", "left").withColumn("delta", F.col("parts") - F.col("size"))
    sums = x.groupBy(by).agg(F.count("*").alias("n"), F.count("parts").alias("matched"), F.sum("size").alias("items_total"), F.sum("parts").alias("parts_total"), F.avg("delta").alias("mean_delta"), ratio(100.0 * (F.sum("size") - F.sum("parts")), F.sum("size")).alias("saving_percent"))
    return _with_quantiles(sums, exact_quantiles(x, [by], "delta", {"median_delta": 0.5}), [by])


def token_cost(calls: DataFrame, by: str, price_in: float, price_out: float) -> DataFrame:
    """Price of all calls per distinct sample; unavailable, with a reason, where any usage is missing."""
    missing = F.count_if(F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull())
    total = F.sum(F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6
    n = F.countDistinct("sample_id")
    return calls.groupBy(by).agg(n.alias("samples"), F.when(missing == 0, total).alias("total"), F.when(missing == 0, total / n).alias("per_sample"), F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" calls without usage"))).alias("reason"))


def modelled_latency(calls: DataFrame, by: list[str], base: float, per_in: float, per_out: float, per_image: float) -> DataFrame:
    """base per call + a rate per input token, output token and image, per distinct sample."""
    seconds = F.count("*") * base + F.sum(F.coalesce("prompt_tokens", F.lit(0))) * per_in + F.sum(F.coalesce("completion_tokens", F.lit(0))) * per_out + F.sum("image_count") * per_image
    return calls.groupBy(*by).agg(seconds.alias("seconds"), (seconds / F.countDistinct("sample_id")).alias("per_sample"))


def combine_components(parts: list[Column]) -> Column:
    """Sum that is null if any part is."""
    return reduce(lambda a, b: a + b, parts)


def call_summary(calls: DataFrame, by: str) -> DataFrame:
    n, samples = F.count("*"), F.countDistinct("sample_id")
    failed = F.count_if(F.col("failed"))
    return calls.groupBy(by).agg(n.alias("calls"), failed.alias("failed"), (n - failed).alias("succeeded"), (n / samples).alias("per_sample"), (n - samples).alias("retries"))


def context_tokens(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieved tokens over all queries, those without hits too."""
    per = queries.select("query_id").join(hits.groupBy("query_id").agg(F.sum("tokens").alias("tokens")), "query_id", "left")
    return per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.count("*").alias("queries"), F.round(F.sum(F.coalesce("tokens", F.lit(0))) / F.count("*"), 2).alias("mean"))


def summary_chars(memories: DataFrame) -> DataFrame:
    return memories.where("status = 'ACTIVE'").groupBy("bank").agg(F.sum(F.length("summary")).alias("chars"), F.count("*").alias("n"))


def mask_distribution(df: DataFrame, mask: str, bits: int = 5) -> DataFrame:
    """All 2**bits masks with count and share (absent: 0)."""
    every = df.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("mask"))
    got = df.groupBy(F.col(mask).cast("int").alias("mask")).agg(F.count("*").alias("n"))
    x = every.join(got, "mask", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # 2**bits rows
    return x.withColumn("share", F.col("n") / total)


def mask_marginals(df: DataFrame, mask: str, bits: int = 5) -> DataFrame:
    """Share of rows with each bit set."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.getbit(F.col(mask).cast("long"), F.lit(i)).alias("on")) for i in range(bits)))).alias("b")).groupBy("b.bit").agg(F.avg("b.on").alias("share"))


def critic_diagnostics(df: DataFrame, value: str, reward: str, by: str) -> DataFrame:
    """Mean absolute error and explained variance 1 - Var(error) / Var(reward), 0 where the rewards do not vary."""
    e = F.col(reward) - F.col(value)
    return df.groupBy(by).agg(F.avg(F.abs(e)).alias("mae"), F.when(F.var_pop(reward) > 1e-8, 1 - F.var_pop(e) / F.var_pop(reward)).otherwise(0.0).alias("explained_variance"))


def frontier(df: DataFrame) -> DataFrame:
    """Points (lam, cost, quality) by cost; a lambda that occurs twice is an error."""
    n = F.count("*").over(Window.partitionBy("lam"))
    return df.withColumn("lam", F.when(n > 1, F.raise_error(F.lit("repeated lambda"))).otherwise(F.col("lam"))).orderBy("cost", "lam")


def reconcile_events(df: DataFrame) -> DataFrame:
    """One row per (epoch, step, metric): a missing step is the epoch's last; equal rows fold, different values are an error."""
    last = F.max("step").over(Window.partitionBy("epoch"))
    x = df.withColumn("step", F.coalesce("step", last)).distinct().groupBy("epoch", "step", "metric").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    return x.select("epoch", "step", "metric", F.when(F.col("n") > 1, F.raise_error(F.lit("conflicting values"))).otherwise(F.col("value")).alias("value"))


def explode_attempts(results: DataFrame) -> DataFrame:
    """One row per attempt: the first ``failures`` failed; usage belongs to the last; skipped samples give none."""
    x = results.where((F.col("attempts") > 0) & ~F.col("skipped")).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("attempts").cast("int"))))
    return x.select("sample_id", "attempt", (F.col("attempt") <= F.col("failures")).alias("failed"), F.when(F.col("attempt") == F.col("attempts"), F.col("tokens")).alias("tokens"))


def score_table(df: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.round(F.avg(score), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


def binary_entropy(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def paired_entropy(a: DataFrame, b: DataFrame, key: str, by: str, margin: float = 0.1) -> DataFrame:
    """Two runs per event, (key, by, confidence): mean entropies, relative difference 2 (ha - hb) / (ha + hb), shares of events where one run is surer."""
    x = a.select(key, by, binary_entropy(F.col("confidence")).alias("ha")).join(b.select(key, binary_entropy(F.col("confidence")).alias("hb")), key)
    x = x.withColumn("delta", 2 * (F.col("ha") - F.col("hb")) / (F.col("ha") + F.col("hb")))
    share = lambda cond: F.avg(cond.cast("double"))
    return x.groupBy(by).agg(F.count("*").alias("n"), F.avg("ha").alias("entropy_a"), F.avg("hb").alias("entropy_b"), F.avg("delta").alias("delta"), share(F.col("delta") > margin).alias("b_surer"), share(F.col("delta") < -margin).alias("a_surer"))


def flip_rates(df: DataFrame, by: str) -> DataFrame:
    """Wrong answers put right, and right ones spoilt, between two steps: df (first, second) as booleans."""
    return df.groupBy(by).agg(ratio(F.count_if(~F.col("first") & F.col("second")), F.count_if(~F.col("first"))).alias("corrected"), ratio(F.count_if(F.col("first") & ~F.col("second")), F.count_if(F.col("first"))).alias("spoilt"))


def quadrants(df: DataFrame, by: str) -> DataFrame:
    """Among first-step errors the four cases of high wager and confession."""
    x = df.where(~F.col("first"))
    return x.groupBy(by, "high_wager", "confessed").agg(F.count("*").alias("n"))


def combine_calls(parts: list[DataFrame], names: list[str], key: str) -> DataFrame:
    """Sum over parts (key, calls, samples), unavailable with its reasons if one is missing or sample counts differ."""
    x = parts[0].select(key, F.struct("calls", "samples").alias(names[0]))
    for p, n in zip(parts[1:], names[1:], strict=True):
        x = x.join(p.select(key, F.struct("calls", "samples").alias(n)), key, "full")
    missing = [F.when(F.col(f"{n}.calls").isNull(), F.lit(f"{n} unavailable")) for n in names]
    samples = F.array_distinct(F.array_compact(F.array(*(F.col(f"{n}.samples") for n in names))))
    differ = F.when(F.size(samples) > 1, F.lit("sample counts differ"))
    reason = F.concat_ws("; ", *missing, differ)
    total = combine_components([F.col(f"{n}.calls") for n in names])
    return x.select(key, F.when(reason == "", total).alias("calls"), F.nullif(reason, F.lit("")).alias("reason"))
