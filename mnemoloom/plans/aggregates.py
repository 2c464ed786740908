"""Queries for aggregates and the life cycle: events as calls and scores, labels as judged answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions.columns import r6
from mnemoloom.operators import aggregates as A
from mnemoloom.operators import lifecycle as L
from mnemoloom.plans.registry import query
from mnemoloom.session import table

NOW = "2024-06-01"


def rounded(df, *cols):
    return df.withColumns({x: r6(x) for x in cols})


def calls(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("user_id") % 40).alias("sample_id"), F.col("event_type").alias("phase"), (F.col("event_type") == "error").alias("failed"), k.alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), (F.col("event_id") % 3).alias("image_count"), "user_id", "event_id", "value")


CALLS = "c AS (SELECT user_id % 40 AS sample_id, event_type AS phase, event_type = 'error' AS failed, (props::JSON ->> 'k')::BIGINT AS prompt_tokens, event_id % 50 AS completion_tokens, event_id % 3 AS image_count, user_id, event_id, value FROM events)"


@query("SELECT lang, count(*) AS n, round(coalesce(avg(quality), 0), 6)::DOUBLE AS quality, round(coalesce(avg(toxic), 0), 6)::DOUBLE AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def a1_summarize(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rounded(A.summarize(x, ["quality", "toxic"], [[], ["lang"]]), "quality", "toxic")


@query("SELECT lang, source, count(*) AS n, round(coalesce(avg(quality), 0), 6)::DOUBLE AS quality FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))")
def a2_summarize_sets(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rounded(A.summarize(x, ["quality"], [[], ["lang"], ["source"]]), "quality")


@query("""WITH x AS (SELECT coalesce(CASE WHEN user_id % 7 > 0 THEN event_type END, 'UNKNOWN') AS kind, ['correct', 'hallucination', 'omission', 'bad'][event_id % 4 + 1] AS label, (event_id % 5) / 4.0 AS recall FROM events)
    SELECT kind, count(*) AS n, count(*) FILTER (label <> 'bad') AS n_valid, round(count(*) FILTER (label = 'correct') / nullif(count(*) FILTER (label <> 'bad'), 0), 6)::DOUBLE AS correct, round(count(*) FILTER (label = 'hallucination') / nullif(count(*) FILTER (label <> 'bad'), 0), 6)::DOUBLE AS hallucination,
    round(count(*) FILTER (label = 'omission') / nullif(count(*) FILTER (label <> 'bad'), 0), 6)::DOUBLE AS omission, round(avg(recall), 6)::DOUBLE AS recall, round(count(*) FILTER (label = 'omission' AND recall > 0) / nullif(count(*) FILTER (label = 'omission'), 0), 6)::DOUBLE AS omitted_despite_retrieval FROM x GROUP BY GROUPING SETS ((), (kind))""")
def a3_qa_breakdown(spark, d):
    names = F.array(*map(F.lit, ["correct", "hallucination", "omission", "bad"]))
    x = table(spark, d, "events").select(F.when(F.col("user_id") % 7 > 0, F.col("event_type")).alias("kind"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("label"), (F.col("event_id") % 5 / 4.0).alias("recall"))
    return rounded(A.qa_breakdown(x, "kind"), "correct", "hallucination", "omission", "recall", "omitted_despite_retrieval")


@query("WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS covered, count(*) AS total, sum(value) AS seconds, count(*) * 3 AS tokens FROM events GROUP BY 1) SELECT count(*) AS n_sessions, round(avg(covered / total), 6) AS mean_of_ratios, round(sum(covered) / sum(total), 6) AS ratio_of_sums, round(sum(seconds), 3) AS seconds, sum(tokens)::BIGINT AS tokens FROM s")
def a4_aggregate_sessions(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("covered"), F.count("*").alias("total"), F.sum("value").alias("seconds"), (F.count("*") * 3).alias("tokens"))
    return rounded(A.aggregate_sessions(s), "mean_of_ratios", "ratio_of_sums").withColumn("seconds", F.round("seconds", 3))


@query("""WITH r AS (SELECT event_id, value, list_distinct(['x' || event_id % 3, 'x' || event_id % 2]) AS xs, list_distinct(['y' || event_id % 4, 'y' || event_id % 5]) AS ys FROM events), x AS (SELECT event_id, value, unnest(xs) AS x FROM r), y AS (SELECT event_id, value, unnest(ys) AS y FROM r), b AS (SELECT event_id, value, unnest(xs) AS x, ys FROM r), c AS (SELECT event_id, value, x, unnest(ys) AS y FROM b)
    SELECT 'x' AS axis, x, NULL AS y, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY 2 UNION ALL SELECT 'y', NULL, y, count(*), round(avg(value), 6) FROM y GROUP BY 3 UNION ALL SELECT 'cell', x, y, count(*), round(avg(value), 6) FROM c GROUP BY 2, 3""")
def a5_cell_matrix(spark, d):
    tag = lambda p, n: F.concat(F.lit(p), (F.col("event_id") % n).cast("string"))
    r = table(spark, d, "events").select("event_id", "value", F.array(tag("x", 3), tag("x", 2)).alias("xs"), F.array(tag("y", 4), tag("y", 5)).alias("ys"))
    return rounded(A.cell_matrix(r, "event_id", "xs", "ys", "value"), "mean")


@query("WITH r AS (SELECT event_id, unnest([0, 1, 2, 3]) AS position FROM events) SELECT position::INT AS position, count(*) AS n, round(avg(((event_id + position) % 3 = 0)::INT), 6)::DOUBLE AS accuracy FROM r GROUP BY 1")
def a6_position_accuracy(spark, d):
    r = F.array(*(F.struct(F.lit(i).alias("position"), ((F.col("event_id") + i) % 3 == 0).alias("correct")) for i in range(4)))
    return rounded(A.position_accuracy(table(spark, d, "events").select(r.alias("rotations")), "rotations"), "accuracy")


@query("""WITH x AS (SELECT event_type, 'value' AS metric, value FROM events UNION ALL SELECT event_type, 'other', (event_id % 17)::DOUBLE FROM events) SELECT event_type, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM x GROUP BY 1, 2""")
def a7_describe_metrics(spark, d):
    x = table(spark, d, "events").withColumn("other", (F.col("event_id") % 17).cast("double"))
    return rounded(A.describe_metrics(x, ["value", "other"], ["event_type"]), "mean", "std", "median")


@query("""WITH m AS (SELECT event_type, 'value' AS metric, avg(value) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'other', avg((event_id % 17)::DOUBLE) FROM events GROUP BY 1) SELECT event_type, metric, round(mean, 6) AS mean, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, event_type) = 1 AS best FROM m""")
def a8_compare_methods(spark, d):
    x = table(spark, d, "events").withColumn("other", (F.col("event_id") % 17).cast("double"))
    return rounded(A.compare_methods(x, "event_type", ["value", "other"]), "mean")


@query("WITH x AS (SELECT event_type, unnest([value, value * 2]) AS value FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY GROUPING SETS ((), (event_type))")
def a9_pool_results(spark, d):
    x = table(spark, d, "events").select("event_type", F.array(F.col("value"), F.col("value") * 2).alias("scores"))
    return rounded(A.pool_results(x, "scores", "event_type"), "mean")


JUDGED = """j AS (SELECT event_type, event_id % 11 = 0 AS error, (event_id % 3) / 2.0 AS score, CASE WHEN event_type <> 'click' OR event_id % 2 = 0 THEN 1 END AS calls FROM events), e AS (SELECT event_type, max(event_id) AS expected FROM events GROUP BY 1 UNION ALL SELECT 'never', 5),
    s AS (SELECT event_type, count(*) AS n, count(*) FILTER (NOT error) AS valid, avg(score) FILTER (NOT error) AS score, CASE WHEN count(calls) = count(*) THEN sum(calls) END AS calls FROM j GROUP BY 1)"""


def judged(spark, d):
    ev = table(spark, d, "events")
    j = ev.select("event_type", (F.col("event_id") % 11 == 0).alias("error"), (F.col("event_id") % 3 / 2.0).alias("score"), F.when((F.col("event_type") != "click") | (F.col("event_id") % 2 == 0), 1).alias("calls"))
    never = spark.createDataFrame([("never", 5)], "event_type string, expected long")
    return A.judge_summary(j, "event_type", ev.groupBy("event_type").agg(F.max("event_id").alias("expected")).unionByName(never))


@query(f"WITH {JUDGED} SELECT event_type, expected, coalesce(n, 0) AS n, coalesce(valid, 0) AS valid, round(score, 6)::DOUBLE AS score, round(score, 6)::DOUBLE AS accuracy, round(valid / nullif(n, 0), 6)::DOUBLE AS coverage, round(coalesce(n, 0) / expected, 6)::DOUBLE AS completion, coalesce(n, 0) < expected AS provisional, calls::BIGINT AS calls FROM e LEFT JOIN s USING (event_type)")
def a10_judge_summary(spark, d):
    return rounded(judged(spark, d), "score", "accuracy", "coverage", "completion")


@query(f"WITH {JUDGED}, m AS (SELECT event_type, round(avg(value), 6) AS f1 FROM events GROUP BY 1) SELECT event_type, f1, CASE WHEN coalesce(n, 0) >= expected THEN round(score, 6) END::DOUBLE AS judge FROM m FULL JOIN (SELECT * FROM e LEFT JOIN s USING (event_type)) USING (event_type)")
def a11_merge_judge(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("f1"))
    return rounded(A.merge_judge(m, judged(spark, d), "event_type"), "judge")


@query("SELECT lang, count(*) AS n, count(*) FILTER (v IS NULL) AS failed, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT lang, CASE WHEN doc_id % 9 > 0 THEN n_chars END AS v FROM documents) GROUP BY 1")
def a12_size_stats(spark, d):
    x = table(spark, d, "documents").withColumn("v", F.when(F.col("doc_id") % 9 > 0, F.col("n_chars")))
    return rounded(A.size_stats(x, "v", ["lang"]), "mean", "std", "median", "p95")


@query("""WITH p AS (SELECT l_orderkey AS item, sum(l_quantity::BIGINT) AS parts FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1), x AS (SELECT o_orderpriority, o_custkey AS size, parts, parts - o_custkey AS delta FROM orders LEFT JOIN p ON item = o_orderkey)
    SELECT o_orderpriority, count(*) AS n, count(parts) AS matched, sum(size)::BIGINT AS items_total, sum(parts)::BIGINT AS parts_total, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(100.0 * (sum(size) - sum(parts)) / sum(size), 6)::DOUBLE AS saving_percent FROM x GROUP BY 1""")
def a13_compare_sizes(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("size"), "o_orderpriority")
    parts = table(spark, d, "lineitem").where("l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("item"), F.col("l_quantity").cast("long").alias("size"))
    return rounded(A.compare_sizes(items, parts, "o_orderpriority"), "mean_delta", "median_delta", "saving_percent")


@query(f"WITH {CALLS}, x AS (SELECT phase, sample_id, CASE WHEN phase = 'click' AND event_id % 5 = 0 THEN NULL ELSE prompt_tokens END AS p, completion_tokens AS q FROM c) SELECT phase, count(DISTINCT sample_id) AS samples, round(CASE WHEN count(p) = count(*) THEN sum(p * 0.4 + q * 1.6) / 1e6 END, 9)::DOUBLE AS total, round(CASE WHEN count(p) = count(*) THEN sum(p * 0.4 + q * 1.6) / 1e6 END / count(DISTINCT sample_id), 9)::DOUBLE AS per_sample, CASE WHEN count(p) < count(*) THEN (count(*) - count(p)) || ' calls without usage' END AS reason FROM x GROUP BY 1")
def a14_token_cost(spark, d):
    c = calls(spark, d).withColumn("prompt_tokens", F.when(~((F.col("phase") == "click") & (F.col("event_id") % 5 == 0)), F.col("prompt_tokens")))
    return A.token_cost(c, "phase", 0.4, 1.6).withColumns({x: F.round(x, 9) for x in ("total", "per_sample")})


@query(f"WITH {CALLS} SELECT phase, round(count(*) * 0.5 + sum(prompt_tokens) * 0.001 + sum(completion_tokens) * 0.02 + sum(image_count) * 0.1, 6)::DOUBLE AS seconds, round((count(*) * 0.5 + sum(prompt_tokens) * 0.001 + sum(completion_tokens) * 0.02 + sum(image_count) * 0.1) / count(DISTINCT sample_id), 6)::DOUBLE AS per_sample FROM c GROUP BY 1")
def a15_modelled_latency(spark, d):
    return rounded(A.modelled_latency(calls(spark, d), ["phase"], 0.5, 0.001, 0.02, 0.1), "seconds", "per_sample")


@query(f"WITH {CALLS} SELECT event_id, prompt_tokens + completion_tokens + CASE WHEN event_id % 4 > 0 THEN image_count END AS total FROM c")
def a16_combine_components(spark, d):
    return calls(spark, d).select("event_id", A.combine_components([F.col("prompt_tokens"), F.col("completion_tokens"), F.when(F.col("event_id") % 4 > 0, F.col("image_count"))]).alias("total"))


@query(f"WITH {CALLS} SELECT phase, count(*) AS calls, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed) AS succeeded, round(count(*) / count(DISTINCT sample_id), 6)::DOUBLE AS per_sample, count(*) - count(DISTINCT sample_id) AS retries FROM c GROUP BY 1")
def a17_call_summary(spark, d):
    return rounded(A.call_summary(calls(spark, d), "phase"), "per_sample")


@query("WITH q AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, sum(event_id % 90) AS t FROM events WHERE event_type = 'purchase' AND user_id % 3 > 0 GROUP BY 1) SELECT coalesce(sum(t), 0)::BIGINT AS total, count(*) AS queries, round(sum(coalesce(t, 0)) / count(*), 2)::DOUBLE AS mean FROM q LEFT JOIN h USING (user_id)")
def a18_context_tokens(spark, d):
    e = table(spark, d, "events")
    hits = e.where("event_type = 'purchase' and user_id % 3 > 0").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 90).alias("tokens"))
    return A.context_tokens(hits, e.select(F.col("user_id").alias("query_id")).distinct())


@query("SELECT doc_id % 20 AS bank, sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents WHERE doc_id % 7 > 0 GROUP BY 1")
def a19_summary_chars(spark, d):
    m = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("bank"), F.col("text").alias("summary"), F.when(F.col("doc_id") % 7 > 0, "ACTIVE").otherwise("ARCHIVED").alias("status"))
    return A.summary_chars(m)


@query("WITH m AS (SELECT event_id * 7 % 29 AS mask FROM events) SELECT x::INT AS mask, count(m.mask) AS n, round(count(m.mask) / sum(count(m.mask)) OVER (), 6)::DOUBLE AS share FROM range(32) r(x) LEFT JOIN m ON mask = x GROUP BY 1")
def a20_mask_distribution(spark, d):
    return rounded(A.mask_distribution(table(spark, d, "events").select((F.col("event_id") * 7 % 29).alias("m")), "m"), "share")


@query("WITH m AS (SELECT event_id * 7 % 29 AS mask FROM events) SELECT b::INT AS bit, round(avg((mask >> b::INT) & 1), 6)::DOUBLE AS share FROM m, range(5) r(b) GROUP BY 1")
def a20_mask_marginals(spark, d):
    return rounded(A.mask_marginals(table(spark, d, "events").select((F.col("event_id") * 7 % 29).alias("m")), "m"), "share")


@query("SELECT event_type, round(avg(abs(value - (event_id % 50) * 1.0)), 6)::DOUBLE AS mae, round(CASE WHEN var_pop(value) > 1e-8 THEN 1 - var_pop(value - (event_id % 50) * 1.0::DOUBLE) / var_pop(value) ELSE 0 END, 6)::DOUBLE AS explained_variance FROM events GROUP BY 1")
def a21_critic_diagnostics(spark, d):
    e = table(spark, d, "events").withColumn("guess", (F.col("event_id") % 50).cast("double"))
    return rounded(A.critic_diagnostics(e, "guess", "value", "event_type"), "mae", "explained_variance")


@query("SELECT user_id / 100.0::DOUBLE AS lam, round(sum(value), 3) AS cost, round(avg(value), 6) AS quality FROM events GROUP BY user_id")
def a22_frontier(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") / 100.0).alias("lam")).agg(F.round(F.sum("value"), 3).alias("cost"), r6(F.avg("value")).alias("quality"))
    return A.frontier(e)


@query("""WITH r AS (SELECT user_id AS epoch, CASE WHEN event_id % 6 > 0 THEN event_id // 6 END AS step, 'loss' AS metric FROM events), l AS (SELECT *, coalesce(step, max(step) OVER (PARTITION BY epoch)) AS s FROM r) SELECT DISTINCT epoch, s AS step, metric, (epoch + s)::DOUBLE AS value FROM l""")
def a23_reconcile_events(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("epoch"), F.when(F.col("event_id") % 6 > 0, F.floor(F.col("event_id") / 6)).alias("step"), F.lit("loss").alias("metric"))
    last = F.max("step").over(Window.partitionBy("epoch"))
    return A.reconcile_events(e.withColumn("value", (F.col("epoch") + F.coalesce("step", last)).cast("double")))


@query("WITH r AS (SELECT event_id AS sample_id, event_id % 4 AS attempts, event_id % 3 AS failures, event_id % 10 = 9 AS skipped, event_id % 100 AS tokens FROM events), x AS (SELECT *, unnest(range(1, attempts + 1)) AS attempt FROM r WHERE NOT skipped) SELECT sample_id, attempt::INT AS attempt, attempt <= failures AS failed, CASE WHEN attempt = attempts THEN tokens END AS tokens FROM x")
def a24_explode_attempts(spark, d):
    i = F.col("event_id")
    return A.explode_attempts(table(spark, d, "events").select(i.alias("sample_id"), (i % 4).alias("attempts"), (i % 3).alias("failures"), (i % 10 == 9).alias("skipped"), (i % 100).alias("tokens")))


@query("SELECT user_id % 10 AS dataset, round(avg(value) FILTER (event_type = 'click'), 4) AS click_mean, count(*) FILTER (event_type = 'click') AS click_n, round(avg(value) FILTER (event_type = 'error'), 4) AS error_mean, count(*) FILTER (event_type = 'error') AS error_n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def a25_score_table(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'error')").withColumn("dataset", F.col("user_id") % 10)
    return A.score_table(e, "dataset", "event_type", ["click", "error"], "value").fillna(0, ["click_n", "error_n"])


ENTROPY = "(-({0} * log2({0}) + (1 - {0}) * log2(1 - {0})))"


@query(f"""WITH p AS (SELECT event_id, event_type, greatest(1e-6, least(1 - 1e-6, (event_id % 100) / 100.0::DOUBLE)) AS a, greatest(1e-6, least(1 - 1e-6, (event_id % 37) / 37.0::DOUBLE)) AS b FROM events), h AS (SELECT event_type, {ENTROPY.format('a')} AS ha, {ENTROPY.format('b')} AS hb FROM p), x AS (SELECT *, 2 * (ha - hb) / (ha + hb) AS delta FROM h)
    SELECT event_type, count(*) AS n, round(avg(ha), 6) AS entropy_a, round(avg(hb), 6) AS entropy_b, round(avg(delta), 6) AS delta, round(avg((delta > 0.1)::INT), 6) AS b_surer, round(avg((delta < -0.1)::INT), 6) AS a_surer FROM x GROUP BY 1""")
def a26_paired_entropy(spark, d):
    e = table(spark, d, "events")
    a = e.select("event_id", "event_type", (F.col("event_id") % 100 / 100.0).alias("confidence"))
    b = e.select("event_id", "event_type", (F.col("event_id") % 37 / 37.0).alias("confidence"))
    return rounded(A.paired_entropy(a, b, "event_id", "event_type"), "entropy_a", "entropy_b", "delta", "b_surer", "a_surer")


def steps(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_type", (i % 3 == 0).alias("first"), (i % 4 == 0).alias("second"), (i % 5 > 2).alias("high_wager"), (i % 7 == 0).alias("confessed"))


@query("WITH s AS (SELECT event_type, event_id % 3 = 0 AS a, event_id % 4 = 0 AS b FROM events) SELECT event_type, round(count(*) FILTER (NOT a AND b) / nullif(count(*) FILTER (NOT a), 0), 6)::DOUBLE AS corrected, round(count(*) FILTER (a AND NOT b) / nullif(count(*) FILTER (a), 0), 6)::DOUBLE AS spoilt FROM s GROUP BY 1")
def a27_flip_rates(spark, d):
    return rounded(A.flip_rates(steps(spark, d), "event_type"), "corrected", "spoilt")


@query("SELECT event_type, event_id % 5 > 2 AS high_wager, event_id % 7 = 0 AS confessed, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2, 3")
def a27_quadrants(spark, d):
    return A.quadrants(steps(spark, d), "event_type")


@query("""WITH b AS (SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS samples FROM events GROUP BY 1), r AS (SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS samples FROM events WHERE user_id % 4 > 0 AND event_id % 2 = 0 GROUP BY 1),
    x AS (SELECT user_id, b.calls AS bc, r.calls AS rc, concat_ws('; ', CASE WHEN b.calls IS NULL THEN 'build unavailable' END, CASE WHEN r.calls IS NULL THEN 'retrieval unavailable' END, CASE WHEN b.samples <> r.samples THEN 'sample counts differ' END) AS reason FROM b FULL JOIN r USING (user_id)) SELECT user_id, CASE WHEN reason = '' THEN bc + rc END AS calls, nullif(reason, '') AS reason FROM x""")
def a28_combine_calls(spark, d):
    e = table(spark, d, "events")
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("samples"))
    return A.combine_calls([count(e), count(e.where("user_id % 4 > 0 and event_id % 2 = 0"))], ["build", "retrieval"], "user_id")


# Life cycle: one memory per user.
M = "m AS (SELECT user_id AS memory_id, max(value) / 1000 AS base, min(ts) AS created, max(ts) AS accessed, count(*) AS uses, count(DISTINCT event_type) AS links, user_id % 12 AS entities FROM events GROUP BY 1)"
IMP = f"{M}, i AS (SELECT *, 0.2 * base + 0.15 * 0.95 ** ((epoch(TIMESTAMP '{NOW}') - floor(epoch(created))) / 86400) + 0.15 * 0.95 ** ((epoch(TIMESTAMP '{NOW}') - floor(epoch(accessed))) / 86400) + 0.3 * least(ln(1 + uses) / 5, 1) + 0.2 * least(links / 3, 1) + 0.2 * least(entities / 10, 1) AS importance FROM m)"


def memories(spark, d):
    m = table(spark, d, "events").groupBy(F.col("user_id").alias("memory_id")).agg((F.max("value") / 1000).alias("base"), F.min("ts").alias("created"), F.max("ts").alias("accessed"), F.count("*").alias("uses"), F.countDistinct("event_type").alias("links"))
    m = m.withColumn("entities", F.col("memory_id") % 12)
    now = F.to_timestamp(F.lit(NOW))
    return m.withColumn("importance", L.importance("base", "created", "accessed", "uses", "links", "entities", now)).withColumns({"strength": F.lit(1.0), "status": F.lit("ACTIVE")})


@query(f"WITH {IMP} SELECT memory_id, round(importance, 6)::DOUBLE AS importance FROM i")
def l1_importance(spark, d):
    return memories(spark, d).select("memory_id", r6("importance").alias("importance"))


@query(f"WITH {IMP} SELECT memory_id, CASE WHEN importance < 0.55 THEN 'archive' WHEN importance > 0.7 THEN 'strengthen' ELSE 'keep' END AS action, CASE WHEN importance > 0.7 THEN 1.1 ELSE 1.0 END::DOUBLE AS strength, CASE WHEN importance < 0.55 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM i")
def l2_consolidate(spark, d):
    return L.consolidate(memories(spark, d), 0.55, 0.7).select("memory_id", "action", "strength", "status")


@query(f"WITH {IMP} SELECT memory_id FROM i ORDER BY importance DESC, memory_id LIMIT 10")
def l3_top_important(spark, d):
    return L.top_important(memories(spark, d), 10).select("memory_id")


@query(f"WITH {IMP} SELECT memory_id FROM i WHERE importance < 0.6")
def l3_forget_candidates(spark, d):
    return L.forget_candidates(memories(spark, d), 0.6).select("memory_id")


@query("SELECT event_id, round(exp(-(event_id % 40) / (5.0 * (1 + event_id % 3))), 6)::DOUBLE AS keep FROM events")
def l4_forget_prob(spark, d):
    return table(spark, d, "events").select("event_id", r6(L.forget_prob(F.col("event_id") % 40, 1 + F.col("event_id") % 3, 5.0)).alias("keep"))


@query("SELECT event_id, ('0x' || substr(sha256('7|' || event_id), 1, 12))::BIGINT / 281474976710656.0 >= exp(-(event_id % 40) / (5.0 * (1 + event_id % 3))) AS forgotten FROM events")
def l4_sample_forget(spark, d):
    keep = L.forget_prob(F.col("event_id") % 40, 1 + F.col("event_id") % 3, 5.0)
    return table(spark, d, "events").select("event_id", L.sample_forget(F.col("event_id"), keep, 7).alias("forgotten"))


@query(f"SELECT event_id, round(2.0 * (event_id % 5) + 0.5 * (event_id % 9) + CASE WHEN event_id % 4 = 0 THEN 0.1 ELSE exp(-((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600) / 24) END, 6)::DOUBLE AS heat FROM events")
def l5_heat(spark, d):
    last = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", r6(L.heat(F.col("event_id") % 5, F.col("event_id") % 9, last, F.to_timestamp(F.lit(NOW)), 2.0, 0.5)).alias("heat"))


@query("WITH x AS (SELECT user_id AS bank, event_id AS memory_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 6, ts, event_id) AS k FROM events) SELECT bank, memory_id FROM x WHERE k <= n - 20")
def l6_evict_lfu(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("bank"), F.col("event_id").alias("memory_id"), (F.col("event_id") % 6).alias("uses"), F.col("ts").alias("inserted"))
    return L.evict_lfu(e, 20).select("bank", "memory_id")


@query("""WITH s AS (SELECT event_id AS page_id, unnest([1, 2, 3]) AS session_id, event_id FROM events), x AS (SELECT page_id, session_id, ((event_id * session_id) % 10) / 20.0::DOUBLE AS similarity, list_distinct(['a' || event_id % 3, 'b' || event_id % 4]) AS p, list_distinct(['a' || session_id % 3, 'b' || session_id % 4, 'c']) AS q FROM s),
    y AS (SELECT page_id, session_id, similarity + len(list_intersect(p, q)) / len(list_distinct(p || q)) AS score FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, session_id) AS k FROM y) SELECT page_id, CASE WHEN score >= 0.6 THEN session_id END AS session_id, round(score, 6)::DOUBLE AS score FROM b WHERE k = 1""")
def l7_assign_sessions(spark, d):
    pages = table(spark, d, "events").select(F.col("event_id").alias("page_id"))
    tag = lambda p, x, n: F.concat(F.lit(p), (x % n).cast("string"))
    s = pages.withColumn("session_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    p, i = F.col("page_id"), F.col("session_id")
    s = s.select("page_id", "session_id", (p * i % 10 / 20.0).alias("similarity"), F.array(tag("a", p, 3), tag("b", p, 4)).alias("page_words"), F.array(tag("a", i, 3), tag("b", i, 4), F.lit("c")).alias("session_words"))
    return rounded(L.assign_sessions(pages, s), "score")


@query(f"SELECT event_id, CASE WHEN event_type LIKE '%click%' THEN 0.9 WHEN event_type LIKE '%error%' THEN 0.2 ELSE 0.6 END::DOUBLE AS source_score, round(CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0.5 ** ((event_id % 60) / 30.0) END, 6)::DOUBLE AS time_score FROM events")
def l8_source_time_score(spark, d):
    age = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 60)
    return table(spark, d, "events").select("event_id", L.source_score(F.upper("event_type"), [("click", 0.9), ("error", 0.2)]).alias("source_score"), r6(L.time_score(age, 30.0)).alias("time_score"))


@query("WITH c AS (SELECT user_id AS memory_id, (user_id % 10) / 10.0::DOUBLE AS confidence FROM events GROUP BY user_id), l AS (SELECT DISTINCT user_id AS memory_id, event_id % 150 AS other, (1 + event_id % 3)::DOUBLE AS w, (event_id % 7 - 3) / 3.0::DOUBLE AS cosine FROM events) SELECT l.memory_id, round(greatest(-1, least(1, sum(w * confidence * cosine) / sum(w))), 6)::DOUBLE AS consensus FROM l JOIN c ON other = c.memory_id GROUP BY 1")
def l9_consensus(spark, d):
    e = table(spark, d, "events")
    links = e.select(F.col("user_id").alias("memory_id"), (F.col("event_id") % 150).alias("other"), (1 + F.col("event_id") % 3).cast("double").alias("weight"), ((F.col("event_id") % 7 - 3) / 3.0).alias("cosine")).distinct()
    return rounded(L.consensus(links, e.select(F.col("user_id").alias("memory_id"), (F.col("user_id") % 10 / 10.0).alias("confidence")).distinct()), "consensus")


@query("SELECT event_id, round(0.4 * s + 0.3 * t + 0.3 * c, 6)::DOUBLE AS tri, round((0.4 * s + 0.3 * t) / 0.7, 6)::DOUBLE AS st, round((0.3 * t + 0.3 * c) / 0.6, 6)::DOUBLE AS tc, round((0.4 * s + 0.3 * c) / 0.7, 6)::DOUBLE AS cs FROM (SELECT event_id, (event_id % 10) / 10.0 AS s, (event_id % 7) / 7.0 AS t, (event_id % 4) / 4.0 AS c FROM events)")
def l10_confidence(spark, d):
    i = F.col("event_id")
    parts = (i % 10 / 10.0, i % 7 / 7.0, i % 4 / 4.0)
    return table(spark, d, "events").select("event_id", *(r6(L.confidence(m, *parts)).alias(m) for m in ("tri", "st", "tc", "cs")))


@query("""WITH x AS (SELECT user_id, event_id, event_id % 5 AS s FROM events), f AS (SELECT user_id, s, min(event_id) AS at FROM x GROUP BY 1, 2) SELECT user_id AS memory_id, list(s ORDER BY at) AS sessions FROM f GROUP BY 1""".replace(" AS at ", " AS at_ ").replace("ORDER BY at)", "ORDER BY at_)"))
def l11_provenance(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("memory_id"), i.alias("seq"), F.array(i % 5).alias("sessions"), F.array(i % 3).alias("dialogues"), F.array(i % 2).alias("images"))
    return L.provenance(rows).select("memory_id", "sessions")


@query("""WITH p AS (SELECT conv_id AS bank, turn // 2 AS session, turn AS memory_id, ['new', 'update', 'interference'][turn % 3 + 1] AS kind FROM conversations), s AS (SELECT bank, session, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (kind = 'update') AS n_update, count(*) FILTER (kind = 'interference') AS n_interference, count(*) FILTER (kind <> 'interference') AS n FROM p GROUP BY 1, 2)
    SELECT bank, session, n_new, n_update, n_interference, sum(n) OVER (PARTITION BY bank ORDER BY session)::BIGINT AS n_cumulative FROM s""")
def l12_gold_states(spark, d):
    return L.gold_states(*gold(spark, d)).select("bank", "session", "n_new", "n_update", "n_interference", "n_cumulative")


@query("""WITH p AS (SELECT conv_id AS bank, turn // 2 AS session, turn AS memory_id, ['new', 'update', 'interference'][turn % 3 + 1] AS kind FROM conversations), m AS (SELECT bank, max(session) AS top, max(session) // 2 AS half FROM p GROUP BY 1), a AS (SELECT bank, unnest(list_distinct([top, half])) AS session FROM m)
    SELECT a.bank, a.session, memory_id, kind FROM a JOIN p ON p.bank = a.bank AND p.session <= a.session WHERE kind <> 'interference'""")
def l12_gold_at(spark, d):
    """The cumulative points as of each bank's middle and last session."""
    p, s = gold(spark, d)
    asks = s.groupBy("bank").agg(F.max("session").alias("top")).select("bank", F.explode(F.array_distinct(F.array("top", F.floor(F.col("top") / 2)))).alias("session")).withColumn("ord", F.col("session"))
    return L.gold_at(L.gold_points(p, s), asks)


def gold(spark, d):
    kinds = F.array(*map(F.lit, ["new", "update", "interference"]))
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("bank"), F.floor(F.col("turn") / 2).alias("session"), F.col("turn").alias("memory_id"), F.element_at(kinds, (F.col("turn") % 3 + 1).cast("int")).alias("kind"))
    return p, p.select("bank", "session").distinct().withColumn("ord", F.col("session"))


@query("WITH s AS (SELECT conv_id AS bank, max(turn) AS top FROM conversations GROUP BY 1), c AS (SELECT bank, top, unnest([1, 2]) AS k FROM s) SELECT bank * 10 + k AS checkpoint_id, bank, CASE WHEN 3 * k <= top THEN 3 * k END AS fires_at FROM c")
def l13_checkpoint_trigger(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("bank"), F.col("turn").alias("session"))
    c = t.select("bank").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))).select((F.col("bank") * 10 + F.col("k")).alias("checkpoint_id"), "bank", F.array(F.lit(0).cast("long"), F.col("k"), 3 * F.col("k")).alias("covered"))
    return L.checkpoint_trigger(c, t.distinct().withColumn("ord", F.col("session")))
