"""Queries for sources, splits, windows and the batch form of the streaming rules."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from mnemoloom.functions.columns import ordered_collect, r6
from mnemoloom.operators import graph as G
from mnemoloom.operators import splits as D
from mnemoloom.operators.segments import numbered
from mnemoloom.plans.registry import query
from mnemoloom.session import new_folder, table
from mnemoloom.sources import tables as S
from mnemoloom.streaming import rules as X


def events(spark, d):
    return table(spark, d, "events")


NESTED = "x AS (SELECT conv_id, text, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS no FROM conversations)"


@query(f"WITH {NESTED} SELECT 'c' || conv_id AS character, 0 AS session_no, 'S1' AS session_id, no AS round_no, CASE WHEN role = 'user' THEN text END AS \"user\", CASE WHEN role = 'assistant' THEN text END AS assistant FROM x")
def s1_read_conversations(spark, d):
    """Nest the conversations, write them as JSON, one a line, and scan them as rounds again."""
    t = table(spark, d, "conversations")
    r = t.groupBy("conv_id").agg(ordered_collect(F.struct("turn", "role", "text"), "turn").alias("ts"))
    rounds = F.transform("ts", lambda x: F.struct(x["turn"].cast("string").alias("round"), F.when(x["role"] == "user", x["text"]).alias("user"), F.when(x["role"] == "assistant", x["text"]).alias("assistant")))
    nested = r.select(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name")).alias("character_profile"), F.array(F.struct(F.lit("S1").alias("session_id"), rounds.alias("dialogues"))).alias("multi_session_dialogues"))
    path = new_folder(spark, "conversations")
    nested.write.json(path)
    return S.read_conversations(spark, path, multi_line=False).select("character", "session_no", "session_id", "round_no", "user", "assistant")


@query(f"WITH {NESTED} SELECT 'c' || conv_id AS sample_id, 0 AS session_no, 'S1' AS session_id, no AS turn, role, text AS content FROM x")
def s1_read_turns(spark, d):
    """The layout by turns, in files that each hold an array of ten conversations."""
    t = table(spark, d, "conversations")
    r = t.groupBy("conv_id").agg(ordered_collect(F.struct("role", F.col("text").alias("content")), "turn").alias("dialogue"))
    nested = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sample_id"), F.array(F.struct(F.lit("S1").alias("session_id"), "dialogue")).alias("sessions"))
    files = r.groupBy(F.floor(F.col("conv_id") / 10).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(nested)), ",\n"), F.lit("]")).alias("value"))
    path = new_folder(spark, "turns")
    files.write.partitionBy("file").text(path)
    return S.read_conversations(spark, f"{path}/file=*", "turns").select("sample_id", "session_no", "session_id", "turn", "role", "content")


@query("SELECT doc_id || '' AS chunk_id, text, source FROM documents")
def s2_chunk_files(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.array().cast("array<string>").alias("images"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    path = new_folder(spark, "chunks")
    S.write_chunks(chunks, path)
    return S.read_chunks(spark, path).select("chunk_id", "text", F.col("metadata")["source"].alias("source"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, turn AS turns, role AS roles FROM conversations")
def s3_explode_haystack(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(ordered_collect("turn", "turn").alias("turns"), ordered_collect("role", "turn").alias("roles"))
    return S.explode_haystack(t, ["turns", "roles"], ["conv_id"])


@query("WITH x AS (SELECT user_id AS dataset, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS ordinal, event_type AS category FROM events) SELECT * FROM x WHERE category NOT IN ('click', 'error')")
def s4_filter_questions(spark, d):
    q = events(spark, d).select(F.col("user_id").alias("dataset"), "event_id", F.lit(None).cast("string").alias("sub"), F.col("event_type").alias("main"))
    return S.filter_questions(q, " Click ,ERROR,", "event_id", ["sub", "main"]).select("dataset", "event_id", "ordinal", "category")


@query("SELECT c_name, coalesce(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '')::BIGINT, 0) AS number FROM customer")
def s5_natural_key(spark, d):
    return table(spark, d, "customer").select("c_name", S.natural_key("c_name")["number"].alias("number"))


@query("SELECT vec_id AS id, CASE WHEN vec_id < 300 THEN 0 ELSE 1 END AS shard, round(CASE WHEN vec_id < 300 THEN embedding[1]::DOUBLE ELSE 2 * embedding[1]::DOUBLE END, 6) AS first FROM embeddings")
def s6_merge_features(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    m = S.merge_features([v.where("id < 300"), v.where("id >= 200").withColumn("vector", F.transform("vector", lambda x: 2 * x))])
    return m.select("id", "shard", r6(F.col("vector")[0]).alias("first"))


@query("SELECT label::VARCHAR AS bank, count(*) AS n FROM embeddings GROUP BY 1")
def s7_bank(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("bank"), F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    path = new_folder(spark, "bank")
    S.save_bank(v, path)
    return S.load_bank(spark, path).groupBy(F.col("bank").cast("string").alias("bank")).agg(F.count("*").alias("n"))


@query()
def s8_with_embedding(spark, d):
    def hashed(texts):
        import zlib

        import numpy as np

        for t in texts:
            v = np.zeros(16, np.float32)
            for w in (t or "").split():
                v[zlib.crc32(w.encode()) % 16] += 1
            yield (v / max(1e-9, float(np.sqrt((v * v).sum())))).tolist()

    return S.with_embedding(table(spark, d, "documents").select("doc_id", "text"), "text", hashed, 16).drop("text")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE value > 10) WHERE n = 1")
def s9_latest_by_key(spark, d):
    return S.latest_by_key(events(spark, d).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", F.col("value") > 10)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s10_reports(spark, d):
    x = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    base = new_folder(spark, "report")
    for fmt in ("csv", "json", "markdown"):
        S.write_report(x, f"{base}/{fmt}", fmt)
    return spark.read.schema("event_type string, n long").option("header", True).csv(f"{base}/csv")


@query("WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM x WHERE k // ((n + 6) // 7) = 3")
def s11_read_split(spark, d):
    return S.read_split(table(spark, d, "documents").select("doc_id"), 7, 3, "doc_id")


@query("SELECT event_id, 'ev::' || event_id || '::' || event_type || '::' || substr(sha1(event_type || chr(10) || 'q' || user_id || chr(10) || chr(10)), 1, 16) AS query_id FROM events")
def s12_query_id(spark, d):
    q = events(spark, d).select("event_id", F.lit("ev").alias("dataset"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("category"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("caption"))
    return S.with_query_id(q).select("event_id", "query_id")


@query("SELECT c_custkey AS query_id, v.vec_id IS NOT NULL AS found, round(embedding[1]::DOUBLE, 6) AS first FROM customer LEFT JOIN embeddings v ON vec_id = c_custkey")
def s12_attach_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found, missing = S.attach_vectors(table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), v)
    has = found.select("query_id", F.lit(True).alias("found"), r6(F.col("vector")[0].cast("double")).alias("first"))
    return has.unionByName(missing.select("query_id", F.lit(False).alias("found"), F.lit(None).cast("double").alias("first")))


@query("SELECT event_id AS msg_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def s13_fetch_latest(spark, d):
    return S.fetch_latest(events(spark, d).select(F.col("event_id").alias("msg_id"), "event_type"), 50)


@query("WITH r AS (SELECT o_orderkey AS range_no, o_orderkey % 300 AS low, o_orderkey % 300 + 20 AS high FROM orders) SELECT range_no, event_id AS msg_id FROM events JOIN r ON event_id BETWEEN low AND high")
def s13_fetch_ranges(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("range_no"), (F.col("o_orderkey") % 300).alias("low"), (F.col("o_orderkey") % 300 + 20).alias("high"))
    return S.fetch_ranges(events(spark, d).select(F.col("event_id").alias("msg_id")), r, 64)


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'")
def s13_fetch_time(spark, d):
    return S.fetch_time(events(spark, d), datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 9)).select("event_id")


MANIFEST = "m AS (SELECT ['train', 'val', 'test'][o_custkey % 3 + 1] AS split, o_custkey AS conversation_id, o_orderkey AS question_id FROM orders)"


def manifest(spark, d):
    names = F.array(*map(F.lit, ["train", "val", "test"]))
    return table(spark, d, "orders").select(F.element_at(names, (F.col("o_custkey") % 3 + 1).cast("int")).alias("split"), F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("question_id"))


@query(f"WITH {MANIFEST}, x AS (SELECT CASE WHEN question_id % 500 = 0 THEN 'train' ELSE split END AS split, conversation_id FROM m) SELECT 'conversation in two splits' AS \"check\", conversation_id::VARCHAR AS key FROM x GROUP BY conversation_id HAVING count(DISTINCT split) > 1")
def d1_validate_split(spark, d):
    m = manifest(spark, d).withColumn("split", F.when(F.col("question_id") % 500 == 0, "train").otherwise(F.col("split")))
    return D.validate_split(m, m.groupBy("split").agg(F.countDistinct("question_id").alias("question_count")))


@query(f"WITH {MANIFEST} SELECT split, count(DISTINCT conversation_id) AS conversations, count(DISTINCT question_id) AS questions, count(DISTINCT question_id) FILTER (question_id % 9 > 0) AS effective FROM m GROUP BY 1")
def d2_split_summary(spark, d):
    m = manifest(spark, d)
    return D.split_summary(m, m.where("question_id % 9 = 0").select("question_id"))


@query(f"WITH {MANIFEST} SELECT o_orderkey AS question_id, split, o_orderstatus FROM orders JOIN m ON question_id = o_orderkey")
def d3_materialize_splits(spark, d):
    return D.materialize_splits(order_questions(spark, d), manifest(spark, d))[0].select("question_id", "split", "o_orderstatus")


def order_questions(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderstatus")


@query(f"WITH {MANIFEST}, s AS (SELECT question_id + 1 AS question_id FROM m), o AS (SELECT o_orderkey AS question_id FROM orders) SELECT *, 'extra' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM o)")
def d3_split_errors(spark, d):
    """A manifest whose ids are all off by one, against all orders: what either side lacks."""
    return D.materialize_splits(order_questions(spark, d), manifest(spark, d).withColumn("question_id", F.col("question_id") + 1))[1]


@query(f"WITH {MANIFEST} SELECT split, conversation_id, question_id, (row_number() OVER (PARTITION BY split, conversation_id ORDER BY question_id) - 1)::INT AS ordinal FROM m")
def d4_ordered_questions(spark, d):
    m = manifest(spark, d).groupBy("split", "conversation_id").agg(ordered_collect("question_id", "question_id").alias("ids"))
    return D.ordered_questions(m, "ids")


@query("WITH x AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderpriority, o_orderkey FROM x WHERE n <= 25")
def d5_quota_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return D.quota_sample(o, o.select("o_orderpriority").distinct().withColumn("n", F.lit(25)), "o_orderpriority", ["o_orderkey"])[0]


@query("WITH x AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7|' || o_orderkey)) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders) SELECT o_orderpriority, o_orderkey FROM x WHERE n <= floor(size * 0.3)")
def d6_sample_per_group(spark, d):
    return D.sample_per_group(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 0.3, 7).drop("shuffle")


@query("SELECT DISTINCT c_custkey AS clue, c_custkey % 10 AS question_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def d7_clue_coverage(spark, d):
    q = table(spark, d, "customer").groupBy((F.col("c_custkey") % 10).alias("question_id")).agg(F.collect_list("c_custkey").alias("clues"))
    return D.clue_coverage(q, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("clue")))


@query("SELECT c_custkey AS id, c_custkey < 200 AS present FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def d7_subset(spark, d):
    """Customers below 200 as the table; asked for are those with an urgent order; ids that the table lacks are told."""
    asked = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    rows, missing = D.subset(table(spark, d, "customer").where("c_custkey < 200").select(F.col("c_custkey").alias("id")), asked, "id")
    return rows.select("id", F.lit(True).alias("present")).unionByName(missing.select("id", F.lit(False).alias("present")))


@query("""SELECT 'missing results' AS "check", count(*) FILTER (event_id % 50 = 0) = 0 AS passed, count(*) FILTER (event_id % 50 = 0) AS detail FROM events UNION ALL SELECT 'extra results', TRUE, 0 UNION ALL SELECT 'missing traces', TRUE, 0
    UNION ALL SELECT 'errors', count(*) FILTER (event_id % 50 > 0 AND event_type = 'error') = 0, count(*) FILTER (event_id % 50 > 0 AND event_type = 'error') FROM events UNION ALL SELECT 'too many hits', count(*) FILTER (event_id % 50 > 0 AND event_id % 13 > 10) = 0, count(*) FILTER (event_id % 50 > 0 AND event_id % 13 > 10) FROM events""")
def d8_audit_run(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("question_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_id") % 13).alias("hits"))
    return D.audit_run(e.where("question_id % 50 > 0"), e, e, 10)


@query("SELECT event_id, event_id % 3 = 0 AND event_id % 4 > 0 AS complete FROM events")
def d9_check_captions(spark, d):
    i = F.col("event_id")
    x = events(spark, d).select("event_id", F.array(F.lit("a"), F.lit("b")).alias("images"), F.when(i % 3 == 0, F.array(F.lit("x"), F.when(i % 4 == 0, " ").otherwise("y"))).otherwise(F.array(F.lit("x"))).alias("captions"))
    return x.select("event_id", D.check_captions(x, "images", "captions").alias("complete"))


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END + CASE WHEN event_id % 5 > 0 THEN 4 ELSE 0 END + CASE WHEN event_id % 7 > 2 AND event_type = 'click' THEN 8 ELSE 0 END + CASE WHEN event_id % 11 > 5 AND event_type = 'click' THEN 16 ELSE 0 END)::INT AS mask FROM events")
def d10_availability(spark, d):
    i = F.col("event_id")
    x = events(spark, d).select("event_id", F.when(i % 2 == 0, "s").otherwise("").alias("summary"), F.array_repeat(F.lit("d"), (i % 3).cast("int")).alias("dialogues"), F.when(i % 5 > 0, "c").otherwise("").alias("caption"), (i % 7 > 2).alias("has_image"), (i % 11 > 5).alias("has_primitive"), (F.col("event_type") == "click").alias("visual"))
    return x.select("event_id", D.availability(x).alias("mask"))


@query("SELECT c_custkey AS image_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN c_custkey END AS artifact_id, ['hash', 'suffix', 'none'][c_custkey % 3 + 1] AS how FROM customer")
def d11_match_artifacts(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("img"), k.cast("string"), F.lit(".png"))
    t = table(spark, d, "customer")
    images = t.select(k.alias("image_id"), F.concat(F.lit("a/"), name).alias("path"), F.sha2(k.cast("string"), 256).alias("sha256"))
    artifacts = t.where("c_custkey % 3 < 2").select(k.alias("artifact_id"), F.when(k % 3 == 0, F.concat(F.lit("x/"), F.sha2(k.cast("string"), 256), F.lit(".json"))).otherwise(F.concat(F.lit("root/a/"), name)).alias("path"))
    return D.match_artifacts(images, artifacts)


BOXES = "b AS (SELECT user_id AS image_id, event_id AS box_id, CASE WHEN event_id % 40 = 0 THEN 0 ELSE event_id * 37 % 600 END AS x1, CASE WHEN event_id % 40 = 0 THEN 0 ELSE event_id * 53 % 600 END AS y1, CASE WHEN event_id % 40 = 0 THEN 1000 ELSE event_id * 37 % 600 + 100 + event_id % 300 END AS x2, CASE WHEN event_id % 40 = 0 THEN 960 ELSE event_id * 53 % 600 + 100 + event_id % 200 END AS y2 FROM events)"


def boxes(spark, d):
    i = F.col("event_id")
    side = lambda full, rest: F.when(i % 40 == 0, full).otherwise(rest).cast("long")
    return events(spark, d).select(F.col("user_id").alias("image_id"), i.alias("box_id"), side(0, i * 37 % 600).alias("x1"), side(0, i * 53 % 600).alias("y1"), side(1000, i * 37 % 600 + 100 + i % 300).alias("x2"), side(960, i * 53 % 600 + 100 + i % 200).alias("y2"))


@query(f"WITH {BOXES} SELECT image_id, box_id FROM b p WHERE NOT ((x2 - x1) * (y2 - y1) >= 900000 AND EXISTS (SELECT 1 FROM b c WHERE c.image_id = p.image_id AND c.box_id <> p.box_id AND greatest(0, least(p.x2, c.x2) - greatest(p.x1, c.x1)) * greatest(0, least(p.y2, c.y2) - greatest(p.y1, c.y1)) >= 0.95 * (c.x2 - c.x1) * (c.y2 - c.y1) AND (c.x2 - c.x1) * (c.y2 - c.y1) < 0.8 * (p.x2 - p.x1) * (p.y2 - p.y1)))")
def d12_drop_parents(spark, d):
    return D.drop_parents(boxes(spark, d)).select("image_id", "box_id")


@query()
def d12_dedup_boxes(spark, d):
    return D.dedup_boxes(boxes(spark, d), 0.3)


@query("""SELECT user_id, sha256(string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', chr(10) ORDER BY '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')) AS signature, count(*) AS n FROM events GROUP BY 1""")
def d13_signature(spark, d):
    return D.signature(events(spark, d), ["user_id"], ["event_id", "event_type"])


# A series for each event type, in batches of the operator's own size.
W1 = """t AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, sqrt(abs(value)) AS root, (event_id % 7)::DOUBLE AS quality FROM events), s AS (SELECT *, seq // 32 AS batch FROM t),
    i AS (SELECT series, quantile_cont(root, 0.95) - quantile_cont(root, 0.05) AS initial FROM s WHERE seq < 128 GROUP BY 1), k AS (SELECT DISTINCT series, batch FROM s),
    b AS (SELECT k.series, k.batch, quantile_cont(root, 0.05) AS low, quantile_cont(root, 0.95) AS high FROM k JOIN s ON s.series = k.series AND s.seq >= k.batch * 32 - 512 AND s.seq < k.batch * 32 WHERE k.batch * 32 >= 128 GROUP BY 1, 2), r AS (SELECT b.*, greatest(high - low, 0.25 * initial) AS rng FROM b JOIN i USING (series)),
    z AS (SELECT r.series, r.batch, stddev_pop(quality) / (stddev_pop(greatest(0, least(1, (root - low) / rng))) + 1e-8) AS scale FROM r JOIN s ON s.series = r.series AND s.seq >= r.batch * 32 - 512 AND s.seq < r.batch * 32 GROUP BY 1, 2)"""


@query(f"WITH {W1} SELECT series, seq, CASE WHEN rng IS NOT NULL THEN round(greatest(0, least(1, (root - low) / rng)), 6)::DOUBLE END AS normalized, round(scale, 6)::DOUBLE AS scale FROM s LEFT JOIN r USING (series, batch) LEFT JOIN z USING (series, batch)")
def w1_sliding_normalize(spark, d):
    e = numbered(events(spark, d).select("event_type", "event_id", "value"), "event_type", ["event_id"])
    x = e.select(F.col("event_type").alias("series"), F.col("idx").alias("seq"), F.abs("value").alias("cost"), (F.col("event_id") % 7).cast("double").alias("quality"))
    n = D.sliding_normalize(x)
    return n.select("series", "seq", F.when(F.col("scale").isNotNull(), r6("normalized")).alias("normalized"), r6("scale").alias("scale"))


@query("WITH x AS (SELECT user_id AS episode, event_id AS step, (event_id % 5)::DOUBLE AS reward, (event_id % 3)::DOUBLE AS value FROM events) SELECT episode, step, round(sum(reward) OVER (PARTITION BY episode ORDER BY step DESC) - value, 6)::DOUBLE AS advantage FROM x")
def w3_gae(spark, d):
    x = events(spark, d).select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), (F.col("event_id") % 5).cast("double").alias("reward"), (F.col("event_id") % 3).cast("double").alias("value"))
    return D.gae(x, 1.0, 1.0).withColumn("advantage", r6("advantage"))


@query()
def w3_gae_discounted(spark, d):
    x = events(spark, d).select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), (F.col("event_id") % 5).cast("double").alias("reward"), (F.col("event_id") % 3).cast("double").alias("value"))
    return D.gae(x, 0.99, 0.95).withColumn("advantage", r6("advantage"))


@query("""WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT key, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY key, no""")
def x1_sessions(spark, d):
    return X.stream_sessions(events(spark, d).select(F.col("user_id").alias("key"), "ts"), "6 hours")


def frames(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("label").cast("long").alias("source"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 3600.0).alias("at"), F.col("embedding").cast("array<double>").alias("vector"))


@query()
def x2_novelty(spark, d):
    return X.novelty(frames(spark, d), 0.05, 0.3).withColumn("similarity", r6("similarity"))


@query()
def x3_clusters(spark, d):
    return X.online_clusters(frames(spark, d), 0.2)


@query("SELECT user_id AS s, event_type AS p, event_id % 5 AS o, count(*) AS mentions, max(value) AS confidence, list_sort(list_distinct(list(event_id % 9))) AS sources FROM events GROUP BY 1, 2, 3")
def x4_upsert_stream(spark, d):
    """The relations of all events, from a stream of them that arrives in twelve files, a micro-batch each."""
    rows = events(spark, d).select(F.col("user_id").alias("s"), F.col("event_type").alias("p"), (F.col("event_id") % 5).alias("o"), F.lit(1).cast("long").alias("mentions"), F.col("value").alias("confidence"), F.array(F.col("event_id") % 9).alias("sources"), (F.col("event_id") % 12).alias("file"))
    source, target = new_folder(spark, "increments"), new_folder(spark, "relations")
    rows.repartition(12, "file").write.partitionBy("file").parquet(source)
    schema = rows.drop("file").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/file=*")
    X.upsert_stream(stream, target, G.merge_relations, new_folder(spark, "relations-log"), keep=5).awaitTermination()
    return X.read_upserted(spark, target, G.merge_relations)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type AS phase, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, sum(event_id % 50)::BIGINT AS tokens FROM events GROUP BY 1, 2, 3")
def x5_call_stats(spark, d):
    e = events(spark, d).select("ts", F.col("event_type").alias("phase"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 50).alias("tokens"))
    return X.stream_call_stats(e, "1 day")


@query("""WITH x AS (SELECT user_id AS key, event_id AS seq, event_type IN ('error', 'click') AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS good FROM x),
    n AS (SELECT key, min(seq) OVER w AS start, seq, row_number() OVER w AS length FROM g WHERE failed WINDOW w AS (PARTITION BY key, good ORDER BY seq)) SELECT * FROM n WHERE length = 3""")
def x6_failure_alarms(spark, d):
    return X.failure_alarms(calls(spark, d), 3)


@query("WITH x AS (SELECT user_id AS key, event_id AS seq, event_type IN ('error', 'click') AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY seq) AS good FROM x) SELECT key, min(seq) AS start, count(*) AS length FROM g WHERE failed GROUP BY key, good HAVING count(*) >= 3")
def x6_failure_runs(spark, d):
    return X.failure_runs(calls(spark, d), 3)


def calls(spark, d):
    return events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("failed"))
