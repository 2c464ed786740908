"""Queries over ``conversations`` and friends for sources and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoloom.functions.columns import ordered_collect
from mnemoloom.operators import chunking as C
from mnemoloom.plans.registry import query
from mnemoloom.session import table

ROUNDS = """
    t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role IN ('user', 'assistant')),
    r AS (SELECT *, sum(CASE WHEN role = 'user' OR prev IS DISTINCT FROM 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM t),
    rounds AS (SELECT conv_id, round::BIGINT AS round, min(turn) AS first_turn, max(CASE WHEN role = 'user' THEN text END) AS user_text,
               max(CASE WHEN role = 'assistant' THEN text END) AS assistant_text FROM r GROUP BY 1, 2)"""
BLOCKS = """
    b0 AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    b1 AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM b0),
    blocks AS (SELECT conv_id, block::BIGINT AS block, min(role) AS speaker, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM b1 GROUP BY 1, 2)"""
COMPACT = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def turns(spark, d):
    return table(spark, d, "conversations")


@query(f"WITH {ROUNDS} SELECT * FROM rounds")
def c1_pair_rounds(spark, d):
    return C.pair_rounds(turns(spark, d))


@query("""WITH a AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    b AS (SELECT *, sum(CASE WHEN role = 'user' OR prev = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM a)
    SELECT conv_id, round::BIGINT AS round, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM b GROUP BY 1, 2""")
def c2_pair_rounds_all(spark, d):
    return C.pair_rounds(turns(spark, d), keep_all=True)


@query(f"WITH {BLOCKS} SELECT * FROM blocks")
def c3_speaker_blocks(spark, d):
    return C.speaker_blocks(turns(spark, d))


@query(f"WITH {BLOCKS} SELECT conv_id, (block - 1) // 2 AS exchange, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY block) AS text FROM blocks GROUP BY 1, 2")
def c4_pair_blocks(spark, d):
    return C.pair_blocks(C.speaker_blocks(turns(spark, d)))


@query(f"""WITH {ROUNDS} SELECT conv_id, round, concat_ws(chr(10), CASE WHEN trim(user_text) <> '' THEN 'user: ' || user_text END,
    CASE WHEN trim(assistant_text) <> '' THEN 'assistant: ' || assistant_text END, 'round: ' || round) AS chunk FROM rounds""")
def c5_render_chunk(spark, d):
    r = C.pair_rounds(turns(spark, d))
    return r.select("conv_id", "round", C.render_chunk([("user", F.col("user_text")), ("assistant", F.col("assistant_text")), ("round", F.col("round"))]).alias("chunk"))


@query(f"SELECT doc_id, {COMPACT.format('text')} AS compact, greatest(1, length({COMPACT.format('text')}) // 4) AS tokens FROM documents")
def c6_compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.compact_text("text").alias("compact"), C.estimate_tokens(C.compact_text("text")).alias("tokens"))


@query(f"""WITH {ROUNDS}, x AS (SELECT conv_id, round, {COMPACT.format("coalesce(user_text, '')")} AS t FROM rounds)
    SELECT conv_id, round, coalesce(rtrim(substr(lag(t) OVER (PARTITION BY conv_id ORDER BY round), 1, 260)), '') AS previous FROM x""")
def c7_previous_summary(spark, d):
    r = C.pair_rounds(turns(spark, d)).withColumn("text", F.coalesce("user_text", F.lit("")))
    return C.with_previous_summary(r).select("conv_id", "round", "previous")


@query()
def c8_trim_chunk(spark, d):
    r = C.pair_rounds(turns(spark, d))
    chunks = r.select("conv_id", "round", C.render_chunk([("user", F.regexp_replace("user_text", "\n", " ")), ("assistant", F.regexp_replace("assistant_text", "\n", " "))]).alias("chunk"))
    return C.trim_chunk(chunks, "chunk", 128, ("assistant:", "user:"))


def sized_rounds(spark, d):
    r = C.pair_rounds(turns(spark, d))
    return r.withColumn("tokens", C.estimate_tokens(F.concat_ws("\n", "user_text", "assistant_text")).cast("long"))


@query()
def c9_balance_chunks(spark, d):
    return C.balance_chunks(sized_rounds(spark, d), 512)


@query(f"WITH {ROUNDS} SELECT conv_id, round, (row_number() OVER (PARTITION BY conv_id ORDER BY round) - 1) // 4 AS batch FROM rounds")
def c10_batch_rounds(spark, d):
    return C.batch_rounds(C.pair_rounds(turns(spark, d)), 4).select("conv_id", "round", "batch")


@query()
def c10_batch_rounds_images(spark, d):
    r = C.pair_rounds(turns(spark, d)).withColumn("images", (F.col("user_text").contains("http") | (F.length("user_text") > 400)).cast("long"))
    return C.batch_rounds(r.fillna({"images": 0}), 4, "images")


@query(f"""WITH {ROUNDS}, g AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY round) - 1) // 3 AS batch, round, first_turn FROM rounds)
    SELECT conv_id, batch, min(round)::VARCHAR || '..' || max(round)::VARCHAR AS chunk_id, count(*) AS n_chunks, list(first_turn ORDER BY round) AS turns FROM g GROUP BY 1, 2""")
def c11_merge_chunks(spark, d):
    r = C.batch_rounds(C.pair_rounds(turns(spark, d)), 3).withColumn("turns", F.array("first_turn"))
    return C.merge_chunks(r, ["conv_id", "batch"], "round", "round", ["turns"])


SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {SPLIT.format('text')} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, (len(ws) + 127) // 128)) AS part FROM w WHERE len(ws) > 0)
    SELECT doc_id, part::INT AS part, array_to_string(ws[part * 128 + 1 : part * 128 + 128], ' ') AS chunk, doc_id || '_part' || part AS chunk_id FROM p""")
def c12_split_documents(spark, d):
    return C.split_documents(table(spark, d, "documents"), 128)


@query("""SELECT c_custkey, 'customer: ' || concat_ws(', ', CASE WHEN trim(c_name) <> '' THEN 'c_name is ' || c_name END, 'c_nationkey is ' || c_nationkey,
    CASE WHEN trim(c_mktsegment) <> '' THEN 'c_mktsegment is ' || c_mktsegment END) AS line FROM customer""")
def c13_linearize_rows(spark, d):
    t = table(spark, d, "customer")
    return t.select("c_custkey", C.linearize_rows(t, ["c_name", "c_nationkey", "c_mktsegment"], "customer").alias("line"))


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS s, event_type FROM events),
    cues AS (SELECT event_id AS cue_id, user_id AS key, s AS start, s + 1800 AS stop, event_type AS text FROM e),
    ranges AS (SELECT event_id AS range_id, user_id AS key, s - 3600 AS start, s + 3600 AS stop FROM e WHERE event_type = 'purchase')
    SELECT range_id, count(*) AS n_cues, string_agg(text, ' ' ORDER BY c.start, cue_id) AS text FROM cues c JOIN ranges r ON c.key = r.key AND c.start <= r.stop AND c.stop >= r.start GROUP BY 1""")
def c14_slice_transcript(spark, d):
    e = table(spark, d, "events").withColumn("s", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))  # the nearest second, as in the SQL
    cues = e.select(F.col("event_id").alias("cue_id"), F.col("user_id").alias("key"), F.col("s").alias("start"), (F.col("s") + 1800).alias("stop"), F.concat(F.lit("<v>"), "event_type", F.lit("</v>")).alias("text"))
    ranges = e.where("event_type = 'purchase'").select(F.col("event_id").alias("range_id"), F.col("user_id").alias("key"), (F.col("s") - 3600).alias("start"), (F.col("s") + 3600).alias("stop"))
    return C.slice_transcript(cues, ranges, 7200)


@query("""WITH x AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations),
    y AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS suffix FROM x) SELECT conv_id, turn, tokens, suffix::BIGINT AS suffix FROM y WHERE suffix <= 400""")
def c15_truncate_history(spark, d):
    return C.truncate_history(turns(spark, d), 500, 100).select("conv_id", "turn", "tokens", "suffix")


@query(f"WITH w AS (SELECT doc_id, {SPLIT.format('text')} AS ws FROM documents) SELECT doc_id, array_to_string(ws[greatest(1, len(ws) - 19) : len(ws)], ' ') AS tail FROM w")
def c16_keep_last_words(spark, d):
    return table(spark, d, "documents").select("doc_id", C.keep_last_words("text", 20).alias("tail"))


@query()
def c17_truncate_by_score(spark, d):
    return C.truncate_by_score(turns(spark, d), "text", 50.0).select("conv_id", "turn", "cut")


@query(f"""WITH {ROUNDS}, x AS (SELECT conv_id, round, concat_ws(chr(10), user_text, CASE WHEN round % 2 = 0 THEN '[image] picture ' || round END) AS u, assistant_text AS a FROM rounds),
    s AS (SELECT conv_id, round, 0 AS side, 'user' AS role, u AS text FROM x UNION ALL SELECT conv_id, round, 1, 'assistant', a FROM x) SELECT * FROM s WHERE trim(coalesce(text, '')) <> ''""")
def c18_history_view(spark, d):
    r = C.pair_rounds(turns(spark, d)).withColumn("caption", F.when(F.col("round") % 2 == 0, F.concat(F.lit("picture "), F.col("round").cast("string"))).otherwise("")).withColumn("images", F.array().cast("array<string>"))
    return C.history_view(r, "text_only").select("conv_id", "round", "side", "role", "text")


@query(f"""WITH {ROUNDS}, q AS (SELECT DISTINCT conv_id AS question_id, unnest([conv_id, conv_id + 1, conv_id]) AS conv_id FROM conversations)
    SELECT question_id, conv_id, round, first_turn FROM rounds JOIN q USING (conv_id)""")
def c19_oracle_context(spark, d):
    q = turns(spark, d).select(F.col("conv_id").alias("question_id")).distinct().withColumn("targets", F.array(F.col("question_id"), F.col("question_id") + 1, F.col("question_id")))
    return C.oracle_context(C.pair_rounds(turns(spark, d)), q).select("question_id", "conv_id", "round", "first_turn")


@query(f"""WITH w AS (SELECT lang, source, len({SPLIT.format("coalesce(text, '')")}) AS n, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END AS k FROM documents)
    SELECT lang, source, count(*) AS n_texts, sum(n)::BIGINT AS n_words, sum(k)::BIGINT AS n_tokens, max(n) AS max_words FROM w GROUP BY 1, 2""")
def c20_token_stats(spark, d):
    return C.token_stats(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT conv_id, 2 * count(*) AS n_strings, sum(length(role) + length(text))::BIGINT AS n_chars, count(*) FILTER (length(text) > 300) AS n_long FROM conversations GROUP BY 1")
def c20_collect_strings(spark, d):
    """All strings of conversations nested in structs, arrays and a map."""
    t = turns(spark, d).groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.create_map(F.lit("role"), F.col("role")).alias("who"), F.array("text").alias("said"))).alias("ts"))
    x = C.collect_strings(t.select("conv_id", F.struct("ts", F.lit(1).alias("version")).alias("nested")), "nested")
    size = F.aggregate("strings", F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    return x.select("conv_id", F.size("strings").cast("long").alias("n_strings"), size.alias("n_chars"), F.size(F.filter("strings", lambda s: F.length(s) > 300)).cast("long").alias("n_long"))


@query("""WITH a AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    b AS (SELECT *, sum(CASE WHEN role = 'user' OR prev = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM a)
    SELECT conv_id, round::BIGINT AS round, (row_number() OVER (PARTITION BY conv_id, round ORDER BY turn) - 1)::INT AS place, role || ': ' || text AS utterance FROM b""")
def c21_explode_turns(spark, d):
    t = turns(spark, d)
    opens = (F.col("role") == "user") | (F.lag("role").over(C.by_turn()) == "assistant")
    rows = t.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("round", F.sum("opens").over(C.by_turn()))
    chunks = rows.groupBy("conv_id", "round").agg(ordered_collect("text", "turn").alias("texts"), ordered_collect("role", "turn").alias("speakers"))
    return C.explode_turns(chunks)


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
    k AS (SELECT DISTINCT conv_id, total, unnest(range(0, CASE WHEN total < 4 THEN 1 ELSE (total - 4) // 3 + 1 + CASE WHEN ((total - 4) // 3 + 1) * 3 < total THEN 1 ELSE 0 END END)) AS win FROM a)
    SELECT a.conv_id, win AS "window", count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM a JOIN k ON a.conv_id = k.conv_id AND n >= win * 3 AND n < win * 3 + 4 GROUP BY 1, 2""")
def c22_count_windows(spark, d):
    return C.count_windows(turns(spark, d), 4, 1)


@query()
def c23_force_segments(spark, d):
    return C.force_segments(turns(spark, d), 6, 400)
