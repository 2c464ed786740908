"""Queries on tables of a test's own, held against their SQL."""

import datetime

import duckdb
from pyspark.sql import functions as F

from mnemoloom.functions.columns import rounded
from mnemoloom.plans import ORACLES, QUERIES
from mnemoloom.sources import tables as S


def against_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(ORACLES[name])
    return sorted(tuple(r) for r in got.select(*want.columns).collect()), sorted(want.fetchall())


def test_transcript_cues_by_nearest_second(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 12)
    after = [0, 3600.4, 5400.4, 5400.6, 7000.5, 7001.5, 12400.7, 12401.2]
    rows = [(i, day + datetime.timedelta(seconds=s), 1, "purchase" if i % 3 == 0 else "view") for i, s in enumerate(after)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got, want = against_sql(spark, tmp_path, "c14_slice_transcript", "events")
    assert got == want


def test_read_split_deals_every_row_once(spark):
    rows = spark.range(0, 30_000, 1, 6).select(F.xxhash64("id").alias("key"), F.col("id").alias("v.x"))
    parts = [[r["key"] for r in S.read_split(rows, 7, i, "key").collect()] for i in range(7)]
    assert [len(p) for p in parts] == [4286] * 6 + [4284]
    assert [k for p in parts for k in sorted(p)] == sorted(r["key"] for r in rows.collect())
    assert S.read_split(rows.limit(0), 7, 0, "key").count() == 0


def test_rounding_is_that_of_the_sql(spark):
    values = [0.0640625, 0.5e-6, -0.5e-6, 1.0000005, -2.5e-6, 0.0, 1e300, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["v"] for r in rows.select("i", rounded("v").alias("v")).orderBy("i").collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


def test_fused_vectors_round_as_the_sql(spark, tmp_path):
    rows = [(0, [0.1293468326330185] * 64), (3, [-0.08826760947704315] * 64)]  # fused: 0.0640625 as a decimal, just below half a unit as a product
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = against_sql(spark, tmp_path, "v27_fuse_vectors", "embeddings")
    assert got == want


def test_answers_meet_only_where_the_next_text_is_gold(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["The cat and a dog", None, "one two", "", "an A. the", "x " * 30, "y z " * 9, "end"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from mnemoloom.plans.metrics import answers

    plan = answers(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.find("Union") < plan.find("Join")
    for name in ("m1_token_f1", "m2_exact_match", "m5_set_prf"):
        got, want = against_sql(spark, tmp_path, name, "documents")
        assert got == want
