"""The pipeline's stages, each on what the one before kept."""

import collections
import random

import corpus_pipeline as P
import pyarrow as pa
from mnemoloom.llm import common, jaccard
from mnemoloom.session import TEXT_BATCH, stage
from pyspark.sql import functions as F
from test_operators import chunk_expected, check_pack, jaccard_expected


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "substrings", "packing"]
    columns = docs.columns
    kept = []
    for name, step in P.STAGES:
        out = stage(step(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == columns
        kept.append((docs, out))
        docs = out
    before, after = kept[0]
    lost = before.join(after, "doc_id", "left_anti").collect()
    assert len(lost) <= 0.01 * before.count()
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = map(rows, kept[1])
    want = {d for d, _, c in jaccard_expected(before, 5, 80) if d == c}
    assert {d for d, _ in after} == want
    before, after = map(rows, kept[2])
    expected = {x[0]: x for x in chunk_expected(before, 128)}
    assert all(len(t.encode()) <= expected[d][1] for d, t in after)
    assert {d for d, t in after if t == dict(before)[d]} >= {d for d, x in expected.items() if x[2] == 0}
    before, _ = kept[3]
    check_pack(rows(before), kept[3][1].collect())


def test_stages_take_nulls_and_empty_tables(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, "der text ohne nummer", "de", "s", 20), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "a", "en", "s", 1)], real.schema)
    for docs in (real.unionByName(odd), real.limit(0)):
        for _, step in P.STAGES:
            docs = stage(step(spark, docs, sf_dir), "test-edges")
        assert docs.count() >= 0


def test_stages_keep_clashing_columns_and_one_of_repeated_rows(spark, sf_dir):
    """Columns with the operators' own names come through with their values and types; exact repeats of a row leave one."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    names = ["score", "lang_pred", "n_letters", "carried", "label", "component_id", "n", "least", "goes", "marked_id", "bucket", "answers", "n_removed", "a.b", "text.x", "a`b"]
    docs = real.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    docs = docs.unionByName(docs.where("doc_id % 3 = 0"))
    before = docs.schema
    for name, step in P.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"test-{name}")
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before]
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
        assert all(r[c] == f"{c} of {r.doc_id}" for r in docs.collect() for c in names)
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert docs.count() > 20


def test_language_goes_by_likeness_at_any_length(spark, sf_dir):
    """Letters in no order go at any length; what the language has of prose stays, short or long."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(3)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n)) for n in (150, 199, 200, 201, 3000)]
    prose = real.where("lang = 'en' and length(text) > 400").first().text
    short = [prose[:n] for n in (40, 150, 199, 201, 400)]
    rows = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate([*junk, *short])]
    kept = {r.doc_id for r in P.language(spark, real.unionByName(spark.createDataFrame(rows, real.schema)), sf_dir).where("doc_id >= 1000000").collect()}
    assert kept == {10**6 + 5 + i for i in range(5)}


def test_run_gives_the_last_stage(spark, sf_dir):
    got = P.run(spark, sf_dir)
    per = collections.Counter()
    for r in got.collect():
        per[r.sequence_id] += r.length
    assert per and max(per.values()) <= 2048


def test_texts_reach_python_in_small_batches(spark, sf_dir, monkeypatch):
    """Stages that send whole texts to Python do so in batches of bounded bytes, whatever the session's setting, which stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key, None), {}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    def told(df, label, batch=None):
        seen[label] = batch
        return stage(df, label, batch)

    docs = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "concat(repeat('some words ', 300), cast(id as string)) as text")
    assert docs.mapInArrow(sizes, "n long").selectExpr("max(n)").first()[0] > 2 * TEXT_BATCH
    assert stage(docs.mapInArrow(sizes, "n long"), "test-sizes", TEXT_BATCH).selectExpr("max(n)").first()[0] < 1.5 * TEXT_BATCH
    monkeypatch.setattr(common, "stage", told)
    monkeypatch.setattr(jaccard, "stage", told)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    P.substrings(spark, P.near_duplicates(spark, real, sf_dir), sf_dir)
    assert all(seen[label] == TEXT_BATCH for label in ("jaccard-survey", "jaccard-prefixes", "jaccard-texts", "jaccard-stars", "jaccard-rest", "chunk-runs"))
    assert spark.conf.get(key, None) == before
