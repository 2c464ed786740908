"""Scans, sinks and stable keys: nested conversations, chunk files, banks, shards, splits, caches, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import c
from mnemoloom.operators.segments import numbered

CONVERSATION = """character_profile struct<name:string,persona_summary:string>, multi_session_dialogues array<struct<session_id:string,date:string,
    dialogues:array<struct<round:string,user:string,assistant:string,input_image:array<string>,image_id:array<string>,image_caption:array<string>>>>>"""
TURNS = """sample_id string, sessions array<struct<session_id:string,dialogue:array<struct<role:string,content:string,timestamp:string,
    attachments:array<struct<image_id:string,file_path:string,caption:string>>>>>>"""
CHUNK = "chunk_id string, text string, images array<string>, metadata map<string,string>"


def read_conversations(spark: SparkSession, path: str, layout: str = "rounds", multi_line: bool = True) -> DataFrame:
    """One row per round (``rounds``) or per turn (``turns``) of nested JSON conversations, in file order.

    A file holds one conversation or an array of them; without ``multi_line``, one on each line, so that large files can be split.
    """
    if layout == "turns":
        x = spark.read.schema(TURNS).option("multiLine", multi_line).json(path)
        x = x.select("sample_id", F.posexplode("sessions").alias("session_no", "s"))
        return x.select("sample_id", "session_no", "s.session_id", F.posexplode("s.dialogue").alias("turn", "t")).select("sample_id", "session_no", "session_id", "turn", "t.*")
    if layout != "rounds":
        raise ValueError(f"unknown layout {layout!r}")
    x = spark.read.schema(CONVERSATION).option("multiLine", multi_line).json(path).withColumn("file", F.col("_metadata.file_path"))
    x = x.select("file", F.col("character_profile.name").alias("character"), F.posexplode("multi_session_dialogues").alias("session_no", "s"))
    return x.select("file", "character", "session_no", "s.session_id", "s.date", F.posexplode("s.dialogues").alias("round_no", "d")).select("file", "character", "session_no", "session_id", "date", "round_no", "d.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.select("chunk_id", "text", "images", "metadata").write.mode("overwrite").json(path)


def explode_haystack(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """One row per place of parallel arrays; arrays of unequal length are an error."""
    sizes = F.array_distinct(F.array(*(F.size(a) for a in arrays)))
    fine = F.when(F.size(sizes) > 1, F.raise_error(F.lit("arrays of unequal length"))).otherwise(F.arrays_zip(*arrays))
    return df.select(*keep, F.posexplode(fine).alias("place", "z")).select(*keep, "place", *(F.col(f"z.{a}").alias(a) for a in arrays))


def filter_questions(df: DataFrame, excluded: str, order: str, categories: list[str]) -> DataFrame:
    """Questions whose category (the first one given of ``categories``) is not in a comma list, case and blanks aside; ordinals are those before the filter."""
    labels = [x.strip().lower() for x in excluded.split(",") if x.strip()]
    category = F.coalesce(*map(F.col, categories), F.lit(""))
    w = Window.partitionBy("dataset").orderBy(order)
    return df.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("category", category).where(~F.lower(F.trim("category")).isin(labels))


def natural_key(ident: Column | str) -> Column:
    """(all digits as one number or 0, the id): ids sort by their numbers."""
    digits = F.regexp_replace(c(ident), "[^0-9]", "")
    return F.struct(F.coalesce(digits.try_cast("long"), F.lit(0)).alias("number"), c(ident).alias("id"))


def merge_features(shards: list[DataFrame]) -> DataFrame:
    """Union of (id, vector) shards; of a repeated id that of the first shard stays."""
    every = None
    for i, s in enumerate(shards):
        s = s.select("id", "vector", F.lit(i).alias("shard"))
        every = s if every is None else every.unionByName(s)
    return every.groupBy("id").agg(F.min_by("vector", "shard").alias("vector"), F.min("shard").alias("shard"))


def save_bank(df: DataFrame, path: str) -> int:
    """Write memories partitioned by bank and check that all came back, each with a vector if it had one."""
    df.write.mode("overwrite").partitionBy("bank").parquet(path)
    want = df.agg(F.count("*"), F.count("vector")).first()
    got = load_bank(df.sparkSession, path).agg(F.count("*"), F.count("vector")).first()
    if want != got:
        raise ValueError(f"wrote {want}, read {got}")
    return got[0]


def load_bank(spark: SparkSession, path: str, bank: str | None = None) -> DataFrame:
    x = spark.read.parquet(path)
    return x if bank is None else x.where(F.col("bank") == bank)


def with_embedding(df: DataFrame, text: str, fn: Callable[[pd.Series], Iterable], dim: int, out: str = "vector") -> DataFrame:
    """Vectors from a given batch function; a wrong dimension or NaN gives a null vector and an error text, not a failed job."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{out} array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: list(fn(pdf[text]))})

    made = df.mapInPandas(run, schema)
    bad = F.when(F.size(out) != dim, F.lit("dimension")).when(F.exists(out, lambda x: x.isNull() | F.isnan(x)), F.lit("not a number"))
    return made.withColumn("error", bad).withColumn(out, F.when(F.col("error").isNull(), F.col(out)))


def latest_by_key(df: DataFrame, key: list[str], order: str, valid: Column | None = None) -> DataFrame:
    """The last valid row of each key of an append-only log."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    rows = df if valid is None else df.where(valid)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_report(df: DataFrame, path: str, fmt: str) -> None:
    """An aggregated frame as csv, json or a markdown table (one file, written by Spark)."""
    if fmt == "markdown":
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in df.columns)), F.lit(" |"))
        head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "n long, value string").unionByName(df.select((F.monotonically_increasing_id() + 2).alias("n"), cells.alias("value")))
        lines.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
    elif fmt == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def read_split(df: DataFrame, n: int, i: int, key: str) -> DataFrame:
    """Contiguous split ``i`` of ``n`` in key order, ceil(N / n) rows each.

    Rows are numbered once and stored with their number: range partitions are drawn from a sample, so a second run would deal rows otherwise than the first.
    """
    table = numbered(df.select(F.lit(0).alias("_all"), F.struct("*").alias("_row")), "_all", [F.col(f"_row.{key}")])
    size = table.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / n)).alias("_size"))
    return table.join(F.broadcast(size)).where(F.floor(F.col("idx") / F.col("_size")) == i).select("_row.*")


def with_query_id(df: DataFrame) -> DataFrame:
    """``dataset::ordinal::category::`` and 16 hex digits of a SHA-1 over category, question, image path and caption."""
    digest = F.substring(F.sha1(F.concat_ws("\n", *(F.coalesce(F.col(x), F.lit("")) for x in ("category", "question", "image_path", "caption")))), 1, 16)
    return df.withColumn("query_id", F.concat_ws("::", "dataset", F.col("ordinal").cast("string"), "category", digest))


def attach_vectors(queries: DataFrame, vectors: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries with their cached vectors, and the ids that have none. With ``strict`` a missing id is an error when the rows are read."""
    x = queries.join(vectors, "query_id", "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no cached vector for "), F.col("query_id").cast("string")))
        return x.withColumn("vector", F.when(F.col("vector").isNull(), lost).otherwise(F.col("vector"))), x.where(F.lit(False)).select("query_id")
    return x.where("vector is not null"), x.where("vector is null").select("query_id")


def fetch_ranges(messages: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Messages (msg_id, ..) of closed id ranges (range_no, low, high), by slots of ``width`` ids; overlapping ranges repeat a message."""
    m = messages.withColumn("slot", F.floor(F.col("msg_id") / width))
    r = ranges.withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    return m.join(r, (m["slot"] == r["slot"]) & F.col("msg_id").between(F.col("low"), F.col("high"))).select("range_no", *messages.columns)


def fetch_time(messages: DataFrame, start, end) -> DataFrame:
    return messages.where(F.col("ts").between(F.lit(start), F.lit(end)))


def fetch_latest(messages: DataFrame, n: int) -> DataFrame:
    return messages.orderBy(F.desc("msg_id")).limit(n)
