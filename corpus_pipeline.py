"""A training corpus from ``documents``: language filter, near-duplicate removal, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.llm import chunks, jaccard, langid, packing
from mnemoloom.llm.common import quoted
from mnemoloom.llm.queries import tokenizer_path
from mnemoloom.session import stage, table

#: A text of n letters resembles no language if its best cosine is below MIN_SCORE * sqrt(n / (n + LETTERS)): few letters are little evidence
#: either way, so the bound falls smoothly with them. Random letters stay below it, prose of known languages well above.
MIN_SCORE, LETTERS = 0.15, 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages. Texts without letters go, and those that resemble none.

    Null, empty and blank texts go. Rows that repeat are judged alike. Columns pass through as they are, whatever their names. An empty
    table, or one without labelled texts to learn from, gives no rows.
    """
    whole = docs.select("text", F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("carried"))
    found = langid.predict(whole, langid.train(docs))
    bound = MIN_SCORE * F.sqrt(F.col("n_letters") / (F.col("n_letters") + LETTERS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= bound)).select(*(c if c == "text" else F.col("carried." + quoted(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 on five-word shingles connect, that with the smallest id.

    Rows without an id stay, and so do documents without words, each of which is its own group. Of rows with equal id and text one stays; rows
    of one id with different texts are one document, and stay or go together. Other columns pass through; an empty table gives no rows.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    marks = groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")).where("doc_id <> least or n > 1")
    marks = stage(marks.select("doc_id", (F.col("doc_id") != F.col("least")).alias("goes")), "pipeline-marks")
    rows = docs.select("doc_id", "text", F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text"))).alias("carried"))
    single = rows.join(marks, "doc_id", "left_anti")
    repeated = rows.join(marks.where("not goes"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*(c if c in ("doc_id", "text") else F.col("carried." + quoted(c)) for c in docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; documents of which nothing is left go.

    Null text becomes empty; empty texts, rows without an id and rows that repeat stay; n_chars follows the text that is left; other columns
    pass through whatever their names; an empty table gives no rows.
    """
    found = chunks.dedup_substrings(docs, carried=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("carried.n_chars"))}
    left = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.select(*((new[c] if c in new else F.col("carried." + quoted(c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Null and empty texts are their end token; rows that repeat are packed each; see ``packing.pack``."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packed)]

#: SQL can express none of the stages' models, hashes and tokenizers; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
