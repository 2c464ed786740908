"""Lexical search, BM25 and TF-IDF, on a stored inverted index.

Documents lie in blocks of bounded size. An index is a folder of Parquet tables: ``lists`` (block, token, the places in the block of the documents that
have it, how often; and a row without a token for the block's ids and lengths), a folder for each increment; ``terms`` (token, document frequency) and ``stats``
(documents, tokens), appended to by each; and ``norms-N`` (block, TF-IDF norms) of the first N. Texts are tokenised once, when they come in. A
search reads the lists of the queries' tokens; blocks meet runs of queries and answer with their own best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.functions.columns import rank_top
from mnemoloom.operators.retrieval import HITS, RUN_ROWS, _best
from mnemoloom.session import children, rename_folder, stage

#: Documents and bytes of text of a block, about.
BLOCK_DOCS, BLOCK_BYTES = 16_384, 4 << 20
LISTS = [("block", pa.int64()), ("token", pa.string()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
LISTS_DDL = "block long, token string, places array<int>, tfs array<int>, ids array<long>, lengths array<int>"


def _inverted(table: pa.Table) -> pa.Table:
    """A block's documents (id, tokens) as inverted lists, and a row without a token that holds its ids and lengths."""
    table = table.sort_by("id")
    block, ids, lists = table.column("block")[0].as_py(), table.column("id").to_numpy(), table.column("tokens").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
    pair, tf = np.unique(rank[coded.indices.to_numpy()] << 32 | place, return_counts=True)
    token = pair >> 32
    ends = np.searchsorted(token, np.arange(len(order) + 1)).astype(np.int32)
    offsets = pa.array(np.append(ends, ends[-1]))
    one = pa.array(np.append(np.zeros(len(order) + 1, np.int32), np.int32(len(ids))))
    none = np.append(np.zeros(len(order), bool), True)
    columns = [pa.array(np.full(len(order) + 1, block)), pa.concat_arrays([coded.dictionary.take(pa.array(order)), pa.nulls(1, pa.string())]),
               pa.ListArray.from_arrays(offsets, pa.array((pair & 0xFFFFFFFF).astype(np.int32)), mask=pa.array(none)), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)), mask=pa.array(none)),
               pa.ListArray.from_arrays(one, pa.array(ids), mask=pa.array(~none)), pa.ListArray.from_arrays(one, pa.array(lengths.astype(np.int32)), mask=pa.array(~none))]
    return pa.Table.from_arrays(columns, names=[n for n, _ in LISTS])


def add_documents(spark: SparkSession, path: str, docs: DataFrame, tokens, ident: str = "doc_id", text: str = "text") -> str:
    """Index ``docs`` (not there yet) into ``path``.

    ``tokens`` makes an array of words from a text column. Null ids take no part; a text without tokens counts as a document.
    """
    rows = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    known = children(spark, path)
    first = 0 if "stats" not in known else spark.read.parquet(f"{path}/stats").agg(F.sum("blocks")).first()[0]
    blocks = max(1, -(-n // BLOCK_DOCS), -(-size // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)) + first).repartition(min(blocks, 100_000), "block")  # texts move as they are, and are tokenised by as many tasks as there are blocks
    listed = dealt.select("block", "id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    name = f"lists/increment={len(_increments(spark, path)):06d}"
    listed.groupBy("block").applyInArrow(_inverted, LISTS_DDL).write.parquet(f"{path}/{name}")
    made = spark.read.schema(LISTS_DDL).parquet(f"{path}/{name}")
    made.where("token is not null").groupBy("token").agg(F.sum(F.size("places").cast("long")).alias("df")).write.mode("append").parquet(f"{path}/terms")
    total = F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))
    made.where("token is null").agg(F.lit(n).cast("long").alias("n"), total.alias("total"), F.lit(blocks).cast("long").alias("blocks")).write.mode("append").parquet(f"{path}/stats")
    return path


def _increments(spark: SparkSession, path: str) -> list[str]:
    return children(spark, f"{path}/lists")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS_DDL).parquet(f"{path}/lists").where("token is not null").select("block", "token", "places", "tfs")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS_DDL).parquet(f"{path}/lists").where("token is null").select("block", "ids", "lengths")


def _stats(spark: SparkSession, path: str) -> tuple[int, float]:
    n, total = spark.read.parquet(f"{path}/stats").agg(F.sum("n"), F.sum("total")).first()
    return n, total / n if n else 0.0


def _terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, df long").parquet(f"{path}/terms").groupBy("token").agg(F.sum("df").alias("df"))


def norms_of(spark: SparkSession, path: str) -> DataFrame:
    """(block, norms) of all documents under the statistics of all increments. Made once an increment, when first asked for, from the postings alone."""
    newest = f"{path}/norms-{len(_increments(spark, path)):06d}"
    if newest.rpartition("/")[2] not in children(spark, path):
        _renorm(spark, path, newest)
    return spark.read.parquet(newest)


def _renorm(spark: SparkSession, path: str, to: str) -> None:
    n, _ = _stats(spark, path)

    def norms(lists: pa.Table, docs: pa.Table) -> pa.Table:
        out = []
        for block, lengths in zip(docs.column("block").to_pylist(), docs.column("lengths").to_pylist(), strict=True):
            flat = lists.column("places").combine_chunks() if len(lists) else pa.array([], pa.list_(pa.int32()))
            places = flat.flatten().to_numpy()
            tf = lists.column("tfs").combine_chunks().flatten().to_numpy() if len(lists) else np.zeros(0)
            df = np.repeat(lists.column("df").to_numpy(), pc.list_value_length(flat).to_numpy()) if len(lists) else np.zeros(0)
            w = tf / np.array(lengths, float)[places] * (np.log((1 + n) / (1 + df)) + 1)
            out.append((block, np.sqrt(np.bincount(places, w * w, len(lengths)))))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "norms": pa.array([x.tolist() for _, x in out], pa.list_(pa.float64()))})

    lists = _postings(spark, path).join(_terms(spark, path).hint("shuffle_hash"), "token")  # the lists need not be sorted by token
    docs = _documents(spark, path).select("block", "lengths")
    made = lists.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(norms, "block long, norms array<double>")
    made.write.parquet(f"{to}.tmp")
    rename_folder(spark, f"{to}.tmp", to)


def _asked(spark: SparkSession, path: str, queries: DataFrame, tokens) -> DataFrame:
    """(query_id, token, qtf, ql, df) of the queries' distinct tokens; df is 0 for unknown ones."""
    q = queries.select("query_id", tokens(F.col("text")).alias("t")).select("query_id", F.size("t").alias("ql"), F.explode("t").alias("token")).groupBy("query_id", "ql", "token").agg(F.count("*").alias("qtf"))
    return stage(q.join(_terms(spark, path), "token", "left").fillna(0, ["df"]), "asked")


def _search(spark: SparkSession, path: str, asked: DataFrame, k: int, digits: int, impact, combine, normed: bool) -> DataFrame:
    """``impact(tf, length, token's columns)`` is what postings add to their documents; ``combine(sum, shared, norms, query's row)`` the score."""
    docs = _documents(spark, path)
    docs = docs.join(norms_of(spark, path), "block") if normed else docs.withColumn("norms", F.lit(None).cast("array<double>"))
    lists = _postings(spark, path).join(asked.select("token").distinct(), "token", "left_semi")
    nothing = lambda kind: F.lit(None).cast(kind)
    left = lists.select("block", "token", "places", "tfs", nothing("array<long>").alias("ids"), nothing("array<int>").alias("lengths"), nothing("array<double>").alias("norms"))
    left = left.unionByName(docs.select("block", nothing("string").alias("token"), nothing("array<int>").alias("places"), nothing("array<int>").alias("tfs"), "ids", "lengths", "norms"))
    runs = max(1, -(-asked.select("query_id").distinct().count() // RUN_ROWS))
    every = docs.select("block")
    left = left.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    right = asked.withColumn("run", F.pmod(F.xxhash64("query_id"), F.lit(runs)).cast("int")).join(F.broadcast(every), how="cross")  # a row a block

    def answer(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        own = a.filter(pc.is_null(a.column("token")))
        if len(own) and len(b):
            ids, lengths, norms = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "lengths", "norms"))
            norms = norms if len(norms) else lengths  # not asked for
            said = a.filter(pc.is_in(a.column("token"), b.column("token")))
            b = b.sort_by([("query_id", "ascending"), ("token", "ascending")])
            at = pc.fill_null(pc.index_in(b.column("token"), said.column("token").combine_chunks()), -1).to_numpy()
            columns = {c: b.column(c).to_numpy() for c in b.column_names if c != "token"}
            places, tfs = (said.column(c).combine_chunks() for c in ("places", "tfs"))
            sizes = pc.list_value_length(places).to_numpy()
            starts, places = np.cumsum(sizes) - sizes, places.flatten().to_numpy()
            asks = np.zeros(len(said), np.int64)  # a row that asks for the token
            asks[at[at >= 0]] = np.flatnonzero(at >= 0)
            adds = impact(tfs.flatten().to_numpy(), lengths[places], {c: np.repeat(v[asks], sizes) for c, v in columns.items() if v.dtype == float})
            heads = np.flatnonzero(np.append(True, np.diff(columns["query_id"]) != 0))
            for start, stop in zip(heads, np.append(heads[1:], len(b)), strict=True):
                known = start + np.flatnonzero(at[start:stop] >= 0)
                if not len(known):
                    continue
                n, first = sizes[at[known]], starts[at[known]]
                of = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())  # its tokens' postings, list by list
                sums = np.bincount(places[of], np.repeat(columns["qw"][known], n) * adds[of], len(ids))
                shared = np.bincount(places[of], minlength=len(ids))
                hit = np.flatnonzero(shared)
                q = {c: v[start] for c, v in columns.items()}
                score = np.round(combine(sums[hit], shared[hit], norms[hit], q), digits)
                score[score <= 0] = -np.inf
                best = _best(ids[hit], score, k)
                out.append((np.full(len(best), q["query_id"], np.int64), ids[hit][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "memory_id", "score"), columns, strict=True)))

    found = left.groupBy("block", "run").cogroup(right.groupBy("block", "run")).applyInArrow(answer, HITS)
    return rank_top(found, ["query_id"], k, F.desc("score"), F.asc("memory_id"))


def bm25_search(spark: SparkSession, path: str, queries: DataFrame, tokens, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 9) -> DataFrame:
    """BM25 with idf ln((N - df + .5) / (df + .5) + 1): (query_id, memory_id, score, rank). A token repeated in the query counts each time; only scores above 0, rounded to ``digits``."""
    n, mean = _stats(spark, path)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = _asked(spark, path, queries, tokens).select("query_id", "token", (F.col("qtf") * idf).alias("qw"))
    return _search(spark, path, asked, k, digits, lambda tf, length, _: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), lambda sums, *_: sums, False)


def tfidf_search(spark: SparkSession, path: str, queries: DataFrame, tokens, k: int, overlap_weight: float = 0.35, digits: int = 9) -> DataFrame:
    """``overlap_weight`` * share of the query's tokens + the rest * TF-IDF cosine, idf ln((1 + N) / (1 + df)) + 1, tf as a share; scores of 0 drop out."""
    n, _ = _stats(spark, path)
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    weighed = _asked(spark, path, queries, tokens).select("query_id", "token", idf.alias("idf"), (F.col("qtf") / F.col("ql") * idf).alias("qw"))
    whole = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"), F.count("*").alias("n_tokens"))
    asked = stage(weighed.join(whole, "query_id"), "asked")
    score = lambda sums, shared, norms, q: overlap_weight * shared / q["n_tokens"] + (1 - overlap_weight) * sums / (q["qn"] * norms)
    return _search(spark, path, asked, k, digits, lambda tf, length, r: tf / length * r["idf"], score, True)
