"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.session import stage

#: The rotation is fitted on so many vectors at most, the radius on so many queries; both are chosen by a hash of the id. All vectors are indexed.
MAX_TRAINING_VECTORS, MAX_TRAINING_QUERIES = 10_000, 400
BITS, PARTS, WIDTH = 64, 4, 16
#: All values of a substring, those with few bits first, and how many of them have at most so many.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << WIDTH)), kind="stable").astype(np.int64)
BALLS = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << WIDTH)), minlength=WIDTH + 1))


@dataclass
class Codes:
    """A rotation learned by iterative quantization, and a Hamming radius."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int = BITS

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """64-bit codes as 8 bytes, two a substring."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def fit(sample: np.ndarray, rounds: int = 30, seed: int = 5) -> Codes:
    """Principal axes (random ones beyond the dimensions), then alternating signs and orthogonal rotation. Any number of vectors will do."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    mean = sample.mean(axis=0)
    spread = (sample - mean).T @ (sample - mean) / len(sample)
    axes = np.linalg.svd(spread + 1e-9 * np.eye(dims))[0][:, :BITS]
    if dims < BITS:
        axes = np.concatenate([axes, rng.normal(size=(dims, BITS - dims)) / np.sqrt(dims)], axis=1)
    projected = (sample - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected)
        turn = (u @ v).T
    return Codes(mean, axes @ turn)


def substring_radii(radius: int) -> list[int]:
    """Radii of the substrings by the pigeonhole principle: codes within ``radius`` have one substring within its own; -1 is never probed."""
    spare = radius - PARTS + 1
    return [spare // PARTS + (i < spare % PARTS) for i in range(PARTS)] if spare >= 0 else [0 if i <= radius else -1 for i in range(PARTS)]


class MultiIndex:
    """Buckets of one block of codes, by the value of each 16-bit substring."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words, self.probed = codes.view(np.uint64).ravel(), 0
        parts = codes.view(np.uint16)
        self.order = [np.argsort(parts[:, i], kind="stable") for i in range(PARTS)]
        self.edges = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, i], minlength=1 << WIDTH))]) for i in range(PARTS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``: probe the buckets near each substring, then count all bits."""
        hit = np.zeros(len(self.words), bool)
        for order, edges, value, r in zip(self.order, self.edges, code.view(np.uint16), substring_radii(radius), strict=True):
            near = MASKS[: BALLS[min(r, WIDTH)] if r >= 0 else 0] ^ int(value)
            first, size = edges[near], edges[near + 1] - edges[near]
            first, size = first[size > 0], size[size > 0]
            hit[order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
        rows = np.flatnonzero(hit)
        self.probed += len(rows)
        return rows[np.bitwise_count(self.words[rows] ^ code.view(np.uint64)[0]) <= radius]


def _usable(col: str, dims: int | None = None):
    v = F.col(col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return fine & (F.size(v) == dims) if dims else fine


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _in_blocks(base: DataFrame, asked: DataFrame, k: int, codes: Codes, blocks: int, groups: int) -> DataFrame:
    """(number, query_id, vec_id, score, distance): what each block answers to each query, ``k`` rows at most. A radius of BITS is an exact search."""
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each_block = base.withColumn("block", spread(blocks, 1)).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    each_run = asked.withColumn("run", F.pmod("number", F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["number", "query_id", "vec_id", "score", "distance"]

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.int64))]
        if len(left) and len(right):
            ids, rows = left.column("id").to_numpy(), _matrix(left)
            index, asks = MultiIndex(codes(rows)), _matrix(right)
            for number, me, vector, code in zip(right.column("number").to_numpy(), right.column("id").to_numpy(), asks, codes(asks), strict=True):
                radius, others = codes.radius, None
                while True:
                    near = index.within(code, radius)
                    near = near[ids[near] != me]
                    if len(near) >= k or radius >= BITS:
                        break
                    others = int((ids != me).sum()) if others is None else others
                    if len(near) >= others:
                        break
                    radius = min(BITS, radius + 4)
                score = (rows[near] * vector).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                distance = np.bitwise_count(index.words[near[best]] ^ code.view(np.uint64)[0])
                out.append((np.full(len(best), number), np.full(len(best), me), ids[near][best], score[best], distance.astype(np.int64)))
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    schema = "number long, query_id long, vec_id long, score double, distance long"
    return each_block.groupBy("run", "block").cogroup(each_run.groupBy("run", "block")).applyInArrow(find, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, codes: Codes | None = None, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 32_768, query_rows: int = 32_768) -> DataFrame:
    """The ``k`` vectors with the largest inner product found for each query, its own row left out.

    (query_id, rank from 1, vec_id, score); ties go to the smaller vec_id. Scores are double-precision
    products of the given vectors. Vectors null, zero, of another length than most, or with null or
    non-finite components take no part; nor do null ids. Where ids repeat, each row is a candidate (but for queries of that id) and
    each query row has its own answer. Fewer than ``k`` candidates within the radius are made up by widening the radius in
    that block, so a query gets ``k`` rows whenever there are ``k`` candidates.

    The radius is the least within which MAX_TRAINING_QUERIES of the queries find ``recall`` of their true neighbours among all
    vectors, by an exact search: the more vectors, the nearer the neighbours, and the fewer buckets are probed.

    Every vector is in one block of about ``block_rows`` rows by a hash of its id, and queries, in runs of
    ``query_rows`` at most, meet every block: a stated query set against all rows, in blocks. A block builds
    its multi-index, retrieves by pigeonhole probing and reranks; it sends ``k`` rows per query at most.
    Equal vectors spread over the blocks, so no bucket is hot.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col(id_col).isNotNull() & _usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    total = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if total is None:
        return spark.createDataFrame([], schema)
    dims, count = total["d"], total["count"]
    base = base.where(F.size("v") == dims)
    asked = queries.where(F.col(id_col).isNotNull() & _usable(vec_col, dims)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = stage(asked.withColumn("number", F.monotonically_increasing_id()), "ann-queries")
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    blocks = -(-count // block_rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = lambda n: max(-(-n // query_rows), min(-(-parts // blocks), -(-n // 64)))
    draw = lambda df, wanted, n: df.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(max(1, int((1 << 30) * wanted / n)) if n > wanted else 1 << 30))
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    if codes is None:
        sample = draw(base, MAX_TRAINING_VECTORS, count).orderBy("id", "v").toArrow()
        codes = fit(_matrix(sample if len(sample) else base.limit(MAX_TRAINING_VECTORS).toArrow()))
        tried = draw(asked, MAX_TRAINING_QUERIES, n_queries)
        exact = _in_blocks(base, tried, k, codes, blocks, groups(MAX_TRAINING_QUERIES))
        true = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        near = sorted((r["distance"], r["count"]) for r in true.groupBy("distance").count().collect())
        reached = np.cumsum([c for _, c in near]) if near else np.zeros(0)
        codes.radius = near[int(np.searchsorted(reached, recall * reached[-1]))][0] if near else BITS
    found = _in_blocks(base, asked, k, codes, blocks, groups(n_queries))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
