"""Approximate nearest neighbours by cosine: a stored inverted file of product-quantised vectors.

Unit vectors belong to the cell of their nearest centroid and keep a code of their difference from it, one byte for a few
dimensions. A search looks into the cells nearest to the query, scores codes there by table look-ups, and scores the best of them exactly. An index is
a folder of Parquet tables: ``model`` (centroids and code books), ``postings`` by cell, ``cells`` (rows and blocks of each cell and increment).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.functions.columns import cosine, rank_top
from mnemoloom.operators.retrieval import BLOCK_ROWS, HITS, RUN_ROWS, _best, _checked, _matrix, vector_topk
from mnemoloom.session import stage

#: Bounds of the model: rows that it is fitted on, cells, codes of a part, dimensions of a part; rounds of the fits.
SAMPLE, MOST_CELLS, CODES, PART, ROUNDS = 50_000, 4096, 256, 4, 12
#: Products with centres and look-up tables are made for so many values at once, however many rows, cells or queries there are.
VALUES = 1 << 19
POSTINGS = "cell int, block int, memory_id long, code binary, vector array<double>"


class Model(NamedTuple):
    """Centroids (cells x dimensions) and code books (parts x codes x dimensions of a part, the last padded with zeros)."""

    centroids: np.ndarray
    books: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return nearest(unit, self.centroids)

    def parted(self, rows: np.ndarray) -> np.ndarray:
        width = self.books.shape[0] * self.books.shape[2]
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))).reshape(len(rows), self.books.shape[0], -1)

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.parted(unit - self.centroids[cell])
        return np.stack([nearest(rest[:, m], self.books[m]) for m in range(self.books.shape[0])], axis=1).astype(np.uint8)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def sliced(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows that make ``width`` values each, of about VALUES values."""
    step = max(1, VALUES // max(1, width))
    yield from (slice(a, min(a + step, n)) for a in range(0, n, step))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, out = 0.5 * (centres**2).sum(axis=1), np.empty(len(rows), np.int64)
    for some in sliced(len(rows), len(centres)):
        out[some] = (rows[some] @ centres.T - half).argmax(axis=1)
    return out


def _means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k means; a centre that loses all its rows takes one at random."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS):
        at = nearest(rows, centres)
        count = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def fit(memories: DataFrame, cells: int | None = None, sample: int = SAMPLE, part: int = PART, seed: int = 5) -> Model:
    """The model, from about ``sample`` rows by hash of the id, which is all that comes to the driver. By default as many cells as the root of the row count, MOST_CELLS at most."""
    rows = memories.where("vector is not null and memory_id is not null")
    total = rows.count()
    if not total:
        raise ValueError("no vectors to fit an index on")
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("memory_id", F.lit(seed)), F.lit(1 << 30)) < max(1, int((1 << 30) * sample / total)))
    held = rows.select("memory_id", _checked().alias("vector")).toArrow().sort_by("memory_id")
    unit = unit_rows(_matrix(held))
    n = min(cells or max(1, min(MOST_CELLS, round(total**0.5))), len(unit))
    centroids = _means(unit, n, seed)
    parts = -(-unit.shape[1] // part)
    rest = np.pad(unit - centroids[nearest(unit, centroids)], ((0, 0), (0, parts * part - unit.shape[1]))).reshape(len(unit), parts, part)
    return Model(centroids, np.stack([_means(rest[:, m], min(CODES, len(unit)), seed + m) for m in range(parts)]))


def _save(spark: SparkSession, model: Model, path: str) -> None:
    rows = [("centroid", 0, i, v.tolist()) for i, v in enumerate(model.centroids)] + [("book", m, i, v.tolist()) for m, book in enumerate(model.books) for i, v in enumerate(book)]
    spark.createDataFrame(rows, "kind string, part int, number int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model of a stored index; its size is bounded by MOST_CELLS and CODES."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").collect()
    books: dict[int, list] = {}
    for r in rows:
        if r["kind"] == "book":
            books.setdefault(r["part"], []).append(r["vector"])
    return Model(np.array([r["vector"] for r in rows if r["kind"] == "centroid"]), np.array([books[m] for m in sorted(books)]))


def add_to_index(spark: SparkSession, path: str, memories: DataFrame) -> None:
    """Append rows (memory_id, vector) to a stored index, encoded by its model. Null ids and vectors take no part; zero or NaN vectors raise an error."""
    sent = spark.sparkContext.broadcast(load_model(spark, path))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(_matrix(pa.Table.from_batches([batch])))
                cell = model.cells(unit)
                codes = [c.tobytes() for c in model.codes(unit, cell)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("memory_id"), pa.array(codes, pa.binary()), batch.column("vector")], names=["cell", "memory_id", "code", "vector"])

    rows = memories.where("vector is not null and memory_id is not null").select(F.col("memory_id").cast("long"), _checked().alias("vector"))
    made = stage(rows.mapInArrow(encode, "cell int, memory_id long, code binary, vector array<double>"), "encoded")
    before = _cells(spark, path).select("cell", F.col("blocks").alias("first"))
    counts = made.groupBy("cell").agg(F.count("*").alias("n")).join(before, "cell", "left").select("cell", "n", F.coalesce("first", F.lit(0)).alias("first"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    counts = stage(counts, "cell-counts")
    block = (F.col("first") + F.pmod(F.xxhash64("memory_id"), F.col("blocks"))).cast("int")
    dealt = made.join(F.broadcast(counts), "cell").withColumn("block", block)  # one row a cell, of MOST_CELLS at most
    dealt.select("block", "memory_id", "code", "vector", "cell").repartition("cell", "block").write.mode("append").partitionBy("cell").parquet(f"{path}/postings")
    counts.coalesce(1).select("cell", "n", "blocks").write.mode("append").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell, n, blocks) over all increments."""
    from mnemoloom.session import children

    if "cells" not in children(spark, path):
        return spark.createDataFrame([], "cell int, n long, blocks long")
    return spark.read.schema("cell int, n long, blocks long").parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"))


def build_index(memories: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, part: int = PART) -> str:
    """Fit a model on a bounded sample of ``memories`` (memory_id, vector), encode all of them, and store the index at ``path``."""
    spark = memories.sparkSession
    _save(spark, fit(memories, cells, sample, part), path)
    add_to_index(spark, path, memories)
    return path


def _near_cells(queries: DataFrame, model: Model, probes: int, known: np.ndarray) -> DataFrame:
    """(query_id, cell, place) of the ``probes`` cells nearest to each query among those that hold rows."""
    sent = queries.sparkSession.sparkContext.broadcast((model.centroids[known], known))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, names = sent.value
        for batch in batches:
            if batch.num_rows:
                unit, ids = unit_rows(_matrix(pa.Table.from_batches([batch]))), batch.column("query_id").to_numpy()
                for some in sliced(len(unit), len(centroids)):
                    score = unit[some] @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
                    order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], n)), pa.array(names[order].ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(order)))], names=["query_id", "cell", "place"])

    return queries.mapInArrow(run, "query_id long, cell int, place int")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("long"), _checked().alias("vector"))


def index_topk(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, refine: int = 10, own: bool = True) -> DataFrame:
    """The ``k`` nearest found: (query_id, memory_id, score, rank), score being the exact cosine; on ties the smaller id.

    Each query looks into the ``probes`` nearest cells. A cell's postings are read once for RUN_ROWS queries, in blocks of about BLOCK_ROWS
    rows, which answer with their ``k * refine`` best by codes; the best of those over all blocks meet their vectors by an equi-join on (cell, id).
    Only partitions of cells that some query looks into are scanned. Without ``own``, a query's own id is left out. With as many
    probes as cells and ``k * refine`` rows or fewer, the result is exact.
    """
    model, table = load_model(spark, path), _cells(spark, path).collect()  # MOST_CELLS rows at most
    known = np.array(sorted(r["cell"] for r in table), np.int64)
    asked = stage(_asked(queries), "asked")
    near = stage(_near_cells(asked, model, probes, known), "near-cells")
    looked = sorted(r["cell"] for r in near.select("cell").distinct().collect())
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("cell").isin(looked))
    runs = max(1, -(-asked.count() // RUN_ROWS))
    blocks = F.broadcast(spark.createDataFrame([(r["cell"], r["blocks"]) for r in table], "cell int, blocks long"))
    sides = near.join(asked, "query_id").join(blocks, "cell").withColumn("run", F.pmod(F.xxhash64("query_id"), F.lit(runs)).cast("int"))
    sides = sides.select("query_id", "vector", "cell", "run", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    held = postings.select("cell", "block", "memory_id", "code").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    sent, most = spark.sparkContext.broadcast(model), k * refine

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            m, cell = sent.value, b.column("cell")[0].as_py()
            ids, asks, names = a.column("memory_id").to_numpy(), unit_rows(_matrix(b)), b.column("query_id").to_numpy()
            codes = np.frombuffer(b"".join(a.column("code").to_pylist()), np.uint8).reshape(len(a), -1)
            base, parts = asks @ m.centroids[cell], np.arange(codes.shape[1])
            for some in sliced(len(asks), m.books.shape[0] * m.books.shape[1]):
                tables = np.einsum("qmd,mcd->qmc", m.parted(asks[some]), m.books)
                for name, look, start in zip(names[some], tables, base[some], strict=True):
                    s = start + look[parts, codes].sum(axis=1)
                    if not own:
                        s[ids == name] = -np.inf
                    best = _best(ids, s, most)
                    out.append((np.full(len(best), name), ids[best], s[best], np.full(len(best), cell, np.int32)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        return pa.table(dict(zip(("query_id", "memory_id", "score", "cell"), columns, strict=True)))

    keys = ["cell", "block", "run"]
    found = held.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(score, HITS + ", cell int")
    best = rank_top(found, ["query_id"], most, F.desc("score"), F.asc("memory_id")).select("query_id", "memory_id", "cell")
    vectors = postings.select("cell", "memory_id", F.col("vector").alias("mv"))
    exact = best.join(vectors, ["cell", "memory_id"]).join(asked, "query_id").select("query_id", "memory_id", cosine(F.col("vector"), F.col("mv")).alias("score"))
    return rank_top(exact, ["query_id"], k, F.desc("score"), F.asc("memory_id"))


def probes_for(spark: SparkSession, path: str, memories: DataFrame, k: int, target: float = 0.95, sample: int = 200) -> int:
    """The least number of probes that finds ``target`` of the exact ``k`` nearest of about ``sample`` memories among all others.

    The sample is searched exactly, which is one pass over ``memories``; ``sample * k`` places come to the driver.
    """
    model, table = load_model(spark, path), _cells(spark, path).collect()
    known = np.array(sorted(r["cell"] for r in table), np.int64)
    total = sum(r["n"] for r in table)
    chosen = memories.where(F.pmod(F.xxhash64("memory_id", F.lit(17)), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, sample / total))))
    asks = stage(chosen.select(F.col("memory_id").alias("query_id"), "vector"), "calibration")
    gold = vector_topk(asks, memories, k, own=False).select("query_id", "memory_id")
    cells = spark.read.schema(POSTINGS).parquet(f"{path}/postings").select("memory_id", "cell")
    near = _near_cells(_asked(asks), model, len(known), known)
    places = sorted(r["place"] for r in gold.join(cells, "memory_id").join(near, ["query_id", "cell"]).select("place").collect())
    return places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)] if places else len(known)


def scanned_share(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """One row: queries, the mean share of the index's rows whose codes a query looks at, the share of its cells that any looks into."""
    table = _cells(spark, path)
    known = np.array(sorted(r["cell"] for r in table.select("cell").collect()), np.int64)
    near = _near_cells(_asked(queries), load_model(spark, path), probes, known).join(F.broadcast(table), "cell")
    total = table.agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    each = near.agg(F.countDistinct("query_id").alias("queries"), F.sum("n").alias("looked"), F.countDistinct("cell").alias("touched"))
    return each.crossJoin(total).select("queries", (F.col("looked") / F.col("queries") / F.col("total")).alias("share"), (F.col("touched") / F.col("cells")).alias("cells_share"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, and the share of them that was found."""
    hit = exact.select("query_id", "memory_id").join(found.select("query_id", "memory_id", F.lit(1).alias("hit")), ["query_id", "memory_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"))
