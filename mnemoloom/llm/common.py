"""Small helpers shared by the operators of this subpackage: runs of texts, packed rows, spans of bytes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from mnemoloom.session import TEXT_BATCH, stage

#: Texts are worked on in runs of about so many bytes, whatever the Arrow batch holds.
RUN_BYTES = 4 << 20
#: The substring operators store texts in runs of RUN bytes at least; a run and a bucket are taken to have PAIR bytes of the text to share.
RUN, PAIR = 1 << 20, 10_000


def quoted(column: str) -> str:
    """A column's name as F.col takes it, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def runs(batches: Iterable[pa.RecordBatch], column: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into zero-copy slices whose ``column`` holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        else:
            ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def blobs(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column as bytes; null is empty."""
    binary = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    return [x or b"" for x in binary.to_pylist()]


def arrays(ddl_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    """A record batch from Python lists or numpy arrays, typed."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, ddl_types, strict=True)], names=[n for n, _ in ddl_types])


def whole_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one bucket after another, of rows sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = row["bucket"]
            rows.append(row)
    if rows:
        yield bucket, rows


def dealt(total: int, least: int, pair: int, parts: int) -> tuple[int, int]:
    """(size of a run, number of buckets) for ``total`` bytes or rows.

    Each run sends a row to each bucket. Runs and buckets both grow as the square root of the input, so that these rows, one for each ``pair`` of the
    input, grow as the input does; what a task holds at once grows as the root. There are no fewer buckets than a shuffle has partitions.
    """
    size = max(least, math.isqrt(pair * total))
    return size, max(4, parts, total // size)


def text_runs(docs: DataFrame, label: str, id_col: str, text_col: str, carried: list[str] | None = None) -> tuple[DataFrame, int]:
    """Whole texts (null: empty) in stored runs, one row each, and the number of buckets that their keys are dealt to.

    (run, ids, sizes, size, z): numbers of the run and its documents, the texts' bytes one by one and in all, and the texts in UTF-8 and
    zstd. ``carried`` columns come along as an array of structs. Everything later is keyed by run, so texts need not be dealt by document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    along = [F.struct(*(F.col(quoted(c)) for c in carried)).alias("carried")] if carried else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *along)
    schema = StructType([StructField("run", LongType()), StructField("ids", ArrayType(LongType())), StructField("sizes", ArrayType(LongType())), StructField("size", LongType()), StructField("z", BinaryType())])
    names = [f.name for f in schema]
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    limit, buckets = dealt(total, RUN, PAIR, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if carried:
        schema = schema.add("carried", ArrayType(rows.schema["carried"].dataType))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            texts = [t for batch in held for t in blobs(batch.column("text"))]
            raw = b"".join(texts)
            ends = pa.array([0, len(texts)], pa.int32())
            listed = lambda c: pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column(c) for batch in held]))
            columns = [pa.array([part << 32 | count]), listed("doc_id"), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([len(raw)]), pa.array([zipped(raw)]), *([listed("carried")] if carried else [])]
            return pa.RecordBatch.from_arrays(columns, names=names + ["carried"] * bool(carried))

        for batch in runs(batches, "text", limit):
            held.append(batch)
            size += sum(map(len, blobs(batch.column("text"))))
            if size >= limit:
                yield row()
                count, held, size = count + 1, [], 0
        if held:
            yield row()

    return stage(rows.mapInArrow(gather, schema), label, TEXT_BATCH), buckets


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, for rows of megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def run_texts(row: dict) -> list[bytes]:
    raw, ends = unzipped(row["z"], row["size"]), np.cumsum([0, *row["sizes"]]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def zipped(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def unzipped(z: bytes, size: int) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True) if size else b""


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of a sorted column of buckets."""
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    yield from zip(bucket[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(bucket)][: len(heads)], strict=True)


def merged_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of [start, stop) spans as maximal runs; touching spans are one run."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(stops)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist(), strict=True))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)
