"""Substring dedup by content-defined chunks: a gear rolling hash cuts, a digest decides."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemoloom.llm.common import arrays, bits, merged_spans, rows_of, run_texts, slices, text_runs, unzipped, whole_buckets, without, zipped

GEAR = np.random.default_rng(20_24).integers(0, 1 << 32, 256, np.uint32)


def boundaries(text: bytes, low: int = 10, high: int = 128) -> list[int]:
    """Ends of the chunks of a text. The gear hash h = 2h + G[byte] of 8 bytes; a chunk ends where it is the least of
    ``low - 1`` places on either side, but has ``low`` bytes at least (save the last) and ``high`` at most. Such a place
    depends on some 25 bytes around it alone, so copies fall in step again that soon. Equal least values both count: in
    periodic text there is one in each period, and chunks hold whole periods whatever came before."""
    n, w = len(text), low - 1
    h = GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4):
        if n > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cuts: list[int] = []
    if n > 2 * w:
        least, size = h, 1
        while size < w:
            step = min(size, w - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        cuts = (np.flatnonzero((h[w : n - w] <= least[: n - 2 * w]) & (h[w : n - w] <= least[w + 1 :])) + w + 1).tolist()
    out, start = [], 0
    for cut in cuts:
        while cut - start > high:
            start += high
            out.append(start)
        if cut - start >= low:
            out.append(cut)
            start = cut
    while n - start > high:
        start += high
        out.append(start)
    if start < n:
        out.append(n)
    return out


KEY = np.dtype([("where", "<u8"), ("key", "<u8")])
VOTES = [("bucket", pa.int32()), ("run", pa.int64()), ("keys", pa.binary()), ("least", pa.binary())]
ANSWERS = [("run", pa.int64()), ("bucket", pa.int32()), ("copied", pa.binary())]


def _cut(ids: list, texts: list[bytes], buckets: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Of a run's texts: the ends of their chunks; the text number of each chunk; its (bucket, key) by digest. Texts without an id have no chunks here."""
    ends = [boundaries(t) for t in texts]
    digests, owner = [], []
    for i, (text, own) in enumerate(zip(texts, ends, strict=True)):
        if ids[i] is None:
            continue
        start = 0
        for end in own:
            digests.append(hashlib.blake2b(text[start:end], digest_size=16).digest())
            start = end
        owner += [i] * len(own)
    keys = np.frombuffer(b"".join(digests), KEY).copy()
    keys["where"] %= np.uint64(buckets)
    return ends, np.array(owner, np.int64), keys


def _distinct(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run's distinct keys, sorted; the least id that has each; and for each chunk the number of its key."""
    order = np.lexsort((own, keys["key"], keys["where"]))
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[order[new]], own[order[new]], place


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run and bucket: bits of the keys that a smaller document than any of the run has. One bucket is worked on at a time."""
    for bucket, rows in whole_buckets(batches):
        raw = [np.frombuffer(r["keys"], "<u8") for r in rows]
        key, least = np.concatenate(raw), np.concatenate([np.frombuffer(unzipped(r["least"], 8 * len(k)), "<i8") for r, k in zip(rows, raw, strict=True)])
        order = np.lexsort((least, key))
        new = np.append(True, key[order][1:] != key[order][:-1])
        first = least[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        copied = np.zeros(len(order), bool)
        copied[order] = least[order] > first
        out: list[list] = [[] for _ in ANSWERS]
        at = 0
        for r, k in zip(rows, raw, strict=True):
            mine = copied[at : at + len(k)]
            at += len(k)
            if mine.any():
                for column, x in zip(out, (r["run"], bucket, np.packbits(mine).tobytes()), strict=True):
                    column.append(x)
        yield arrays(ANSWERS, out)


RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("n_copied", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string()), ("text", pa.string())]
RESULT_DDL = "doc_id long, n_bytes long, n_chunks long, n_copied long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept_sha256 string, text string"


def copied_spans(ends: list[int], copied: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    """Runs of neighbouring copied chunks that hold ``min_run`` bytes at least."""
    stops = np.array(ends, np.int64)[copied]
    starts = np.array([0, *ends[:-1]], np.int64)[: len(ends)][copied]
    return [(a, b) for a, b in merged_spans(starts, stops) if b - a >= min_run]


def dedup_substrings(docs: DataFrame, min_run: int = 128, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, carried: list[str] | None = None) -> DataFrame:
    """Remove from each text the passages that a document with a smaller id has too: one row per document.

    Columns: doc_id, n_bytes, n_chunks, n_copied (chunks in the passages removed),
    n_removed, n_spans, spans (byte ranges removed), kept_sha256, text (what is left, invalid UTF-8 at
    a cut dropped). A passage goes if it covers neighbouring copied chunks of ``min_run`` bytes or
    more; single chunks that agree by chance or in a set phrase stay. Of equal passages that in the
    smallest doc_id stays whole. Repeats inside one document are not touched.

    Defined cases: null text is empty; a null doc_id neither removes nor loses anything; rows that
    repeat a doc_id with the same text get equal results and do not remove each other's text; extra
    columns are ignored, but those named in ``carried`` come back in a struct column ``carried``.

    Scale: texts are stored once, in compressed runs, and meet their answers by run number. A run tells each bucket its distinct
    keys (64 bits of the digest, besides those that chose the bucket) with the least document that has them, so a key that every document has
    comes once a run; the number of buckets follows the bytes of the table, and a bucket is worked on alone. The answer is a bit a key.
    """
    table, n = text_runs(docs, "chunk-runs", id_col, text_col, carried)
    n = buckets or n

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                _, owner, keys = _cut(row["ids"], run_texts(row), n)
                keys, least, _ = _distinct(np.array([i or 0 for i in row["ids"]], np.int64)[owner], keys)
                out: list[list] = [[] for _ in VOTES]
                for k, i, j in slices(keys["where"].astype(np.int64)):
                    for column, x in zip(out, (k, row["run"], keys["key"][i:j].tobytes(), zipped(least[i:j].astype("<i8").tobytes())), strict=True):
                        column.append(x)
                yield arrays(VOTES, out)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = batch.select(["ids", "sizes", "size", "z", "answers"])
            for number, row in enumerate(rows_of(slim)):
                texts = run_texts(row)
                ends, owner, keys = _cut(row["ids"], texts, n)
                own = np.array([i or 0 for i in row["ids"]], np.int64)[owner]
                keys, least, place = _distinct(own, keys)
                elsewhere, answer = np.zeros(len(keys), bool), {a["bucket"]: a["copied"] for a in row["answers"] or ()}
                for k, i, j in slices(keys["where"].astype(np.int64)):
                    if k in answer:
                        elsewhere[i:j] = bits(answer[k], j - i)
                copied = elsewhere[place] | (own > least[place])
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                out: list[list] = [[] for _ in RESULT]
                for i, (doc, text) in enumerate(zip(row["ids"], texts, strict=True)):
                    mine = copied[cuts[i] : cuts[i + 1]]
                    spans = copied_spans(ends[i], mine, min_run) if mine.any() else []
                    gone = sum(bisect_right(ends[i], b) - bisect_right(ends[i], a) for a, b in spans)
                    kept = without(text, spans)
                    for column, x in zip(out, (doc, len(text), len(ends[i]), gone, len(text) - len(kept), len(spans), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                        column.append(x)
                made = arrays(RESULT, out)
                if carried:
                    along = batch.column("carried")[number].values
                    made = pa.RecordBatch.from_arrays([*made.columns, pa.concat_arrays([along])], names=[*made.schema.names, "carried"])
                yield made

    votes = table.select("run", "ids", "sizes", "size", "z").mapInArrow(cast, "bucket int, run long, keys binary, least binary")
    found = votes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "run long, bucket int, copied binary")
    answers = found.groupBy("run").agg(F.collect_list(F.struct("bucket", "copied")).alias("answers"))
    schema = StructType.fromDDL(RESULT_DDL)
    if carried:
        schema = schema.add("carried", table.schema["carried"].dataType.elementType)
    return table.join(answers, "run", "left").mapInArrow(finish, schema)
