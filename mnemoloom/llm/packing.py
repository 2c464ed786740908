"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoloom.llm.common import arrays, runs
from mnemoloom.session import stage

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("part", pa.int64()), ("done", pa.bool_())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, part long, done boolean"
END_ID = 1
ENCODERS: dict = {}


def _is_plain(spec: dict) -> bool:
    """Whether a file is the byte-level BPE that tiktoken runs alike: no normalizer, the usual word pattern, merges in the order of their ids."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(usual and spec.get("normalizer") is None and model["type"] == "BPE" and not model.get("ignore_merges") and made == sorted(set(made)))


class Encoder:
    """Token ids as the tokenizers library gives them.

    A plain byte-level BPE is run by tiktoken on the same vocabulary, which gives equal ids four times as fast. What its word
    pattern can't take (runs of hundreds of thousands of white-space characters), and files of another kind, go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.path, self.exact, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _is_plain(spec):
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special.values()}
        # Fixed value: the word pattern of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        if self.exact is None:
            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizers file, made once a worker."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


class Windows:
    """At most ``keep`` open windows. ``add`` returns windows that closed."""

    def __init__(self, size: int, keep: int) -> None:
        self.size, self.keep, self.open, self.count = size, keep, [], 0

    def add(self, length: int, piece: tuple) -> list[list[tuple]]:
        """Best fit: the open window that ``piece`` leaves least room in; else a new one, for which the fullest makes way."""
        closed = []
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number, pieces = self.open.pop(at)
        else:
            if len(self.open) >= self.keep:
                closed.append(self.open.pop(0)[2])
            room, number, pieces = self.size, self.count, []
            self.count += 1
        pieces.append(piece)
        if room == length:
            closed.append(pieces)
        else:
            insort(self.open, (room - length, number, pieces))
        return closed

    def fits(self, length: int) -> bool:
        return bool(self.open) and self.open[-1][0] >= length or len(self.open) < self.keep

    def fullest_room(self) -> int:
        return self.open[0][0]


def stored_tokens(fill: int, size: int) -> int:
    """Padded length of a sequence: a power of two stays as it is, all else is padded to ``size``."""
    return fill if fill & (fill - 1) == 0 else size


def _rows(windows: list[tuple[list[tuple], int, bool]], part: int, size: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in FIELDS]
    for pieces, sequence, done in windows:
        total, offset = stored_tokens(sum(p[2] for p in pieces), size), 0
        for p in pieces:
            for column, v in zip(out, (*p, sequence, offset, total, part, done), strict=True):
                column.append(v)
            offset += p[2]
    return arrays(FIELDS, out)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, keep: int = 64, min_piece: int = 16, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of every document, and an end id after each, into sequences of at most ``size`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (CRC-32 of the
    ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset and sequence_tokens (the
    sequence's stored length with padding).

    Each task keeps ``keep`` open windows. Whole windows are cut off a long document at once; what
    remains goes, uncut, to the open window it fills best. When none has room, the fullest closes: if
    ``min_piece`` or more places are free in it, the head of the document is cut to fill them. The
    windows still open at the end (``keep`` a task at most) are merged in rounds of ``fan_in`` tasks
    to one, decreasing best fit on whole pieces; each round closes windows that are 97 % full, and the
    last round closes all. No task ever holds more than ``fan_in * keep`` windows, whatever the table.

    Defined cases: null or empty text gives the end id alone; a null id and repeated rows are packed
    like any other row; extra columns are ignored; an empty table gives no rows.

    Recovery: every round is written to the shared folder before the next reads it, so a lost executor
    repeats tasks of one round only. Sequence ids come from (round, task, number): unique, not dense.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, windows, number, code = TaskContext.get().partitionId(), Windows(size, keep), 0, encoder(tokenizer)
        base = part << 32

        def close(closed: list[list[tuple]]) -> list[tuple]:
            nonlocal number
            out = [(pieces, base + number + i, True) for i, pieces in enumerate(closed)]
            number += len(closed)
            return out

        for batch in runs(batches, "text"):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(code(text or ""), END_ID).astype("<u4")
                total, start = len(ids), 0
                raw = ids.tobytes()

                def piece(a: int, b: int, doc=doc, raw=raw, total=total) -> tuple:
                    return doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), total

                while total - start >= size:
                    out += close([[piece(start, start + size)]])
                    start += size
                while start < total:
                    rest = total - start
                    if not windows.fits(rest) and (room := windows.fullest_room()) >= min_piece:
                        out += close(windows.add(room, piece(start, start + room)))
                        start += room
                        continue
                    out += close(windows.add(rest, piece(start, total)))
                    start = total
            yield _rows(out, part, size)
        yield _rows([(w[2], base + number + i, False) for i, w in enumerate(windows.open)], part, size)

    def merge(level: int, groups: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple]] = {}
            for batch in batches:
                for r in zip(*(batch.column(n).to_pylist() for n, _ in FIELDS[:5]), batch.column("part").to_pylist(), strict=True):
                    held.setdefault(r[5] // fan_in, []).append(r[:5])
            for group, pieces in sorted(held.items()):
                windows, out = Windows(size, len(pieces) + 1), []
                for p in sorted(pieces, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
                    out += [(w, True) for w in windows.add(p[2], p)]
                out += [(w[2], groups == 1 or size - w[0] >= 0.97 * size) for w in windows.open]
                yield _rows([(w, level << 56 | group << 32 | i, done) for i, (w, done) in enumerate(out)], group, size)

        return run

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, slim.rdd.getNumPartitions())
    level, rounds = 0, [stage(slim.mapInArrow(first, SCHEMA), "pack-0")]
    while True:
        level, groups = level + 1, -(-parts // fan_in)
        left = rounds[-1].where("not done").withColumn("grp", (F.col("part") / fan_in).cast("long"))
        rounds.append(stage(left.repartition(groups, "grp").drop("grp").mapInArrow(merge(level, groups), SCHEMA), f"pack-{level}"))
        parts = groups
        if groups == 1:
            break
    whole = rounds[0]
    for r in rounds[1:]:
        whole = whole.unionByName(r)
    return whole.where("done").drop("part", "done")
