"""Removal of repeated strings of a fixed length, settled by a hash-compared suffix sort.

Every string of ``length`` bytes is governed by one anchor: the least of its k-gram hashes, leftmost on
ties. Equal strings have equal anchors at equal places, so only strings under equal anchors can be
equal. Neighbouring strings under one anchor form a context. Anchors are counted first, and those of one document
alone are dropped; the contexts under the others travel as text to their anchor's bucket. There equal contexts are
collapsed, each compared byte by byte with the one that stands for it, and what is left of an anchor goes to a suffix
sort: mergesort in which two suffixes are compared by binary search for their longest common extension on prefix
polynomial hashes, and equal neighbours are verified by bytes. No result rests on a hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.common import RUN, arrays, bits, merged_spans, run_texts, slices, text_runs, unzipped, whole_buckets, without, zipped

#: Texts are worked on in pieces of about so many bytes.
PIECE = 1 << 17
#: Of an anchor with more contexts than this, the strings are dealt by their content instead of the anchor.
HOT = 1 << 14
#: Strings that are worked on at once, but for whole anchors.
WINDOWS = 200_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled as needed."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.cumprod(p)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of bytes i..j-1, times BASE**i; modulo 2**64."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(BYTES[buffer] * powers(BASE, len(buffer)), out=out[1:])
    return out


def contexts(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor, anchor hash, context hash) of every context, in order; places are in the text."""
    gram = min(24, 2 * length // 3)
    window = length - gram + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buffer)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.int32), none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p, inverse = prefix_hashes(buffer), powers(INVERSE, n)
    grams = mixed((p[gram:] - p[:-gram]) * inverse[: n - gram + 1])
    least = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: span - window], least[window - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    usable = np.zeros(len(anchor) + 1, np.int32)
    whole = sizes >= length
    np.add.at(usable, (ends - sizes)[whole], 1)
    np.add.at(usable, (ends - length + 1)[whole], -1)
    usable = np.cumsum(usable[:-1]) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[(ends - sizes)[whole]] = True
    new[1:] |= ~usable[:-1]
    first = np.flatnonzero(new & usable)
    stops = np.flatnonzero(np.append(new[1:] | ~usable[1:], True) & usable)
    a = anchor[first]
    owner = np.searchsorted(ends, first, side="right").astype(np.int32)
    content = (p[stops + length] - p[first]) * inverse[first]
    ctx = mixed(content + mixed(((stops - first) << 16 | a - first).astype(np.uint64)))
    base = (ends - sizes)[owner]
    return owner, first - base, stops - base, a - base, grams[a], ctx


class SuffixSort:
    """Sorts suffixes of a buffer by their first ``length`` bytes, inside given groups."""

    def __init__(self, buffer: np.ndarray, length: int) -> None:
        self.buffer, self.length = buffer, length
        self.p, self.pow = prefix_hashes(buffer), powers(BASE, len(buffer) + 1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension, up to ``length``: binary search on prefix hashes."""
        p, x, y = self.p, self.pow[i], self.pow[j]
        pi, pj = p[i], p[j]
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length, np.int64)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = (p[i + mid] - pi) * y == (p[j + mid] - pj) * x
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        at = self.extension(i, j)
        short = at < self.length
        out = np.full(len(i), or_equal)
        out[short] = self.buffer[i[short] + at[short]] < self.buffer[j[short] + at[short]]
        return out

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes by (group, content): bottom-up mergesort, all merges of a width at once."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(head, len(g)))
        begin, count = np.repeat(head, size), np.repeat(size, size)
        width = 1
        while width < (size.max() if len(size) else 0):
            at = np.flatnonzero(count > width)
            rel = at - begin[at]
            pair = begin[at] + rel // (2 * width) * 2 * width
            right = rel // width % 2 == 1
            other = np.where(right, pair, pair + width)
            stop = np.minimum(np.where(right, pair + width, pair + 2 * width), begin[at] + count[at])
            low, high, mine = other.copy(), np.maximum(stop, other), start[order[at]]
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                theirs = start[order[mid]]
                go = np.empty(len(todo), bool)
                r = right[todo]
                go[r] = self.less(theirs[r], mine[todo][r], True)
                go[~r] = self.less(theirs[~r], mine[todo][~r], False)
                low[todo], high[todo] = np.where(go, mid + 1, low[todo]), np.where(go, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            place = pair + (rel - np.where(right, width, 0) - (pair - begin[at])) + (low - other)
            moved = order.copy()
            moved[place] = order[at]
            order, width = moved, 2 * width
        return order

    def classes(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Class number of each suffix: equal group and equal first ``length`` bytes. Equal neighbours are compared by bytes."""
        if not len(start):
            return np.zeros(0, np.int64)
        order = self.sort(start, group)
        s, g = start[order], group[order]
        together = np.flatnonzero(g[1:] == g[:-1])
        equal = together[self.extension(s[together], s[together + 1]) == self.length]
        view = np.lib.stride_tricks.sliding_window_view(self.buffer, self.length)
        for k in range(0, len(equal), 1 << 17):
            part = equal[k : k + (1 << 17)]
            if (view[s[part]] != view[s[part + 1]]).any():  # a hash collision: classes by content instead
                return np.unique(np.array([b"%d:" % q + view[i].tobytes() for i, q in zip(start, group, strict=True)], object), return_inverse=True)[1]
        new = np.ones(len(s), bool)
        new[equal + 1] = False
        out = np.empty(len(s), np.int64)
        out[order] = np.cumsum(new) - 1
        return out


VOTES = [("bucket", pa.int32()), ("run", pa.int64()), ("known", pa.binary()), ("keys", pa.binary()), ("more", pa.binary())]
VOTES_DDL = "bucket int, run long, known binary, keys binary, more binary"
ANSWERS = [("run", pa.int64()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())]
ANSWERS_DDL = "run long, bucket int, shared binary, hot binary"
PACKED = [("bucket", pa.int32()), ("run", pa.int64()), ("items", pa.int32()), ("size", pa.int64()), ("z", pa.binary()), ("spans", pa.binary())]
PACKED_DDL = "bucket int, run long, items int, size long, z binary, spans binary"
FOUND = [("run", pa.int64()), ("spans", pa.binary())]
RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MORE = np.dtype([("key", "<u4"), ("count", "<u4")])
SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("size", "<u4")])
#: Columns of the contexts in a packed row, in their order there.
COLUMNS = (("doc_id", "<i8"), ("doc", "<u4"), ("first", "<u4"), ("key", "<u4"), ("left", "u1"), ("windows", "u1"))
HASH, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Spans column by column in zstd, in order of place."""
    order = np.lexsort((start, doc))
    return len(order).to_bytes(4, "little") + zipped(b"".join(c[order].astype("<u4").tobytes() for c in (doc, start, size)))


def _read_spans(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.empty(n, SPAN)
    out["doc"], out["start"], out["size"] = np.frombuffer(unzipped(raw[4:], 12 * n), "<u4").reshape(3, n)
    return out


def _pieces(ids: list, texts: list[bytes], length: int, buckets: int, piece: int) -> Iterator[tuple]:
    """Contexts of a run, about ``piece`` bytes at a time: (the bytes, a context's place in them, its document's place in the run, its
    id, the context's place in the document, its windows, its anchor's place after its own, identity of the anchor, context hash).

    An identity is the bucket and 32 bits of the hash. Rows without an id have no contexts. Pieces of a long text overlap
    by ``length - 1`` bytes, so that each string is in one of them.
    """
    doc, parts, offsets, held = [], [], [], 0

    def ready() -> tuple:
        owner, first, last, anchor, gram, ctx = contexts(parts, length)
        sizes = np.array([len(x) for x in parts], np.int64)
        ident = (gram >> HASH) % np.uint64(buckets) << HASH | gram & LOW
        at, shift = np.array(doc, np.int64), np.array(offsets, np.int64)
        own = np.array([ids[i] for i in doc], np.int64)
        return b"".join(parts), first + (np.cumsum(sizes) - sizes)[owner], at[owner], own[owner], first + shift[owner], last - first + 1, anchor - first, ident, ctx

    for i, text in enumerate(texts):
        if ids[i] is None:
            continue
        for start in range(0, max(1, len(text) - length + 1), piece):
            doc.append(i)
            parts.append(text[start : start + piece + length - 1])
            offsets.append(start)
            held += len(parts[-1])
            if held >= piece:
                yield ready()
                doc, parts, offsets, held = [], [], [], 0
    if parts:
        yield ready()


def _segments(pieces: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces joined to about RUN bytes, without their context hashes."""
    held, size = [], 0

    def joined() -> tuple:
        base = np.cumsum([0, *(len(p[0]) for p in held)])
        places = np.concatenate([p[1] + b for p, b in zip(held, base, strict=False)])
        return b"".join(p[0] for p in held), places, *(np.concatenate([p[i] for p in held]) for i in range(2, 8))

    for p in pieces:
        held.append(p)
        size += len(p[0])
        if size >= RUN:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _gathered(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a buffer, one after another."""
    return buffer[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _distinct(pieces: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run: its anchors' identities, sorted; whether two documents of it have the anchor; how many contexts it has there."""
    ident, own, ctx = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), *((p[7], p[3], p[8]) for p in pieces), strict=True))
    order = np.lexsort((ctx, ident))
    ident, own, ctx = ident[order], own[order], ctx[order]
    heads = np.flatnonzero(np.append(True, ident[1:] != ident[:-1])[: len(ident)])
    if not len(heads):
        return ident, np.zeros(0, bool), np.zeros(0, np.int64)
    fresh = np.append(True, (ident[1:] != ident[:-1]) | (ctx[1:] != ctx[:-1]))
    return ident[heads], np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads), np.add.reduceat(fresh, heads, dtype=np.int64)


def _count(batches: Iterable[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """For each run and bucket: bits of the anchors that two documents or more have, and of those with more than ``hot`` contexts."""
    for bucket, rows in whole_buckets(batches):
        every, votes = np.unique(np.frombuffer(b"".join(r["keys"] for r in rows), "<u4"), return_counts=True)
        more = np.frombuffer(b"".join(r["more"] for r in rows), MORE)
        total = votes + np.bincount(np.searchsorted(every, more["key"]), more["count"], len(every)).astype(np.int64)
        out: list[list] = [[] for _ in ANSWERS]
        for r in rows:
            at = np.searchsorted(every, np.frombuffer(r["keys"], "<u4"))
            shared = bits(r["known"], len(at)) | (votes[at] > 1)
            if shared.any():
                for column, x in zip(out, (r["run"], bucket, np.packbits(shared).tobytes(), np.packbits(total[at] > hot).tobytes()), strict=True):
                    column.append(x)
        yield arrays(ANSWERS, out)


def _copies(buffer: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each stretch of the buffer, one that stands for it: of equal keys, sizes and bytes that with the least id. Found by hash, then
    each stretch is compared with its stand-in byte by byte; one that differs stands for itself."""
    p, inverse = prefix_hashes(buffer), powers(INVERSE, len(buffer) + 1)
    content = mixed((p[start + size] - p[start]) * inverse[start] + mixed(key + size.astype(np.uint64)))
    order = np.lexsort((own, content))
    heads = np.append(True, content[order][1:] != content[order][:-1])
    stands = np.empty(len(order), np.int64)
    stands[order] = order[np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))]
    ask = np.flatnonzero(stands != np.arange(len(stands)))
    for k in range(0, len(ask), 1 << 15):
        a = ask[k : k + (1 << 15)]
        b, n = stands[a], size[a]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        longest = np.minimum(np.repeat(start[b], n) + step, len(buffer) - 1)
        differ = buffer[np.repeat(start[a], n) + step] != buffer[longest]
        bad = (np.add.reduceat(differ, np.cumsum(n) - n) > 0) | (size[b] != n) | (key[b] != key[a])
        stands[a[bad]] = a[bad]
    return stands


def _settle(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of the contexts in a bucket, the strings that a smaller document has: by equal contexts, then by the suffix sort of those left."""
    for _, rows in whole_buckets(batches):
        columns: dict[str, list] = {c: [] for c, _ in COLUMNS}
        where, raw = [], []
        for k, r in enumerate(rows):
            if r["spans"]:
                yield arrays(FOUND, [[r["run"]], [r["spans"]]])
            plain, at, n = unzipped(r["z"], r["size"]), 0, r["items"]
            for c, kind in COLUMNS:
                columns[c].append(np.frombuffer(plain, kind, n, at))
                at += n * np.dtype(kind).itemsize
            where.append(np.full(n, k))
            raw.append(plain[at:])
        own, doc, first, ident, left, windows = (np.concatenate(columns[c]).astype(np.int64) for c, _ in COLUMNS)
        of, buffer = np.concatenate(where), np.frombuffer(b"".join(raw), np.uint8)
        del columns, raw, where
        size = windows + length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(ident, kind="stable")
        total, ends = np.cumsum(windows[order]), np.flatnonzero(np.append(np.diff(ident[order]) != 0, True)[: len(order)]) + 1
        hits, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < len(order):  # whole anchors, about WINDOWS strings at a time
            base = total[at - 1] if at else 0
            stop = int(ends[max(np.searchsorted(ends, at, side="right"), np.searchsorted(total[ends - 1], base + WINDOWS, side="right") - 1)])
            mine = order[at:stop]
            at = stop
            n = size[mine]
            starts = np.cumsum(n) - n
            part = _gathered(buffer, begin[mine], n)
            stands = _copies(part, starts, n, (ident[mine] << 8 | left[mine]).astype(np.uint64), own[mine])
            whole = np.flatnonzero(own[mine][stands] < own[mine])
            hits.append((mine[whole], np.zeros(len(whole), np.int64), n[whole]))
            # What stands for itself (or repeats within its document) is sorted, if several documents still have its anchor.
            rest = np.flatnonzero(own[mine][stands] >= own[mine])
            heads = np.flatnonzero(np.append(True, np.diff(ident[mine][rest]) != 0)[: len(rest)])
            several = np.minimum.reduceat(own[mine][rest], heads) != np.maximum.reduceat(own[mine][rest], heads)
            rest = rest[np.repeat(several, np.diff(np.append(heads, len(rest))))]
            if not len(rest):
                continue
            w = windows[mine][rest]
            owner = np.repeat(rest, w)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
            cls = SuffixSort(part, length).classes(starts[owner] + step, (ident[mine] * 256 + left[mine])[owner] - step)
            least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cls, own[mine][owner])
            hit = np.flatnonzero(own[mine][owner] > least[cls])
            new = np.append(True, (np.diff(owner[hit]) != 0) | (np.diff(step[hit]) != 1))[: len(hit)]
            a, z = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
            hits.append((mine[owner[a]], step[a], step[z] - step[a] + length))
        which, offset, sizes = (np.concatenate(x) for x in zip(*hits, strict=True))
        by_run = np.argsort(of[which], kind="stable")
        which, offset, sizes = which[by_run], offset[by_run], sizes[by_run]
        for k, i, j in slices(of[which]):
            yield arrays(FOUND, [[rows[k]["run"]], [_spans(doc[which[i:j]], first[which[i:j]] + offset[i:j], sizes[i:j])]])


def dedup_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    the remaining bytes). Strings are judged on the input; repeats inside one document do not count;
    matches never cross documents. Exact: hashes propose, bytes decide. ``length`` must be 24 to 100.

    Defined cases: null text is empty; a null doc_id neither removes nor loses bytes; rows with equal
    doc_id do not remove each other's bytes; extra columns are ignored; an empty table gives no rows.

    Scale: texts are stored once, in compressed runs, and meet answers twice by run number. Anchors are counted by 4 bytes a
    run and anchor, in buckets whose number follows the bytes of the table; a bucket is worked on alone. Only contexts under
    anchors of two documents or more travel as text, each once for the smallest document of a run that has it. An anchor with more than ``hot`` contexts is split: its strings are dealt by their content, so that no
    task gets more than ``hot`` contexts of an anchor, however common the phrase around it.
    """
    if not 24 <= length <= 100:
        raise ValueError("length must be 24 to 100")
    table, n = text_runs(docs, "suffix-runs", id_col, text_col)
    n = buckets or n

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ident, known, count = _distinct(_pieces(row["ids"], run_texts(row), length, n, piece))
                out: list[list] = [[] for _ in VOTES]
                for k, i, j in slices((ident >> HASH).astype(np.int64)):
                    several = np.flatnonzero(count[i:j] > 1) + i
                    more = np.empty(len(several), MORE)
                    more["key"], more["count"] = ident[several] & LOW, count[several] - 1
                    for column, x in zip(out, (k, row["run"], np.packbits(known[i:j]).tobytes(), (ident[i:j] & LOW).astype("<u4").tobytes(), more.tobytes()), strict=True):
                        column.append(x)
                yield arrays(VOTES, out)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts under shared anchors; those equal to one of a smaller document in the run are settled here."""
        for batch in batches:
            for row in batch.to_pylist():
                pieces = list(_pieces(row["ids"], run_texts(row), length, n, piece))
                ident, _, _ = _distinct(pieces)
                answer = {a["bucket"]: a for a in row["answers"] or ()}
                shared, common = np.zeros(len(ident), bool), np.zeros(len(ident), bool)
                for k, i, j in slices((ident >> HASH).astype(np.int64)):
                    if k in answer:
                        shared[i:j], common[i:j] = bits(answer[k]["shared"], j - i), bits(answer[k]["hot"], j - i)
                for raw, place, doc, own, first, windows, left, key in _segments(pieces):
                    known = np.searchsorted(ident, key)
                    plain, split = np.flatnonzero(shared[known] & ~common[known]), np.flatnonzero(shared[known] & common[known])
                    each = np.repeat(split, windows[split])
                    step = np.concatenate([np.zeros(len(plain), np.int64), np.arange(len(each)) - np.repeat(np.cumsum(windows[split]) - windows[split], windows[split])])
                    at = np.concatenate([plain, each])
                    count = np.concatenate([windows[plain], np.ones(len(each), np.int64)])
                    size, start, lefts, keys = count + length - 1, place[at] + step, left[at] - step, key[at]
                    buffer = np.frombuffer(raw, np.uint8)
                    if len(each):
                        p, alone = prefix_hashes(buffer), start[len(plain) :]
                        content = mixed((p[alone + length] - p[alone]) * powers(INVERSE, len(buffer))[alone])
                        keys[len(plain) :] = (content >> HASH) % np.uint64(n) << HASH | content & LOW
                    stands = _copies(buffer, start, size, keys ^ lefts.astype(np.uint64) << np.uint64(56), own[at])
                    keep = own[at][stands] >= own[at]
                    gone, at = np.flatnonzero(~keep), np.flatnonzero(keep)
                    at = at[np.argsort(keys[at] >> HASH, kind="stable")]
                    which = np.concatenate([plain, each])
                    columns = own[which], doc[which], first[which] + step, keys & LOW, lefts, count
                    out: list[list] = [[] for _ in PACKED]
                    for k, i, j in slices((keys[at] >> HASH).astype(np.int64)):
                        mine = at[i:j]
                        blob = b"".join([*(c[mine].astype(kind).tobytes() for c, (_, kind) in zip(columns, COLUMNS, strict=True)), _gathered(buffer, start[mine], size[mine]).tobytes()])
                        for column, x in zip(out, (k, row["run"], len(mine), len(blob), zipped(blob), None), strict=True):
                            column.append(x)
                    if len(gone):
                        for column, x in zip(out, (row["run"] % n, row["run"], 0, 0, b"", _spans(doc[which][gone], (first[which] + step)[gone], size[gone])), strict=True):
                            column.append(x)
                    yield arrays(PACKED, out)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = run_texts(row)
                found = np.concatenate([np.zeros(0, SPAN), *(_read_spans(x) for x in row["found"] or ())])
                found = found[np.argsort(found["doc"], kind="stable")]
                cuts = np.searchsorted(found["doc"], np.arange(len(texts) + 1))
                out: list[list] = [[] for _ in RESULT]
                for i, (doc, text) in enumerate(zip(row["ids"], texts, strict=True)):
                    mine = found[cuts[i] : cuts[i + 1]]
                    start = mine["start"].astype(np.int64)
                    spans = merged_spans(start, start + mine["size"])
                    kept = without(text, spans)
                    for column, x in zip(out, (doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(x)
                yield arrays(RESULT, out)

    votes = table.mapInArrow(cast, VOTES_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = votes.mapInArrow(lambda batches: _count(batches, hot), ANSWERS_DDL).groupBy("run").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))
    packed = table.join(answers, "run", "left").mapInArrow(send, PACKED_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = packed.mapInArrow(lambda batches: _settle(batches, length), "run long, spans binary").groupBy("run").agg(F.collect_list("spans").alias("found"))
    return table.join(found, "run", "left").mapInArrow(finish, RESULT_DDL)
