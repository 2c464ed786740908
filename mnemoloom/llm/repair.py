"""Cheapest repair of the role structure of conversations, by a dynamic program over runs of equal rows.

A conversation's role initials have to read ``(s?(ua)+)?``. Rows are symbols: their role's class and their fault. Equal consecutive
symbols are one run, and a run of n is n applications of one 4 x 4 min-plus matrix over the pattern's states, done through the binary digits of n with
cached powers. Costs-to-go come from the end backward; the audit is unrolled forward, the least letter first among the cheapest choices,
halving each run down to single rows.

Conversations are cut into segments of bounded size. One that lies in a single segment is solved there. The others are composed of their
segments' matrices: a fold from the last segment gives each the costs after it, every segment is unrolled for each of the four
states it can be entered in, and a fold from the first picks the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.session import stage

#: States of the pattern: nothing yet, after the system's turn, after the user's, after the assistant's. What an insertion or a new role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Costs and letters of what must still be inserted at the end of a conversation, by state.
END, END_AUDIT = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
INF = 1 << 60
#: A row that must go; the classes of others are s, u, a and o, in capitals if they are truncated.
GONE = "x"
#: A segment has so many rows at most, and is closed at so many bytes of text.
ROWS, BYTES = 4096, 4 << 20
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2**k rows of a symbol: cost from state to state, insertions before each row included."""
    if k:
        m = power(symbol, k - 1)
        return tuple(tuple(min(INF, *(m[i][x] + m[x][j] for x in range(4))) for j in range(4)) for i in range(4))
    row = [[INF] * 4 for _ in range(4)]
    extra = TRUNCATED if symbol.isupper() else 0
    for q in range(4):
        row[q][q] = DELETE
        if symbol != GONE:
            row[q][NEXT[q]] = min(row[q][NEXT[q]], REROLE + extra)
            for to in [KEEP[symbol.lower()][q]] if q in KEEP[symbol.lower()] else []:
                row[q][to] = min(row[q][to], extra)
    for _ in range(3):  # more than two insertions in a row lead to states that fewer lead to
        row = [[min(row[q][j], INSERT + row[NEXT[q]][j]) for j in range(4)] for q in range(4)]
    return tuple(map(tuple, row))


@lru_cache(maxsize=1 << 16)
def _before(symbol: str, n: int, v: Vector) -> Vector:
    k = 0
    while n:
        if n & 1:
            m = power(symbol, k)
            v = tuple(min(INF, *(m[q][x] + v[x] for x in range(4))) for q in range(4))
        n >>= 1
        k += 1
    return v


def before(symbol: str, n: int, v: Vector) -> Vector:
    """Costs-to-go before a run of n, of those after it. Differences decide, so the cache holds vectors whose least entry is 0."""
    low = min(v)
    return tuple(min(INF, x + low) for x in _before(symbol, n, tuple(INF if x >= INF else x - low for x in v)))


@lru_cache(maxsize=1 << 16)
def _unrolled(symbol: str, n: int, q: int, v: Vector) -> tuple[str, int]:
    if n > 1:
        first, q = unrolled(symbol, n - n // 2, q, before(symbol, n // 2, v))
        second, q = unrolled(symbol, n // 2, q, v)
        return first + second, q
    out, togo = "", before(symbol, 1, v)
    extra = TRUNCATED if symbol.isupper() else 0
    while True:
        if DELETE + v[q] == togo[q]:
            return out + "D", q
        if INSERT + togo[NEXT[q]] == togo[q]:
            out, q = out + "I", NEXT[q]
            continue
        to = KEEP[symbol.lower()].get(q)
        return (out + "K", to) if to is not None and extra + v[to] == togo[q] else (out + "R", NEXT[q])


def unrolled(symbol: str, n: int, q: int, v: Vector) -> tuple[str, int]:
    """The least of the cheapest audits of a run entered in state q with costs v after it, and the state it leads to."""
    low = min(v)
    v = tuple(x - low for x in v)
    if n <= 64:
        return _unrolled(symbol, n, q, v)
    first, q = unrolled(symbol, n - n // 2, q, before(symbol, n // 2, v))
    second, q = unrolled(symbol, n // 2, q, v)
    return first + second, q


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix(symbols: str) -> list[int]:
    """The min-plus matrix of a segment, row by row."""
    runs = runs_of(symbols)[::-1]
    columns = []
    for j in range(4):
        v = tuple(0 if q == j else INF for q in range(4))
        for s, n in runs:
            v = before(s, n, v)
        columns.append(v)
    return [columns[j][q] for q in range(4) for j in range(4)]


def audits(symbols: str, v: Vector, states: Iterable[int] = range(4)) -> list[tuple[str, int]]:
    """For each state that a segment may be entered in: its audit and the state it leads to, with costs v after the segment."""
    runs, after = runs_of(symbols), [v]
    for s, n in runs[:0:-1]:
        after.append(before(s, n, after[-1]))
    out = []
    for q in states:
        parts = []
        for (s, n), w in zip(runs, reversed(after), strict=True) if runs else ():
            part, q = unrolled(s, n, q, w)
            parts.append(part)
        out.append(("".join(parts), q))
    return out


def cost_of(audit: str, symbols: str) -> int:
    rows = iter(symbols)
    return sum(INSERT if e == "I" else (DELETE if e == "D" else (REROLE if e == "R" else 0) + TRUNCATED * s.isupper()) for e in audit for s in ("" if e == "I" else next(rows),))


def identity(role: str, text: str) -> bytes:
    """128 bits that stand for a role and a text."""
    r = role.encode()
    return hashlib.blake2b(b"%d:" % len(r) + r + text.encode(), digest_size=16).digest()


def diagnosed(seg: dict, seen: set[bytes]) -> dict:
    """Symbols and counts of a segment; ``seen`` are identities of earlier segments' rows, and takes up this one's."""
    symbols, blank, duplicate, truncated, initials, turns = [], 0, 0, 0, [], []
    for turn, role, text, copies in zip(seg["turns"], seg["roles"], seg["texts"], seg["copies"], strict=True):
        if not copies:
            continue
        turns.append(turn)
        initials.extend([role[:1]] * copies)
        shown = text.rstrip(SPACES)
        known = identity(role, text)
        if not shown:
            blank += copies
            symbols.append(GONE * copies)
        else:
            again = copies - (known not in seen)
            duplicate += again
            if again < copies:
                cut = shown[-1] not in ".!?"
                truncated += cut
                kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
                symbols.append(kind.upper() if cut else kind)
            symbols.append(GONE * again)
        seen.add(known)
    real = [t for t in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return {"symbols": "".join(symbols), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "least": real[0] if real else None, "most": real[-1] if real else None, "turns": len(set(real))}


def repaired(seg: dict, audit: str, q: int, end: str) -> tuple[str, int]:
    """The repaired ``role:text`` of a segment entered in state q, newline-joined, and how many rows it has."""
    rows = ((role, text) for role, text, n in zip(seg["roles"], seg["texts"], seg["copies"], strict=True) for _ in range(n))
    out = []
    for e in audit + end:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        q = KEEP[role[:1] if role[:1] in ("s", "u", "a") else "o"][q] if e == "K" else NEXT[q]
        out.append(f"{role if e == 'K' else 'user' if q == USER else 'assistant'}:{text}")
    return "\n".join(out), len(out)


SEGMENT = [("conv_id", pa.int64()), ("seg", pa.int64()), ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int32()))]
SEGMENT_DDL = "conv_id long, seg long, open boolean, turns array<long>, roles array<string>, texts array<string>, copies array<int>"
STATS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64())]
STATS_DDL = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long"
SUMMARY = [("conv_id", pa.int64()), ("seg", pa.int64()), ("symbols", pa.string()), ("m", pa.list_(pa.int64())), *STATS]
SUMMARY_DDL = f"conv_id long, seg long, symbols string, m array<long>, {STATS_DDL}"
RESULT = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batch(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _each(batches: Iterable[pa.RecordBatch], some: int = 64) -> Iterator[list[dict]]:
    for batch in batches:
        for start in range(0, batch.num_rows, some):
            yield batch.slice(start, some).to_pylist()


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults by crc32 of ``conv:turn`` modulo 20; a null stands as one space.

    0 drops the row (copies 0), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it (copies 2), 4 makes
    it the user's.
    """
    conv, turn = (F.col(c).cast("long") for c in (conv_col, turn_col))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    name = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)))
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def segments(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Conversations in order of turn (null first), role and text, cut into stored segments; ``open``: there may be others of the conversation.

    Rows go by range of (conversation, turn, ...), so a conversation of any size lies in as many partitions as it fills; only those at a
    partition's ends or over a segment's size are open.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size, cuts = TaskContext.get().partitionId(), 0, 0, 0
        current, first, held, ready = object(), True, [], []

        def close(ends: bool) -> None:
            nonlocal count, size, held
            columns = [list(c) for c in zip(*held, strict=True)]
            ready.append((current, part << 32 | count, ends or first or cuts > 0, *columns))
            count, size, held = count + 1, 0, []

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                columns = [piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]
                for conv, *row in zip(*columns, strict=True):
                    if conv != current:
                        if held:
                            close(False)
                            first = False
                        current, cuts = conv, 0
                    elif len(held) >= most_rows or size >= most_bytes:
                        close(True)
                        cuts += 1
                    held.append(row)
                    size += len(row[2])
                if ready:
                    yield _batch(SEGMENT, ready)
                    ready.clear()
        if held:
            close(True)
            yield _batch(SEGMENT, ready)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("look", F.md5(F.encode("text", "UTF-8"))).withColumn("salt", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", "look", "salt"]  # rows alike in all else are dealt by their place
    return stage(keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", "copies").mapInArrow(cut, SEGMENT_DDL), "repair-segments")


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment."""
    for some in _each(batches):
        out = []
        for seg in some:
            d = diagnosed(seg, set())
            ((audit, q),) = audits(d["symbols"], END, [START])
            text, _ = repaired(seg, audit, START, END_AUDIT[q])
            cost = cost_of(audit, d["symbols"]) + END[q]
            out.append((seg["conv_id"], _gaps(d["least"], d["most"], d["turns"]), d["blank"], d["duplicate"], d["truncated"], d["illegal"], cost, audit + END_AUDIT[q], hashlib.sha256(text.encode()).hexdigest()))
        yield _batch(RESULT, out)


def _compose(table: DataFrame) -> DataFrame:
    """Conversations of several segments (or possibly several)."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(batches):
            found = [list({identity(r, t) for r, t, n in zip(s["roles"], s["texts"], s["copies"], strict=True) if n}) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array([s["conv_id"] for s in some], pa.int64()), pa.array([s["seg"] for s in some], pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["conv_id", "seg", "keys"])

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(batches):
            out = []
            for s in some:
                d = diagnosed(s, set(s["seen"] or ()))
                out.append((s["conv_id"], s["seg"], d["symbols"], matrix(d["symbols"]), *(d[n] for n, _ in STATS)))
            yield _batch(SUMMARY, out)

    def backward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs after each segment; segments come last to first."""
        at, v = object(), END
        for some in _each(batches, 10_000):
            out = []
            for s in some:
                if s["conv_id"] != at:
                    at, v = s["conv_id"], END
                    last = True
                out.append((s["seg"], list(v), last))
                m, last = s["m"], False
                v = tuple(min(m[4 * q + x] + v[x] for x in range(4)) for q in range(4))
            yield _batch([("seg", pa.int64()), ("v", pa.list_(pa.int64())), ("is_last", pa.bool_())], out)

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(batches):
            out = []
            for s in some:
                ways = audits(s["symbols"], tuple(s["v"]))
                out.append((s["conv_id"], s["seg"], [a for a, _ in ways], [q for _, q in ways], s["is_last"], s["first"], s["last"], s["least"], s["most"]))
            yield _batch([("conv_id", pa.int64()), ("seg", pa.int64()), ("ways", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("is_last", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64())], out)

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each segment is entered in and its audit; what its first row is to the one before it."""
        at = object()
        for some in _each(batches):
            out = []
            for s in some:
                if s["conv_id"] != at:
                    at, q, last, most = s["conv_id"], START, None, None
                edge = int(last is not None and s["first"] is not None and last + s["first"] not in ("su", "ua", "au"))
                again = int(most is not None and s["least"] == most)
                to = s["exits"][q]
                out.append((s["seg"], q, s["ways"][q], END_AUDIT[to] if s["is_last"] else "", edge, again))
                q, last, most = to, last if s["last"] is None else s["last"], most if s["most"] is None else s["most"]
            yield _batch([("seg", pa.int64()), ("q", pa.int32()), ("audit", pa.string()), ("tail", pa.string()), ("edge", pa.int64()), ("again", pa.int64())], out)

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _each(batches, 8):
            out = []
            for s in some:
                text, n = repaired(s, s["audit"], s["q"], s["tail"])
                cost = cost_of(s["audit"], s["symbols"]) + INSERT * len(s["tail"])
                out.append((s["conv_id"], s["seg"], s["blank"], s["duplicate"], s["truncated"], s["illegal"] + s["edge"], s["least"], s["most"], s["n_turns"] - s["again"], cost, s["audit"] + s["tail"], text.encode() if n else None))
            yield _batch([("conv_id", pa.int64()), ("seg", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("n_turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("text", pa.binary())], out)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's row from its segments in order; their texts pass through the digest one by one."""
        at, sums = object(), None

        def done() -> pa.RecordBatch:
            return _batch(RESULT, [(at, _gaps(least, most, sums["n_turns"]), *(sums[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(parts), sha.hexdigest())])

        for some in _each(batches, 8):
            for s in some:
                if s["conv_id"] != at:
                    if sums is not None:
                        yield done()
                    at, sums, parts, sha, started, least, most = s["conv_id"], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns", "cost"), 0), [], hashlib.sha256(), False, None, None
                for c in sums:
                    sums[c] += s[c]
                least, most = s["least"] if least is None else least, most if s["most"] is None else s["most"]
                parts.append(s["audit"])
                if s["text"] is not None:
                    sha.update(b"\n" * started + s["text"])
                    started = True
        if sums is not None:
            yield done()

    ordered = lambda df, *by: df.repartition("conv_id").sortWithinPartitions("conv_id", *by)
    held = table.mapInArrow(keys, "conv_id long, seg long, keys array<binary>").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "seg", F.explode("keys").alias("key"))
    held = stage(held, "repair-keys")
    earliest = held.groupBy("conv", "key").agg(F.min("seg").alias("least"))
    seen = held.join(earliest, ["conv", "key"]).where("seg > least").groupBy("seg").agg(F.collect_list("key").alias("seen"))
    summaries = stage(table.join(seen, "seg", "left").select(table.columns + ["seen"]).mapInArrow(summary, SUMMARY_DDL), "repair-summaries")
    after = ordered(summaries.select("conv_id", "seg", "m"), F.desc("seg")).mapInArrow(backward, "seg long, v array<long>, is_last boolean")
    ways = summaries.join(after, "seg").mapInArrow(every, "conv_id long, seg long, ways array<string>, exits array<int>, is_last boolean, first string, last string, least long, most long")
    picked = stage(ordered(ways, "seg").mapInArrow(forward, "seg long, q int, audit string, tail string, edge long, again long"), "repair-picked")
    whole = table.drop("turns").join(summaries.withColumnRenamed("turns", "n_turns").drop("conv_id", "m"), "seg").join(picked, "seg")
    pieces = whole.mapInArrow(rebuild, "conv_id long, seg long, blank long, duplicate long, truncated long, illegal long, least long, most long, n_turns long, cost long, audit string, text binary")
    return ordered(pieces, "seg").mapInArrow(total, RESULT_DDL)


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row counts ``copies`` times, side by side; 0 keeps nothing but its conversation. Rows stand by turn (null first); ties by role, then by
    the text's MD5. The first fault of a row counts: blank (nothing but spaces), duplicate (its role and text were seen earlier, by a digest of 128
    bits), truncated (the last character that isn't a space is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the
    only one for blank and duplicate rows), Insert an empty user's or assistant's turn 5; a truncated row that stays costs 5 more. ``audit`` has the cheapest edits'
    initials in order, the least in ASCII among equals. Roles go by their first letter, as it is: any other than s, u or a can't be kept.

    Defined cases: null role and text are one space (blank, and no role); a null conv_id is a conversation of its own; a conversation
    without rows has zeros, an empty audit and the digest of nothing; repeated rows are duplicates; extra columns are ignored; an empty table gives no rows.

    Scale: texts move once, by range, and conversations in one segment (all but those at a partition's ends) are solved where they lie. Of the
    others, segments of ``most_rows`` rows or ``most_bytes`` are dealt to any task; what meets by conversation are rows a segment
    (a matrix, a state, an audit), folded one by one in order. Only the last fold passes the repaired text through one task, segment by
    segment, because SHA-256 has no other way; nothing of a conversation is held but its audit, which is its result.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("copies").cast("int"))
    table = segments(rows, most_rows, most_bytes)
    return table.where("not open").mapInArrow(_solve, RESULT_DDL).unionByName(_compose(table.where("open")))
