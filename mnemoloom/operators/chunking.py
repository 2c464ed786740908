"""Cutting conversations into rounds, blocks, chunks and windows.

Turns are rows (conv_id, turn, role, text). Rules that only look at neighbours are windows over
(conv_id, turn); rules that carry a running size (C9, C10, C23) are cut into segments, see ``segments``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from mnemoloom.functions.columns import c, joined, ordered_collect
from mnemoloom.operators.segments import SEGMENT, entered, finished, numbered, segmented


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def pair_rounds(turns: DataFrame, keep_all: bool = False) -> DataFrame:
    """Rounds of one user and one assistant turn.

    A round closes at an assistant turn; a second user turn in a row closes the one before it alone; an
    assistant turn without a user turn is a round of its own; other roles are left out. With
    ``keep_all`` every role is kept and a round opens at each user turn and after each assistant turn.
    """
    if keep_all:
        prev = F.lag("role").over(by_turn())
        opens = (F.col("role") == "user") | (prev == "assistant")
        rows = turns.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("round", F.sum("opens").over(by_turn()))
        return rows.groupBy("conv_id", "round").agg(F.count("*").alias("n_turns"), joined("text", "\n", "turn").alias("text"))
    rows = turns.where(F.col("role").isin("user", "assistant"))
    opens = (F.col("role") == "user") | ~F.lag("role").over(by_turn()).eqNullSafe("user")
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("round", F.sum("opens").over(by_turn()))
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    return rows.groupBy("conv_id", "round").agg(F.min("turn").alias("first_turn"), pick("user").alias("user_text"), pick("assistant").alias("assistant_text"))


def speaker_blocks(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one speaker as one block, texts joined in order."""
    changed = ~F.lag("role").over(by_turn()).eqNullSafe(F.col("role"))
    rows = turns.withColumn("changed", changed.cast("int")).withColumn("block", F.sum("changed").over(by_turn()))
    return rows.groupBy("conv_id", "block").agg(F.first("role").alias("speaker"), F.count("*").alias("n_turns"), joined("text", "\n", "turn").alias("text"))


def pair_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks 2k and 2k+1 form exchange k; an odd last block stays alone."""
    return blocks.groupBy("conv_id", F.floor((F.col("block") - 1) / 2).alias("exchange")).agg(F.count("*").alias("n_blocks"), joined("text", "\n", "block").alias("text"))


def render_chunk(fields: Iterable[tuple[str, Column]]) -> Column:
    """Lines ``key: value`` in order; lines with a blank value are dropped."""
    lines = F.array(*(F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def compact_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(text), "[ \\t\\n\\x0B\\f\\r]+", " "))


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c(text)) / 4).cast("int"))


def with_previous_summary(rounds: DataFrame, text: str = "text", limit: int = 260) -> DataFrame:
    """The compacted text of the round before, cut to ``limit``; empty at a session's start."""
    w = Window.partitionBy("conv_id").orderBy("round")
    return rounds.withColumn("previous", F.coalesce(F.rtrim(F.substring(F.lag(compact_text(text)).over(w), 1, limit)), F.lit("")))


def trim_lines(text: str, max_tokens: int, priority: tuple[str, ...]) -> str:
    """Shorten the first line over 240 characters with the earliest prefix to 75 % (160 at least) until the text fits, else cut it."""
    budget, lines = max_tokens * 4, text.split("\n")
    while sum(map(len, lines)) + len(lines) - 1 > budget:
        long = next((i for p in priority for i, x in enumerate(lines) if x.startswith(p) and len(x) > 240), None)
        if long is None:
            return "\n".join(lines)[:budget].rstrip()
        lines[long] = lines[long][: max(160, len(lines[long]) * 3 // 4)].rstrip()
    return "\n".join(lines)


def trim_chunk(df: DataFrame, text: str, max_tokens: int, priority: tuple[str, ...]) -> DataFrame:
    """Rows over the token budget are shortened; only those reach Python."""

    @F.pandas_udf("string")
    def shorten(x: pd.Series) -> pd.Series:
        return x.map(lambda t: trim_lines(t, max_tokens, priority))

    over = F.length(text) > 4 * max_tokens
    return df.where(~over | F.col(text).isNull()).unionByName(df.where(over).withColumn(text, shorten(text)))


def _closings(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the sizes, and for each round the next at which a chunk that starts with it has closed (the number of rounds, if none).

    A round that adds something is left to the next chunk if twice the sum before it, plus itself, is over twice the target; that grows along the rounds.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    adds = np.flatnonzero(sizes > 0)
    reach = sums[adds] + sums[adds + 1]
    found = np.searchsorted(reach, 2 * target + 2 * sums[:-1], side="right")
    at = np.maximum(found, np.searchsorted(adds, np.arange(len(sizes)), side="right"))
    return sums, np.append(adds, len(sizes))[at]


def balance_chunks(rounds: DataFrame, target: int = 512, size: str = "tokens", segment: int = SEGMENT) -> DataFrame:
    """Chunk number per round: the next round joins if the sum is at least as near the target as without it. Rounds stay whole, sessions apart.

    A chunk's end follows from its start by a search in prefix sums. A segment tells, for each round at which a chunk from before may close, the least
    sum brought along that closes it there, how many chunks then close and what is left open at its end.
    """

    def summarise(rows: dict) -> dict:
        n = rows[size].astype(np.int64)
        sums, then = _closings(n, target)
        closes, left = np.zeros(len(n) + 1, np.int64), np.zeros(len(n) + 1, np.int64)
        for j in range(len(n) - 1, -1, -1):
            closes[j] = 0 if then[j] == len(n) else closes[then[j]] + 1
            left[j] = sums[-1] - sums[j] if then[j] == len(n) else left[then[j]]
        steps, last = [], None
        for j in np.flatnonzero(n > 0).tolist():
            over = target - (int(sums[j]) + int(sums[j + 1])) / 2  # a chunk with more than this closes before round j
            steps.append([over, int(sums[j]), int(closes[j]) + 1, int(left[j])])
            if over < 0 and sums[j] > 0:
                break
        return {"steps": steps, "sum": int(sums[-1])}

    def fold(state: list, told: dict) -> list:
        number, total = state
        for over, before, closes, left in told["steps"]:
            if total + before > 0 and total > over:
                return [number + closes, left]
        return [number, total + told["sum"]]

    def finish(rows: dict, state: list) -> dict:
        (number, total), out = state, []
        for n in rows[size].astype(np.int64).tolist():
            if n > 0 and total > 0 and 2 * total + n > 2 * target:
                number, total = number + 1, 0
            total += n
            out.append(number)
        return {"chunk": out}

    rows = segmented(numbered(rounds.select("conv_id", "round", F.col(size).cast("long").alias(size)), "conv_id", ["round"]), segment)
    return finished(entered(rows, summarise, fold, [0, 0]), finish, [0, 0], f"conv_id long, round long, {size} long, chunk long")


def batch_rounds(rounds: DataFrame, n: int = 4, images: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Batches of ``n`` rounds; with ``images`` a batch also closes before its second image-bearing round.

    An open batch is one of ``2 * n`` states (rounds held, an image among them or not), and a segment tells what becomes of each.
    """
    if images is None:
        w = Window.partitionBy("conv_id").orderBy("round")
        return rounds.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))

    def along(has: np.ndarray, held: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Batches closed before each round, for each state that may come in; and the state after the last."""
        number, out = np.zeros(len(held), np.int64), np.empty((len(has), len(held)), np.int64)
        for i, image in enumerate(has.tolist()):
            close = (held == n) | (seen & image)
            number = number + close
            held, seen = np.where(close, 0, held) + 1, (seen & ~close) | image
            out[i] = number
        return out, held, seen

    def summarise(rows: dict) -> list:
        out, held, seen = along(rows[images] > 0, np.tile(np.arange(n + 1), 2), np.repeat([False, True], n + 1))
        return [out[-1].tolist(), held.tolist(), seen.tolist()]

    def fold(state: list, told: list) -> list:
        number, held, seen = state
        at = held + (n + 1) * int(seen)
        return [number + told[0][at], told[1][at], told[2][at]]

    def finish(rows: dict, state: list) -> dict:
        (number, held, seen), out = state, []
        for image in (rows[images] > 0).tolist():
            if held == n or (seen and image):
                number, held, seen = number + 1, 0, False
            held, seen = held + 1, seen or image
            out.append(number)
        return {"batch": out}

    rows = segmented(numbered(rounds.select("conv_id", "round", F.col(images).cast("long").alias(images)), "conv_id", ["round"]), segment)
    return finished(entered(rows, summarise, fold, [0, 0, False]), finish, [0, 0, False], f"conv_id long, round long, {images} long, batch long")


def merge_chunks(chunks: DataFrame, group: list[str], order: str, ident: str, lists: list[str]) -> DataFrame:
    """One row per group: id ``first..last``, and each list column's distinct items in order of appearance."""
    ids = ordered_collect(F.col(ident).cast("string"), order)
    made = chunks.groupBy(*group).agg(ids.alias("ids"), *(F.array_distinct(F.flatten(ordered_collect(x, order))).alias(x) for x in lists))
    return made.withColumn("chunk_id", F.concat(F.col("ids")[0], F.lit(".."), F.element_at("ids", -1))).withColumn("n_chunks", F.size("ids")).drop("ids")


def split_documents(docs: DataFrame, max_tokens: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``max_tokens`` white-space tokens, ``id_part{i}``; blank documents give none."""
    tokens = F.filter(F.split(c(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    rows = docs.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / max_tokens).cast("int")), lambda i: F.array_join(F.slice("tokens", i * max_tokens + 1, max_tokens), " "))
    return rows.select(F.col(ident), F.posexplode(parts).alias("part", "chunk")).withColumn("chunk_id", F.concat(F.col(ident).cast("string"), F.lit("_part"), F.col("part").cast("string")))


def linearize_rows(df: DataFrame, columns: list[str], name: str | None = None) -> Column:
    """``header is value, ...`` of one row; blank values are left out."""
    values = [F.when(F.trim(F.col(x).cast("string")) != "", F.concat(F.lit(f"{x} is "), F.col(x).cast("string"))) for x in columns]
    body = F.concat_ws(", ", *values)
    return F.concat(F.lit(f"{name}: "), body) if name else body


def slice_transcript(cues: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Cues whose closed interval meets a range, in order: (range_id, n_cues, text).

    Cues (key, start, stop, text) and ranges (range_id, key, start, stop) meet on key and on time slots
    of ``width``; a pair that shares several slots counts in the first.
    """
    slots = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width)))
    a = cues.withColumn("slot", slots()).alias("a")
    b = ranges.withColumn("slot", slots()).alias("b")
    first = F.greatest(F.floor(F.col("a.start") / width), F.floor(F.col("b.start") / width)) == F.col("a.slot")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.slot") == F.col("b.slot")) & first & (F.col("a.start") <= F.col("b.stop")) & (F.col("a.stop") >= F.col("b.start"))
    clean = F.regexp_replace("a.text", "<[^>]*>", "")
    return a.join(b, meet).groupBy("b.range_id").agg(F.count("*").alias("n_cues"), F.array_join(ordered_collect(clean, "a.start", "a.cue_id"), " ").alias("text"))


def truncate_history(turns: DataFrame, max_tokens: int, reserved: int = 0, tokens: Column | None = None) -> DataFrame:
    """The most recent turns whose token sum, counted from the end, stays within the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    cost = estimate_tokens("text") if tokens is None else tokens
    return turns.withColumn("tokens", cost).withColumn("suffix", F.sum("tokens").over(w)).where(F.col("suffix") <= max_tokens - reserved)


def keep_last_words(text: Column | str, n: int) -> Column:
    parts = F.filter(F.split(c(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    return F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), " ")


def truncate_by_score(df: DataFrame, text: str, limit: float, out: str = "cut") -> DataFrame:
    """Cut where the summed token scores pass ``limit``: CJK characters 1.0, words 1.3 (5 % over allowed), numbers 0.8, other marks 0.3, white space 0."""
    token = "[\\u4E00-\\u9FFF\\u3040-\\u30FF]|[0-9]+|[^\\W\\d_]+|\\s+|."
    tokens = F.regexp_extract_all(F.col(text), F.lit(f"(?sU)({token})"), F.lit(1))
    score = lambda t: F.when(t.rlike("^[\\u4E00-\\u9FFF\\u3040-\\u30FF]$"), 1.0).when(t.rlike("^[0-9]+$"), 0.8).when(t.rlike("(?U)^[^\\W\\d_]+$"), 1.3).when(t.rlike("^\\s+$"), 0.0).otherwise(0.3)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a: Column, t: Column) -> Column:
        total = a["sum"] + score(t)
        allowed = F.when(score(t) == 1.3, limit * 1.05).otherwise(limit)
        return F.when(a["full"] | (total > allowed), F.struct(a["sum"].alias("sum"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(total.alias("sum"), (a["n"] + 1).alias("n"), F.lit(False).alias("full")))

    cut = F.slice("_tokens", F.lit(1), F.aggregate("_tokens", start, step)["n"])
    return df.withColumn("_tokens", tokens).withColumn(out, F.array_join(cut, "")).drop("_tokens")


def history_view(rounds: DataFrame, modality: str) -> DataFrame:
    """Two turn rows per round. ``text_only`` appends captions, ``no_visual`` drops images and captions, ``multimodal`` keeps images; blank sides are dropped."""
    text = F.col("user_text")
    if modality == "text_only":
        text = F.concat_ws("\n", text, F.when(F.col("caption") != "", F.concat(F.lit("[image] "), "caption")))
    images = F.col("images") if modality == "multimodal" else F.array().cast("array<string>")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), text.alias("text"), images.alias("images")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text"), F.array().cast("array<string>").alias("images")))
    rows = rounds.select("conv_id", "round", F.explode(sides).alias("s")).select("conv_id", "round", "s.*")
    return rows.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.size("images") > 0))


def oracle_context(rounds: DataFrame, questions: DataFrame, by: str = "conv_id") -> DataFrame:
    """Rounds in the sessions (or with the clue ids) that questions name: ``questions`` has (question_id, targets array)."""
    wanted = questions.select("question_id", F.explode(F.array_distinct("targets")).alias(by))
    return rounds.join(wanted, by).select("question_id", *rounds.columns)


def token_stats(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Word and token counts per scope."""
    n_words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    return df.groupBy(*by).agg(F.count("*").alias("n_texts"), F.sum(n_words).alias("n_words"), F.sum(F.when(F.length(text) > 0, estimate_tokens(text)).otherwise(0)).alias("n_tokens"), F.max(n_words).alias("max_words"))


def strings_in(column: Column, kind: DataType) -> Column:
    """Array of all strings in a value of any nested type, in order; map keys aside."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(column.isNull(), none).otherwise(F.array(column))
    if isinstance(kind, StructType):
        parts = [strings_in(column[f.name], f.dataType) for f in kind.fields]
        return F.when(column.isNull() | F.lit(not parts), none).otherwise(F.concat(none, *parts))
    if isinstance(kind, (ArrayType, MapType)):
        inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
        items = column if isinstance(kind, ArrayType) else F.map_values(column)
        return F.coalesce(F.flatten(F.transform(items, lambda x: strings_in(x, inner))), none)
    return none


def collect_strings(df: DataFrame, column: str, out: str = "strings") -> DataFrame:
    """Adds all strings of a nested column, found by its schema at whatever depth."""
    return df.withColumn(out, strings_in(F.col(column), df.schema[column].dataType))


def explode_turns(chunks: DataFrame, texts: str = "texts", speakers: str = "speakers") -> DataFrame:
    """One row per utterance of a chunk, with its speaker as prefix."""
    return chunks.select("conv_id", "round", F.posexplode(F.arrays_zip(speakers, texts)).alias("place", "u")).select("conv_id", "round", "place", F.concat_ws(": ", F.col(f"u.{speakers}"), F.col(f"u.{texts}")).alias("utterance"))


def count_windows(turns: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` turns, each ``max(1, size - overlap)`` after the one before; the last holds what is left from its start."""
    step = max(1, size - overlap)
    w = Window.partitionBy("conv_id")
    rows = turns.withColumn("n", F.row_number().over(by_turn()) - 1).withColumn("total", F.count("*").over(w))
    full = F.greatest(F.floor((F.col("total") - size) / step) + 1, F.lit(0))
    last = F.when(full * step < F.col("total"), full).otherwise(full - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / step)).cast("long")
    rows = rows.withColumn("low", low).withColumn("high", F.least(F.floor(F.col("n") / step), last).cast("long")).where("low <= high")
    return rows.withColumn("window", F.explode(F.sequence("low", "high"))).groupBy("conv_id", "window").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def force_segments(turns: DataFrame, max_msgs: int, max_tokens: int, segment: int = SEGMENT) -> DataFrame:
    """Cut a prefix of min(max_msgs - 1, n - 1) messages, halved while its tokens reach the limit, until what is left fits.

    A cut follows from its first message and the ``max_msgs`` after it, which a segment borrows from the next one; what a segment is entered with is how many of
    its messages still belong to the cut before.
    """
    most = max(1, max_msgs - 1)

    def cuts(rows: dict) -> tuple[np.ndarray, int]:
        """Where the cut that starts at each own message ends, and how many own messages there are."""
        own = int(rows["own"].sum())
        sums = np.concatenate([[0], np.cumsum(rows["tokens"].astype(np.int64))])
        at = np.arange(own)
        left = len(rows["tokens"]) - at  # exact where fewer than max_msgs follow; else at least so many
        take = np.maximum(1, np.minimum(most, left - 1))
        while True:
            shorten = (take > 1) & (sums[at + take] - sums[at] >= max_tokens)
            if not shorten.any():
                break
            take = np.where(shorten, take // 2, take)
        rest = ((left < max_msgs) & (sums[-1] - sums[at] < max_tokens)) | (left == 1)
        return at + np.where(rest, left, take), own

    def summarise(rows: dict) -> list:
        end, own = cuts(rows)
        count, over = np.zeros(own + 1, np.int64), np.zeros(own + 1, np.int64)
        for i in range(own - 1, -1, -1):
            count[i] = 1 + (count[end[i]] if end[i] < own else 0)
            over[i] = over[end[i]] if end[i] < own else end[i] - own
        return [own, count[:max_msgs].tolist(), over[:max_msgs].tolist()]

    def fold(state: list, told: list) -> list:
        number, skip = state
        own, count, over = told
        return [number, skip - own] if skip >= own else [number + count[skip], over[skip]]

    def finish(rows: dict, state: list) -> dict:
        end, own = cuts(rows)
        at, starts = state[1], []
        while at < own:
            starts.append(at)
            at = int(end[at])
        return {"segment": state[0] - 1 + np.searchsorted(starts, np.arange(own), side="right")}

    sized = turns.select("conv_id", "turn", estimate_tokens("text").cast("long").alias("tokens"))
    rows = segmented(numbered(sized, "conv_id", ["turn"]), max(segment, max_msgs), after=max_msgs)
    return finished(entered(rows, summarise, fold, [0, 0]), finish, [0, 0], "conv_id long, turn long, tokens long, segment long")
