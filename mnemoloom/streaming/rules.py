"""Online-ingest rules on Structured Streaming, with batch twins of the stateful ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mnemoloom.session import children, drop_folder, rename_folder


def stream_sessions(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions (key, start, end, n) of turns (key, ts) that a gap ends; on a stream turns later than ``late`` are dropped."""
    rows = turns.withWatermark("ts", late) if turns.isStreaming else turns
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_call_stats(calls: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls, failures and tokens by event-time window: calls (ts, phase, failed, tokens)."""
    rows = calls.withWatermark("ts", late) if calls.isStreaming else calls
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "phase").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "phase", "calls", "failed", "tokens")


Step = Callable[[tuple | None, dict], tuple[tuple | None, tuple | None]]


class InEventTime(StatefulProcessor):
    """Applies a rule to a key's rows in order of (at, seq), however they arrive within the watermark.

    Rows wait in a list state until the watermark has passed them; an event-time timer at the earliest wakes the key. The rule's own state is
    a value state, cleared by another timer when the key has been idle for ``idle`` seconds, so a key costs nothing for long.
    ``step`` gets the state (null at first) and a row and gives the next state (null: nothing to keep) and an output row or null.
    """

    def __init__(self, step: Step, kept: str, waiting: StructType, out: list[str], idle: float | None) -> None:
        self.step, self.kept, self.waiting, self.out, self.idle = step, StructType.fromDDL(kept + ", idle_at double"), waiting, out, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state, self.rows = handle.getValueState("state", self.kept), handle.getListState("rows", self.waiting)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, first = self.waiting.names, None
        for pdf in rows:
            if len(pdf):
                self.rows.appendList([tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in r) for r in pdf[names].itertuples(index=False)])
                first = min(pdf["at"].min(), np.inf if first is None else first)
        if first is not None:
            self.handle.registerTimer(int(first * 1000))
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.waiting.names, r, strict=True)) for r in self.rows.get()]
        due = sorted((r for r in rows if int(r["at"] * 1000) <= past), key=lambda r: (r["at"], r["seq"]))
        held = self.state.get() if self.state.exists() else None
        state, last = (None, None) if held is None else (tuple(held[:-1]), held[-1])
        out = []
        for r in due:
            if self.idle is not None and last is not None and r["at"] - last > self.idle:
                state = None
            state, made = self.step(state, r)
            last = r["at"]
            if made is not None:
                out.append((key[0], *made))
        if due:
            rest = [tuple(r[n] for n in self.waiting.names) for r in rows if int(r["at"] * 1000) > past]
            self.rows.clear()
            if rest:
                self.rows.put(rest)
                self.handle.registerTimer(int(min(r[self.waiting.names.index("at")] for r in rest) * 1000))
        over = self.idle is not None and last is not None and int((last + self.idle) * 1000) < past
        if state is None or over:
            self.state.clear()
        else:
            self.state.update((*state, last))
            if self.idle is not None and due:
                self.handle.registerTimer(int((last + self.idle) * 1000) + 1)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out)

    def close(self) -> None:
        pass


def in_event_time(rows: DataFrame, key: str, step: Step, kept: str, out: str, idle: float | None, late: str) -> DataFrame:
    """A stream of (key, seq, at seconds, ..) through ``InEventTime``. Rows later than ``late`` are dropped; the session's state store must be RocksDB's."""
    waiting = StructType([f for f in rows.schema.fields if f.name != key])
    marked = rows.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("ts", late)
    processor = InEventTime(step, kept, waiting, StructType.fromDDL(out).names, idle)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(out), outputMode="Append", timeMode="EventTime")


def in_groups(rows: DataFrame, key: str, step: Step, out: str, idle: float | None) -> DataFrame:
    """The batch twin: each key's rows in order of (at, seq) through the same rule."""
    names = StructType.fromDDL(out).names

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, last, found = None, None, []
        for r in pdf.sort_values(["at", "seq"]).to_dict("records"):
            if idle is not None and last is not None and r["at"] - last > idle:
                state = None
            state, made = step(state, r)
            last = r["at"]
            if made is not None:
                found.append((keys[0], *made))
        return pd.DataFrame(found, columns=names)

    return rows.groupBy(key).applyInPandas(run, out)


NOVELTY = "source long, seq long, verdict string, similarity double"


def _novelty_step(low: float, high: float) -> Step:
    def step(state: tuple | None, row: dict) -> tuple:
        v = np.asarray(row["vector"], float)
        verdict, s = "accept", 0.0
        if state is not None:
            last = np.asarray(state[0], float)
            s = float(v @ last / (np.linalg.norm(v) * np.linalg.norm(last)))
            verdict = "accept" if s < low else "reject" if s > high else "uncertain"
        return (v.tolist(),) if verdict == "accept" else state, (row["seq"], verdict, s)

    return step


def novelty(frames: DataFrame, low: float, high: float, idle: float | None = None) -> DataFrame:
    """Each frame (source, seq, at seconds, vector) against the last accepted one: accepted below ``low``, rejected above ``high``, else uncertain. The first is accepted, and so is one after ``idle`` seconds without any."""
    return in_groups(frames, "source", _novelty_step(low, high), NOVELTY, idle)


def stream_novelty(frames: DataFrame, low: float, high: float, idle: float | None = 7 * 86400.0, late: str = "10 minutes") -> DataFrame:
    """The same on a stream, in order of event time; the state is one vector per source that had a frame in the last ``idle`` seconds."""
    return in_event_time(frames, "source", _novelty_step(low, high), "last array<double>", NOVELTY, idle, late)


CLUSTERS = "source long, seq long, cluster long"


def _cluster_step(t: float, gap: float) -> Step:
    def step(state: tuple | None, row: dict) -> tuple:
        v, now = np.asarray(row["vector"], float), float(row["at"])
        ids, vectors, counts, ats = ([], [], [], []) if state is None else (list(x) for x in state)
        live = [i for i, at in enumerate(ats) if now - at <= gap]
        ids, vectors, counts, ats = ([x[i] for i in live] for x in (ids, vectors, counts, ats))
        best = None
        if ids:
            held = np.array(vectors, float)
            s = held @ v / np.sqrt((held * held).sum(axis=1) * (v @ v))
            best = max(range(len(ids)), key=lambda i: (s[i], -ids[i]))
        if best is not None and s[best] >= t:
            n = counts[best]
            vectors[best], counts[best], ats[best] = ((held[best] * n + v) / (n + 1)).tolist(), n + 1, now
        else:
            best = len(ids)
            for column, x in ((ids, row["seq"]), (vectors, v.tolist()), (counts, 1), (ats, now)):
                column.append(x)
        return (ids, vectors, counts, ats), (row["seq"], ids[best])

    return step


def online_clusters(rows: DataFrame, t: float = 0.65, gap: float = 7 * 86400.0) -> DataFrame:
    """Running-mean clusters of (source, seq, at seconds, vector) in order of (at, seq): the nearest centroid if its similarity is ``t`` or more and
    its last row ``gap`` seconds old at most (ties: the older cluster), else a new one, named by the row's ``seq``."""
    return in_groups(rows, "source", _cluster_step(t, gap), CLUSTERS, gap)


def stream_clusters(rows: DataFrame, t: float = 0.65, gap: float = 7 * 86400.0, late: str = "10 minutes") -> DataFrame:
    """The same on a stream, in order of event time; a source's state holds the clusters of its last ``gap`` seconds, and goes after as long without rows."""
    return in_event_time(rows, "source", _cluster_step(t, gap), "ids array<bigint>, vectors array<array<double>>, counts array<bigint>, ats array<double>", CLUSTERS, gap, late)


ALARMS = "key long, start long, seq long, length long"


def _alarm_step(n: int) -> Step:
    def step(state: tuple | None, row: dict) -> tuple:
        if not row["failed"]:
            return None, None
        start, length = (row["seq"], 1) if state is None else (state[0], state[1] + 1)
        return (start, length), (start, row["seq"], length) if length == n else None

    return step


def failure_alarms(calls: DataFrame, n: int = 10) -> DataFrame:
    """One row (key, start, seq, length) for each run of failures that reaches ``n``, at its ``n``-th: calls (key, seq, failed), by windows."""
    runs = Window.partitionBy("key").orderBy("seq")
    x = calls.withColumn("good", F.sum((~F.col("failed")).cast("int")).over(runs)).where("failed")
    w = Window.partitionBy("key", "good").orderBy("seq")
    nth = x.select("key", F.min("seq").over(w).alias("start"), "seq", F.row_number().over(w).cast("long").alias("length"))
    return nth.where(F.col("length") == n)


def stream_failure_alarms(calls: DataFrame, n: int = 10, late: str = "10 minutes") -> DataFrame:
    """The same on a stream of (key, seq, at seconds, failed), in order of event time. Only a key that is failing has a state, of two numbers: a success clears it."""
    return in_event_time(calls, "key", _alarm_step(n), "start long, length long", ALARMS, None, late)


def upsert_stream(increments: DataFrame, target: str, merge: Callable[[DataFrame], DataFrame], checkpoint_dir: str, keep: int = 8):
    """Maintain a keyed table from a stream of rows in its own form. Returns the started query; ``read_upserted`` reads the table.

    ``merge`` turns rows, of which several may have one key, into one row a key, and may be applied again to its own results. A micro-batch
    writes its merged rows as a part of its own; every ``keep`` batches the parts are merged into a new base and those that it replaces
    deleted. So a batch costs as much as its own rows, and the whole table is rewritten once in ``keep`` batches. See ``apply_batch`` for failures.
    """
    return increments.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, target, merge, keep)).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def apply_batch(batch: DataFrame, number: int, target: str, merge: Callable[[DataFrame], DataFrame], keep: int) -> None:
    """One micro-batch, which may be killed anywhere and comes again then.

    Parts and bases are written under a temporary name and renamed when whole; nothing else is ever read. A batch whose part, or a
    base that holds it, is there already doesn't write it again; a base is not written twice; what a base replaces is deleted last.
    """
    spark = batch.sparkSession
    names = children(spark, target)

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{target}/tmp-{name}")
        rename_folder(spark, f"{target}/tmp-{name}", f"{target}/{name}")

    newest = max((x[5:] for x in names if x.startswith("base-")), default="")
    if f"part-{number:09d}" not in names and newest < f"{number:09d}":
        put(merge(batch), f"part-{number:09d}")
    if (number + 1) % keep == 0:
        if newest < f"{number:09d}":
            put(read_upserted(spark, target, merge), f"base-{number:09d}")
            newest = f"{number:09d}"
        for x in children(spark, target):
            if x.startswith(("base-", "part-")) and x[5:] <= newest and x != f"base-{newest}" or x.startswith("tmp-"):
                drop_folder(spark, f"{target}/{x}")


def read_upserted(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame], schema: StructType | None = None) -> DataFrame:
    """The table that ``upsert_stream`` keeps: its newest base and the parts after that. Before the first batch it is empty, of ``schema``, without which that is an error."""
    names = children(spark, target)
    base = max((x for x in names if x.startswith("base-")), default=None)
    parts = [x for x in names if x.startswith("part-") and (base is None or x[5:] > base[5:])]
    held = [f"{target}/{x}" for x in ([base] if base else []) + parts]
    if not held and schema is None:
        raise ValueError(f"nothing has been written to {target}, and no schema is given")
    return merge(spark.read.parquet(*held) if held else spark.createDataFrame([], schema))


def failure_runs(calls: DataFrame, n: int = 10) -> DataFrame:
    """Runs of ``n`` or more failures in a row (key, start, length) of calls (key, seq, failed)."""
    w = Window.partitionBy("key").orderBy("seq")
    x = calls.withColumn("good", F.sum((~F.col("failed")).cast("int")).over(w)).where("failed")
    return x.groupBy("key", "good").agg(F.min("seq").alias("start"), F.count("*").alias("length")).where(F.col("length") >= n).drop("good")
