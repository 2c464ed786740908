"""Rules that run along a sequence, in parallel: sequences of any length are numbered, cut into segments, and what a segment does to the state it is
entered with is composed over its sequence's segments.

A rule has three parts. ``summarise`` describes a segment for whatever state may come in, in a few numbers; ``fold`` takes a state
through such a description; ``finish`` works a segment's rows out from the state it is really entered with. Only descriptions, a row a segment of ``size``
rows, are read in sequence, one by one; sequences of one segment skip that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from mnemoloom.session import stage

#: Rows of a segment.
SEGMENT = 20_000


def key_text(key: Column) -> Column:
    """A key as a string that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit(""))


def numbered(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``k`` (the key as text) and ``idx``, their number within the key in ``order``, whatever a key's share of the rows.

    Rows are range-partitioned by key and order and counted within their partition, and stored. Only a partition's first key can go on from earlier ones, so
    one count a partition is broadcast. Rows equal in key and order are dealt by their place in the input.
    """

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, opening = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, at = batch.column("k"), np.arange(n)
            heads = np.append(k[0].as_py() != last, np.asarray(pc.not_equal(k.slice(1), k.slice(0, n - 1)), bool))
            head = np.maximum.accumulate(np.where(heads, at, -1))
            rank = np.where(head >= 0, at - head, at + held)
            opening = k[0].as_py() if opening is None else opening
            last, held = k[n - 1].as_py(), int(rank[-1]) + 1
            first = pc.equal(k, opening)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rank.astype(np.int64)), first], names=[*batch.schema.names, "part", "rank", "first_key"])

    keyed = rows.withColumn("k", key_text(F.col(key)))
    schema = StructType([*keyed.schema.fields, StructField("part", IntegerType()), StructField("rank", LongType()), StructField("first_key", BooleanType())])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["k", *order, "salt"]
    dealt = keyed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("salt")
    table = stage(dealt.mapInArrow(ranked, schema), "numbered")
    counts = table.groupBy("k", "part").agg((F.max("rank") + 1).alias("n"))
    before = counts.selectExpr("part", "sum(n) over (partition by k order by part rows between unbounded preceding and 1 preceding) as before").where("before > 0")
    met = table.join(F.broadcast(before), "part", "left")
    return met.withColumn("idx", F.col("rank") + F.when(F.col("first_key"), F.coalesce("before", F.lit(0))).otherwise(0)).drop("part", "rank", "first_key", "before")


def segmented(rows: DataFrame, size: int = SEGMENT, before: int = 0, after: int = 0) -> DataFrame:
    """Numbered rows with ``seg`` and ``own``; a segment also gets, not as its own, ``before`` rows of the segment before and ``after`` of the one behind it."""
    if max(before, after) > size:
        raise ValueError("a segment must be as long as what its neighbours lend")
    home, at = F.floor(F.col("idx") / size), F.col("idx") % size
    lent = [F.when(at >= size - before, home + 1)] * bool(before) + [F.when((at < after) & (home > 0), home - 1)] * bool(after)
    return rows.withColumn("seg", F.explode(F.array_compact(F.array(home, *lent)))).withColumn("own", F.col("seg") == home)


def entered(rows: DataFrame, summarise: Callable, fold: Callable, start, backward: bool = False) -> DataFrame:
    """Segmented rows with ``state``, the JSON of the state that their segment is entered with: null for the first (``backward``: the last), which is entered with ``start``.

    ``summarise(rows)`` gets a segment's columns as numpy arrays, rows lent included, in order; ``fold(state, description)`` the next state. Both are of what JSON has.
    """

    def describe(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        told = [(keys[0], keys[1], json.dumps(summarise({c: pdf[c].to_numpy() for c in pdf})))] if pdf["own"].any() else []
        return pd.DataFrame(told, columns=["k", "seg", "body"])

    def through(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in frames:
            out = []
            for k, seg, body in pdf[["k", "seg", "body"]].itertuples(index=False):
                if k != at:
                    at, state = k, start
                else:
                    out.append((k, seg, json.dumps(state)))
                state = fold(state, json.loads(body))
            yield pd.DataFrame(out, columns=["k", "seg", "state"])

    many = rows.where("seg > 0").select("k").distinct()
    bodies = rows.join(many, "k", "left_semi").groupBy("k", "seg").applyInPandas(describe, "k string, seg long, body string")
    told = bodies.repartition("k").sortWithinPartitions("k", F.desc("seg") if backward else "seg").mapInPandas(through, "k string, seg long, state string")
    return rows.join(told, ["k", "seg"], "left")


def finished(rows: DataFrame, finish: Callable, start, schema: str) -> DataFrame:
    """The segments' own rows, with the columns that ``finish(rows, state)`` makes: it gets a segment's columns as numpy arrays, rows lent included, in order,
    and the state that it is entered with, and gives a value for each own row; NaN is null. Columns of ``schema`` that it doesn't make pass through.

    Segments come sorted, many to a batch, so that a short sequence costs what its rows do; a task holds a batch and a segment.
    """
    made = StructType.fromDDL(schema)
    types = {f.name: t.type for f, t in zip(made, to_arrow_schema(made), strict=True)}

    def work(held: pa.Table, ends: list[int]) -> pa.RecordBatch:
        """The own rows of a table of whole segments that end at ``ends``."""
        own = held.column("own").to_numpy()
        columns = {c: held.column(c).to_numpy() for c in held.column_names if c not in ("k", "seg", "state")}
        states = held.column("state") if "state" in held.column_names else None
        parts, a = [], 0
        for b in ends:
            if own[a:b].any():  # else rows lent to a segment that the sequence doesn't reach
                state = states[a].as_py() if states is not None else None
                parts.append(finish({c: v[a:b] for c, v in columns.items()}, start if state is None else json.loads(state)))
            a = b
        kept = held.filter(held.column("own"))
        new = {c: pa.array(np.concatenate([p[c] for p in parts]), types[c], from_pandas=True) for c in (parts[0] if parts else ())}
        return pa.RecordBatch.from_arrays([new[c] if c in new else kept.column(c).cast(t).combine_chunks() if parts else pa.array([], t) for c, t in types.items()], names=list(types))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, seg = batch.column("k"), batch.column("seg").to_numpy()
            heads = np.flatnonzero(np.append(True, np.asarray(pc.not_equal(k.slice(1), k.slice(0, n - 1)), bool) | (seg[1:] != seg[:-1])))
            if last == (k[0].as_py(), seg[0]):
                heads = heads[1:]
            if len(heads):  # what came before the last head is whole
                before, to = sum(map(len, held)), int(heads[-1])
                whole = pa.Table.from_batches([*held, batch.slice(0, to)])
                if len(whole):
                    yield work(whole, [before + int(h) for h in heads if before + h > 0])
                held = []
                batch = batch.slice(to)
            held.append(batch)
            last = k[n - 1].as_py(), seg[-1]
        if held:
            whole = pa.Table.from_batches(held)
            yield work(whole, [len(whole)])

    # By a hash of the keys: a repartition by the keys of the join before it would be left out of the plan, and what the join then deals anew would part segments.
    return rows.repartition(F.xxhash64("k", "seg")).sortWithinPartitions("k", "seg", "idx").mapInArrow(run, made)
