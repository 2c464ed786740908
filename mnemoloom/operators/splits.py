"""Split manifests, quotas, audits, evidence masks, artefact matching, boxes, signatures, and training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mnemoloom.operators.segments import SEGMENT, entered, finished, key_text, numbered, segmented
from mnemoloom.session import stage

#: Images with more boxes than this are worked on by many tasks.
BOXES = 5000


def validate_split(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """Violations (check, key): a conversation or question in two splits, a declared count that does not hold.

    manifest: (split, conversation_id, question_id); declared: (split, question_count).
    """
    twice = lambda key, name: manifest.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"))
    counts = declared.join(manifest.groupBy("split").agg(F.countDistinct("question_id").alias("n")), "split", "full")
    wrong = counts.where(~F.col("question_count").eqNullSafe(F.col("n"))).select(F.lit("question count").alias("check"), F.col("split").cast("string").alias("key"))
    return twice("conversation_id", "conversation in two splits").unionByName(twice("question_id", "question in two splits")).unionByName(wrong)


def split_summary(manifest: DataFrame, excluded: DataFrame) -> DataFrame:
    """Conversations, questions and questions left after exclusions per split."""
    x = manifest.join(excluded.select("question_id").distinct().withColumn("out", F.lit(True)), "question_id", "left")
    return x.groupBy("split").agg(F.countDistinct("conversation_id").alias("conversations"), F.countDistinct("question_id").alias("questions"), F.countDistinct(F.when(F.col("out").isNull(), F.col("question_id"))).alias("effective"))


def materialize_splits(questions: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with their split, and the ids that only one side has."""
    ids = manifest.select("question_id", "split")
    both = questions.join(ids, "question_id")
    a, b = questions.select("question_id"), ids.select("question_id")
    return both, a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def ordered_questions(manifest: DataFrame, lists: str) -> DataFrame:
    """Question ids of a manifest's arrays with their place kept."""
    return manifest.select("split", "conversation_id", F.posexplode(lists).alias("ordinal", "question_id"))


def quota_sample(df: DataFrame, quota: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of each category that has a quota (by, n), and how many are lacking."""
    w = Window.partitionBy(by).orderBy(*order)
    taken = df.join(quota, by).withColumn("place", F.row_number().over(w)).where("place <= n").drop("place", "n")
    lack = quota.join(taken.groupBy(by).agg(F.count("*").alias("got")), by, "left").fillna(0, ["got"]).where("got < n").select(by, (F.col("n") - F.col("got")).alias("short"))
    return taken, lack


def sample_per_group(df: DataFrame, by: str, ident: str, fraction: float, seed: int) -> DataFrame:
    """floor(n * fraction) rows of each group in hash order, and that order as ``shuffle``."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256)
    w = Window.partitionBy(by)
    x = df.withColumn("shuffle", key).withColumn("place", F.row_number().over(w.orderBy("shuffle"))).withColumn("size", F.count("*").over(w))
    return x.where(F.col("place") <= F.floor(F.col("size") * fraction)).drop("place", "size")


def subset(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the given ids, and the ids that do not occur."""
    return df.join(ids, key, "left_semi"), ids.join(df, key, "left_anti")


def clue_coverage(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Clue ids (question_id, clues array) that no chunk (clue) holds."""
    return questions.select("question_id", F.explode("clues").alias("clue")).join(chunks.select("clue").distinct(), "clue", "left_anti")


def audit_run(results: DataFrame, traces: DataFrame, manifest: DataFrame, k: int) -> DataFrame:
    """Checks of a run as rows (check, passed, detail): results (question_id, error, hits), traces and manifest (question_id)."""
    want, got = manifest.select("question_id"), results.select("question_id")
    diff = lambda a, b: a.exceptAll(b).agg(F.count("*").alias("n"))
    rows = [
        ("missing results", diff(want, got)), ("extra results", diff(got, want)), ("missing traces", diff(want, traces.select("question_id"))),
        ("errors", results.agg(F.count_if(F.col("error").isNotNull()).alias("n"))), ("too many hits", results.agg(F.count_if(F.col("hits") > k).alias("n"))),
    ]
    out = None
    for name, x in rows:
        x = x.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").alias("detail"))
        out = x if out is None else out.unionByName(x)
    return out


def check_captions(df: DataFrame, images: str, captions: str) -> Column:
    """Whether there are as many captions as images and none is blank."""
    return (F.size(images) == F.size(captions)) & ~F.exists(captions, lambda x: x.isNull() | (F.trim(x) == ""))


def availability(hits: DataFrame) -> Column:
    """Bit mask of evidence: 1 summary, 2 one source dialogue, 4 caption, 8 image of a visual hit, 16 primitive of a visual hit."""
    bit = lambda cond, n: F.when(cond, n).otherwise(0)
    return bit(F.col("summary") != "", 1) + bit(F.size("dialogues") == 1, 2) + bit(F.col("caption") != "", 4) + bit(F.col("has_image") & F.col("visual"), 8) + bit(F.col("has_primitive") & F.col("visual"), 16)


def choose_actions(mask: Column, mode: str, seed: int, ident: Column) -> Column:
    """``full``: all that is available; ``summary``: the summary alone; ``random``: a hashed part of it."""
    if mode == "full":
        return mask
    if mode == "summary":
        return mask.bitwiseAND(F.lit(1))
    return mask.bitwiseAND(F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(32)).cast("int"))


def match_artifacts(images: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artefact of each image (image_id, path, sha256): the one named by the hash, else the only one whose path ends in the image's: artifacts (artifact_id, path)."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    a = artifacts.select("artifact_id", F.col("path").alias("a_path"), base(F.col("path")).alias("name"))
    by_hash = images.join(a.select(F.split("name", "\\.")[0].alias("sha256"), "artifact_id"), "sha256").groupBy("image_id").agg(F.min("artifact_id").alias("hashed"))
    near = images.withColumn("name", base(F.col("path"))).join(a, "name").where(F.col("a_path").endswith(F.col("path")) | F.col("path").endswith(F.col("a_path")))
    one = near.groupBy("image_id").agg(F.count("*").alias("n"), F.min("artifact_id").alias("suffixed")).where("n = 1")
    x = images.join(by_hash, "image_id", "left").join(one, "image_id", "left")
    return x.select("image_id", F.coalesce("hashed", "suffixed").alias("artifact_id"), F.when(F.col("hashed").isNotNull(), "hash").when(F.col("suffixed").isNotNull(), "suffix").otherwise("none").alias("how"))


def area(x: str = "") -> Column:
    return (F.col(f"{x}x2") - F.col(f"{x}x1")) * (F.col(f"{x}y2") - F.col(f"{x}y1"))


def drop_parents(boxes: DataFrame, big: float = 0.9, inside: float = 0.95, small: float = 0.8) -> DataFrame:
    """Boxes (image_id, box_id, x1..y2 in 0..1000) without those of ``big`` or more of the image that hold most of a clearly smaller one."""
    p, c = boxes.where(area() >= big * 1_000_000).alias("p"), boxes.alias("c")
    wide = F.greatest(F.lit(0), F.least("p.x2", "c.x2") - F.greatest("p.x1", "c.x1"))
    high = F.greatest(F.lit(0), F.least("p.y2", "c.y2") - F.greatest("p.y1", "c.y1"))
    holds = (F.col("p.image_id") == F.col("c.image_id")) & (F.col("p.box_id") != F.col("c.box_id")) & (wide * high >= inside * area("c.")) & (area("c.") < small * area("p."))
    return boxes.join(p.join(c, holds).select("p.image_id", "p.box_id").distinct(), ["image_id", "box_id"], "left_anti")


def dedup_boxes(boxes: DataFrame, iou: float = 0.6, most: int = BOXES) -> DataFrame:
    """Per image, larger boxes first (then the smaller box_id): a box that overlaps a kept one by ``iou`` or more goes.

    Images of up to ``most`` boxes are groups of a task each; those of larger images meet in grid cells, see ``_crowded``. An image's null id is an image.
    """
    if not 0 < iou <= 1:
        raise ValueError("iou must be over 0 and at most 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(a=(pdf.x2 - pdf.x1) * (pdf.y2 - pdf.y1)).sort_values(["a", "box_id"], ascending=[False, True])
        v, kept = pdf[["x1", "y1", "x2", "y2", "a"]].to_numpy(float), []
        for i, b in enumerate(v):
            k = v[kept]
            w = np.clip(np.minimum(k[:, 2], b[2]) - np.maximum(k[:, 0], b[0]), 0, None) * np.clip(np.minimum(k[:, 3], b[3]) - np.maximum(k[:, 1], b[1]), 0, None)
            if not (w / np.maximum(k[:, 4] + b[4] - w, 1e-9) >= iou).any():
                kept.append(i)
        return pdf.iloc[kept].drop(columns="a")

    sizes = boxes.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(key_text(F.col("image_id")).alias("k"))
    keyed = boxes.withColumn("k", key_text(F.col("image_id")))
    small = keyed.join(sizes, "k", "left_anti").drop("k").groupBy("image_id").applyInPandas(run, boxes.schema)
    if sizes.isEmpty():
        return small
    large = stage(keyed.join(sizes, "k", "left_semi"), "crowded-boxes")
    return small.unionByName(large.join(_crowded(large, iou), ["k", "box_id"], "left_anti").drop("k"))


def _crowded(boxes: DataFrame, iou: float) -> DataFrame:
    """(k, box_id) of the boxes that go.

    Boxes that overlap by ``iou`` share ``iou`` of the larger width and of the larger height, so their widths, and heights, lie in one or in neighbouring powers
    of 1 / iou. A box is told to the cells that it covers in grids of its own power and the next, cells being as wide as the power: four at most in
    each of four grids. Pairs meet by equi-joins on the cell. Of equal boxes only the first takes part. Then all boxes that no larger one may remove stay at once, what they
    remove goes, and so on.
    """
    corners = ["x1", "y1", "x2", "y2"]
    first = boxes.where("x2 > x1 and y2 > y1").groupBy("k", *corners).agg(F.min("box_id").alias("box_id"))
    copies = boxes.where("x2 > x1 and y2 > y1").join(first.withColumnRenamed("box_id", "kept"), ["k", *corners]).where("box_id > kept").select("k", "box_id")
    base = 1 / iou if iou < 0.9 else 1.2  # near 1, powers of 1 / iou would be too many to tell apart
    power = lambda a, b: F.floor(F.log(F.col(b) - F.col(a)) / F.lit(float(np.log(base))) + 1e-9)
    grids = first.withColumn("p", F.explode(F.sequence(power("x1", "x2"), power("x1", "x2") + 1))).withColumn("q", F.explode(F.sequence(power("y1", "y2"), power("y1", "y2") + 1)))
    place = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(base), F.col(level) + 1))
    told = grids.withColumn("cx", F.explode(F.sequence(place("x1", "p"), place("x2", "p")))).withColumn("cy", F.explode(F.sequence(place("y1", "q"), place("y2", "q"))))
    told = stage(told.withColumn("a", area()), "box-cells")
    x, y = told.alias("x"), told.alias("y")
    before = (F.col("x.a") > F.col("y.a")) | ((F.col("x.a") == F.col("y.a")) & (F.col("x.box_id") < F.col("y.box_id")))
    shared = F.greatest(F.lit(0), F.least("x.x2", "y.x2") - F.greatest("x.x1", "y.x1")) * F.greatest(F.lit(0), F.least("x.y2", "y.y2") - F.greatest("x.y1", "y.y1"))
    much = shared.cast("double") / F.greatest(F.col("x.a") + F.col("y.a") - shared, F.lit(1e-9)) >= iou
    met = x.join(y, [*(F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("k", "p", "q", "cx", "cy")), before, much])
    edges = stage(met.select(F.col("x.k").alias("k"), F.col("x.box_id").alias("over"), F.col("y.box_id").alias("under")).distinct(), "box-edges")
    gone = copies
    while not edges.isEmpty():
        stay = edges.select("k", F.col("over").alias("box_id")).distinct().join(edges.select("k", F.col("under").alias("box_id")), ["k", "box_id"], "left_anti")
        goes = stage(edges.join(stay.withColumnRenamed("box_id", "over"), ["k", "over"], "left_semi").select("k", F.col("under").alias("box_id")).distinct(), "boxes-gone")
        gone = gone.unionByName(goes)
        for end in ("over", "under"):
            edges = edges.join(goes.withColumnRenamed("box_id", end), ["k", end], "left_anti")
        edges = stage(edges, "box-edges")
    return gone


def signature(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """SHA-256 per group over its rows as JSON, in sorted order, newline-joined: the same for the same set of rows.

    A group's rows pass through the digest one by one, sorted on the way; neither the rows nor their text are ever held together. Null keys are a group.
    """
    key, row = F.to_json(F.struct(*by)), F.to_json(F.struct(*cols))
    schema = StructType([*(df.schema[c] for c in by), StructField("signature", StringType()), StructField("n", LongType())])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, n, first = None, None, 0, None
        done: list[tuple[pa.RecordBatch, str, int]] = []

        def ready() -> pa.RecordBatch:
            keys = pa.Table.from_batches([f for f, _, _ in done]).combine_chunks()
            columns = [keys.column(c).combine_chunks() for c in by]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s, _ in done], pa.string()), pa.array([m for _, _, m in done], pa.int64())], names=schema.names)
            done.clear()
            return made

        for batch in batches:
            for i, (k, r) in enumerate(zip(batch.column("signature_key").to_pylist(), batch.column("signature_row").to_pylist(), strict=True)):
                if k != at:
                    if at is not None:
                        done.append((first, sha.hexdigest(), n))
                    at, sha, n, first = k, hashlib.sha256(), 0, batch.slice(i, 1).select(by)
                sha.update((b"\n" if n else b"") + r.encode())
                n += 1
            if len(done) > 1000:
                yield ready()
        if at is not None:
            done.append((first, sha.hexdigest(), n))
        if done:
            yield ready()

    rows = df.select(*by, key.alias("signature_key"), row.alias("signature_row"))
    return rows.repartition("signature_key").sortWithinPartitions("signature_key", "signature_row").mapInArrow(fold, schema)


def sliding_normalize(df: DataFrame, window: int = 512, warm: int = 128, batch: int = 32, floor: float = 0.25, segment: int = SEGMENT) -> DataFrame:
    """Costs (series, seq from 0, cost, quality) normalised batch by batch.

    Roots of costs are scaled by the 5th and 95th percentile of the ``window`` values before the batch,
    the range being at least ``floor`` times that of the first ``warm`` values, and cut to 0..1; inactive
    (null) until ``warm`` values came before. ``scale`` is std(quality) / std(normalised) over the same
    values with the same bounds. Nulls are no values. A series is cut into segments that borrow the ``window`` rows before them,
    and each gets the first values' range by way of its predecessors, so each row moves once, or twice if it is lent.
    """
    size = max(batch, segment // batch * batch)
    while size < max(window, warm):
        size += batch

    def bounds(values: np.ndarray) -> tuple[float, float]:
        there = values[~np.isnan(values)]
        return tuple(np.quantile(there, [0.05, 0.95])) if len(there) else (np.nan, np.nan)

    def initial(rows: dict) -> float | None:
        low, high = bounds(np.sqrt(rows["cost"].astype(float)[:warm]))
        return None if np.isnan(low) else float(high - low)

    def finish(rows: dict, state: float | None) -> dict:
        root, quality, first = np.sqrt(rows["cost"].astype(float)), rows["quality"].astype(float), int(rows["idx"][0])
        least = initial(rows) if first == 0 else state
        unit, scale = np.full(len(root), np.nan), np.full(len(root), np.nan)
        own = np.flatnonzero(rows["own"])
        for start in range(-(-(first + int(own[0])) // batch) * batch, first + len(root), batch):
            if start < warm or least is None:
                continue
            seen, now = slice(max(0, start - window - first), start - first), slice(start - first, start - first + batch)
            low, high = bounds(root[seen])
            wide = max(high - low, floor * least)
            with np.errstate(divide="ignore", invalid="ignore"):
                unit[now] = np.clip((root[now] - low) / wide, 0, 1)
                scale[now] = np.nanstd(quality[seen]) / (np.nanstd(np.clip((root[seen] - low) / wide, 0, 1)) + 1e-8)
        return {"normalized": unit[own], "scale": scale[own]}

    rows = df.select("series", "seq", F.col("cost").cast("double"), F.col("quality").cast("double"), key_text(F.col("series")).alias("k"), F.col("seq").cast("long").alias("idx"))
    told = entered(segmented(rows, size, before=window), lambda found: initial(found) if int(found["idx"][0]) == 0 else None, lambda state, found: found if state is None else state, None)
    kind = df.schema["series"].dataType.simpleString()
    return finished(told, finish, None, f"series {kind}, seq long, normalized double, scale double")


def gae(df: DataFrame, gamma: float, lam: float, segment: int = SEGMENT) -> DataFrame:
    """Generalised advantages per episode (episode, step, reward, value), values after the last step being 0.

    ``A(t) = delta(t) + gamma * lam * A(t + 1)`` is an affine map of what comes after; a segment of an episode is the composition of its rows' maps, two
    numbers, and is worked out backward from the advantage that its successor begins with.
    """

    def deltas(rows: dict) -> np.ndarray:
        value, own = rows["value"].astype(float), int(rows["own"].sum())
        return rows["reward"].astype(float)[:own] + gamma * np.append(value[1:], 0.0)[:own] - value[:own]

    def back(delta: np.ndarray, after: float) -> np.ndarray:
        out, a = np.empty(len(delta)), after
        for i in range(len(delta) - 1, -1, -1):
            a = delta[i] + gamma * lam * a
            out[i] = a
        return out

    def summarise(rows: dict) -> list:
        delta = deltas(rows)
        return [float(back(delta, 0.0)[0]), (gamma * lam) ** len(delta)]

    def finish(rows: dict, state: float) -> dict:
        return {"advantage": back(deltas(rows), state)}

    rows = df.select("episode", "step", F.col("reward").cast("double"), F.col("value").cast("double"))
    told = entered(segmented(numbered(rows, "episode", ["step"]), segment, after=1), summarise, lambda a, told: told[0] + told[1] * a, 0.0, backward=True)
    kinds = [df.schema[c].dataType.simpleString() for c in ("episode", "step")]
    return finished(told, finish, 0.0, f"episode {kinds[0]}, step {kinds[1]}, advantage double")
