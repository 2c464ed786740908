"""Attribute graphs, candidate relations and knowledge-graph tables. Edges are (source, target, ..)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.functions.columns import cosine, ordered_collect, rank_top
from mnemoloom.operators.components import connected_components
from mnemoloom.operators.pairs import by_item, by_side, counts, greedy_graphs, pairs_in_blocks, side_pairs
from mnemoloom.operators.retrieval import similarity_join
from mnemoloom.session import checkpoint, stage

PAIR = ["bank", "source", "target"]
LINK_ROWS = 4_096


def attribute_weights(attrs: DataFrame, banks: DataFrame, mode: str = "idf") -> DataFrame:
    """(bank, attribute, df, weight): attrs (bank, memory_id, attribute, side text/visual), banks (bank, n memories). Weight is ln((n + 1) / (df + 1)), or 1."""
    df = attrs.groupBy("bank", "attribute").agg(F.countDistinct("memory_id").alias("df"))
    weight = F.log((F.col("n") + 1) / (F.col("df") + 1)) if mode == "idf" else F.lit(1.0)
    return df.join(banks, "bank").select("bank", "attribute", "df", weight.alias("weight"))


def sided_items(attrs: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Memories as rows of items (see ``side_pairs``): (by.., id, items), an attribute with its weight and the side or sides it is on."""
    kind = F.bit_or(F.when(F.col("side") == "text", 1).when(F.col("side") == "visual", 2))
    x = attrs.where("side in ('text', 'visual') and memory_id is not null").groupBy(*by, "attribute", "memory_id").agg(kind.alias("kind"))
    x = x.join(weights.select(*by, "attribute", "weight"), [*by, "attribute"])
    return x.groupBy(*by, F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("attribute").alias("item"), F.col("weight").alias("value"), "kind"))).alias("items"))


def candidate_edges(attrs: DataFrame, weights: DataFrame, first: bool = True, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs sharing a text attribute, or one's text and the other's visual attribute: (bank, source < target, weight, n_text, n_cross, first).

    The weight sums the attributes shared in text and, again, those shared across. ``first`` orders equal
    weights: pairs with shared text first, then the least shared attribute, then the pair; it may be left out. ``weight`` is a rule for the weight (rounding), worked out before pairs are listed.
    """
    return side_pairs(sided_items(attrs, weights, ["bank"]), ["bank"], first, weight=weight)


def capped_graph(attrs: DataFrame, weights: DataFrame, cap: int = 4) -> DataFrame:
    """``cap_degree`` of the candidate edges, by weight to 9 digits and ``first``, without the edges that it does not take: (bank, source, target, weight)."""
    return greedy_graphs(sided_items(attrs, weights, ["bank"]), ["bank"], cap)


def statistics_steps(attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How the statistics of a bank's prefixes grow: (bank, ord, n) memories, (bank, attribute, ord, df) memories with the attribute, a row wherever they change."""
    grow = lambda rows, by: rows.groupBy(*by, "ord").agg(F.count("*").alias("more")).select(*by, "ord", F.sum("more").over(Window.partitionBy(*by).orderBy("ord")).alias("total"))
    first = lambda by: attrs.groupBy(*by, "memory_id").agg(F.min("ord").alias("ord"))
    return grow(first(["bank"]), ["bank"]).withColumnRenamed("total", "n"), grow(first(["bank", "attribute"]), ["bank", "attribute"]).withColumnRenamed("total", "df")


def _as_of(steps: DataFrame, asks: DataFrame, by: list[str], value: str) -> DataFrame:
    """``asks`` (by.., checkpoint, at) with the last ``value`` of the steps (by.., ord, value) up to ``at``: one pass over both in order, so no step meets every checkpoint."""
    told = steps.select(*by, F.col("ord").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast(asks.schema["checkpoint"].dataType).alias("checkpoint"), value)
    asked = asks.select(*by, "at", F.lit(1).alias("ask"), "checkpoint", F.lit(None).cast("long").alias(value))
    w = Window.partitionBy(*by).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return told.unionByName(asked).withColumn(value, F.last(value, True).over(w)).where("ask = 1").drop("ask")


def prefix_weights(attrs: DataFrame, checkpoints: DataFrame, mode: str = "idf") -> DataFrame:
    """G1 at each checkpoint (bank, checkpoint, at), of the memories with ``ord`` up to ``at`` alone: (bank, checkpoint, at, attribute, df, weight).

    Document frequencies are running sums over a bank's order, read as of each checkpoint; memories are not copied.
    """
    n_steps, df_steps = statistics_steps(attrs)
    asked = df_steps.groupBy("bank", "attribute").agg(F.min("ord").alias("born")).join(checkpoints, "bank").where("born <= at")
    df = _as_of(df_steps, asked, ["bank", "attribute"], "df")
    n = _as_of(n_steps, checkpoints, ["bank"], "n").select("bank", "checkpoint", "n")
    weight = F.log((F.col("n") + 1) / (F.col("df") + 1)) if mode == "idf" else F.lit(1.0)
    return df.join(n, ["bank", "checkpoint"]).select("bank", "checkpoint", "at", "attribute", "df", weight.alias("weight"))


def _prefix_items(attrs: DataFrame, checkpoints: DataFrame, mode: str) -> DataFrame:
    weights = prefix_weights(attrs, checkpoints, mode)
    seen = attrs.join(checkpoints.select("bank", "checkpoint", "at"), "bank").where("ord <= at")
    return sided_items(seen, weights, ["bank", "checkpoint"])


def prefix_edges(attrs: DataFrame, checkpoints: DataFrame, mode: str = "idf", first: bool = True, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """G2 at each checkpoint: the candidate edges among the memories up to then, weighted by that prefix: (bank, checkpoint, source, target, weight, n_text, n_cross, first).

    A checkpoint's memories are given what they have by then, and meet in blocks of their own. What is not read of a later
    session can't leak into an earlier graph.
    """
    return side_pairs(_prefix_items(attrs, checkpoints, mode), ["bank", "checkpoint"], first, weight=weight)


def prefix_graphs(attrs: DataFrame, checkpoints: DataFrame, cap: int = 4, mode: str = "idf", known: DataFrame | None = None) -> DataFrame:
    """G3 at each checkpoint: (bank, checkpoint, source, target, weight).

    Checkpoints in ``known`` (bank, checkpoint), whose graphs are stored already under the same signature (see ``prefix_signatures``), are left out.
    """
    if known is not None:
        checkpoints = checkpoints.join(known.select("bank", "checkpoint"), ["bank", "checkpoint"], "left_anti")
    return greedy_graphs(_prefix_items(attrs, checkpoints, mode), ["bank", "checkpoint"], cap)


def prefix_signatures(attrs: DataFrame, checkpoints: DataFrame, options: str = "") -> DataFrame:
    """(bank, checkpoint, signature) of what a checkpoint's graph is made of: its memories' attributes and the options.

    A session's signature digests its rows; a prefix's is the running sum of its sessions' (modulo 2**64 by two hashes), so a checkpoint costs no pass of its own.
    """
    row = F.xxhash64("memory_id", "attribute", "side", "ord")
    other = F.xxhash64("ord", "side", "attribute", "memory_id", F.lit(11))
    per = attrs.select("bank", "memory_id", "attribute", "side", "ord").distinct().groupBy("bank", "ord").agg(F.sum(row.cast("decimal(20,0)")).alias("a"), F.sum(other.cast("decimal(20,0)")).alias("b"), F.count("*").alias("n"))
    run = Window.partitionBy("bank").orderBy("ord")
    steps = per.select("bank", "ord", F.sha2(F.concat_ws("|", F.sum("a").over(run).cast("string"), F.sum("b").over(run).cast("string"), F.sum("n").over(run).cast("string"), F.lit(options)), 256).alias("signature"))
    asked = checkpoints.select("bank", "checkpoint", "at")
    told = steps.select("bank", F.col("ord").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast(asked.schema["checkpoint"].dataType).alias("checkpoint"), "signature")
    w = Window.partitionBy("bank").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asked.select("bank", "at", F.lit(1).alias("ask"), "checkpoint", F.lit(None).cast("string").alias("signature")))
    return both.withColumn("signature", F.last("signature", True).over(w)).where("ask = 1").select("bank", "checkpoint", "signature")


def greedy_cap(edges: pd.DataFrame, cap: int, degree: dict) -> list[bool]:
    """The sequential rule: take an edge, in order, if both ends have room."""
    out = []
    for s, t in zip(edges["source"], edges["target"], strict=True):
        ok = degree.get(s, 0) < cap and degree.get(t, 0) < cap
        if ok:
            degree[s], degree[t] = degree.get(s, 0) + 1, degree.get(t, 0) + 1
        out.append(ok)
    return out


def cap_degree(edges: DataFrame, order: list[Column], cap: int = 4, rounds: int = 12) -> DataFrame:
    """Degree-capped greedy selection in a total order, in parallel.

    In each round an edge that is within the room left at both its ends is taken (greedy would take it,
    as fewer than the room of undecided edges come before it at either end), and edges at a full node go.
    After ``rounds`` what is undecided is finished per bank by the sequential rule, knowing the degrees.
    """
    left = checkpoint(edges.withColumn("order", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), "source", "target")))
    taken = None
    for _ in range(rounds):
        ends = left.select("bank", "order", F.explode(F.array("source", "target")).alias("node"))
        used = None if taken is None else taken.select("bank", F.explode(F.array("source", "target")).alias("node")).groupBy("bank", "node").agg(F.count("*").alias("used"))
        place = ends.withColumn("place", F.row_number().over(Window.partitionBy("bank", "node").orderBy("order")))
        place = place.withColumn("used", F.lit(0)) if used is None else place.join(used, ["bank", "node"], "left").fillna(0, ["used"])
        state = place.groupBy("bank", "order").agg(F.min((F.col("place") + F.col("used") <= cap).cast("int")).alias("take"), F.max((F.col("used") >= cap).cast("int")).alias("full"))
        decided = checkpoint(left.join(state, ["bank", "order"]))
        now = decided.where("take = 1 and full = 0").drop("take", "full")
        taken = now if taken is None else checkpoint(taken.unionByName(now))
        left = decided.where("take = 0 and full = 0").drop("take", "full")
        if left.isEmpty():
            return taken.drop("order")
    used = taken.select("bank", F.explode(F.array("source", "target")).alias("node")).groupBy("bank", "node").agg(F.count("*").alias("used"))

    def finish(key: tuple, rows: pd.DataFrame, degrees: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return rows[np.array(greedy_cap(rows, cap, dict(zip(degrees["node"], degrees["used"], strict=True))), dtype=bool)][["bank", "source", "target"]]

    slim = left.select(*PAIR, F.row_number().over(Window.partitionBy("bank").orderBy("order")).alias("place"))
    keep = slim.groupBy("bank").cogroup(used.groupBy("bank")).applyInPandas(finish, edges.select(*PAIR).schema)
    return taken.unionByName(left.join(keep, PAIR, "left_semi")).drop("order")


def temporal_chain(memories: DataFrame) -> DataFrame:
    """Previous and next ACTIVE memory by (date, session number, round, id) within a bank."""
    w = Window.partitionBy("bank").orderBy("date", "session", "round", "memory_id")
    return memories.where("status = 'ACTIVE'").select("bank", "memory_id", F.lag("memory_id").over(w).alias("prev"), F.lead("memory_id").over(w).alias("next"))


def rare_pairs(buckets: DataFrame, totals: DataFrame, df_max: float = 0.3, df_stop: float = 0.5, min_shared: int = 2, df: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Pairs sharing buckets of share at most ``df_stop``, if the rarest is at most ``df_max`` or ``min_shared`` are shared: buckets (bank, memory_id, bucket), totals (bank, n). ``df`` is a rule for the share given."""
    share = buckets.distinct().groupBy("bank", "bucket").agg(F.count("*").alias("k")).join(totals, "bank").select("bank", "bucket", (F.col("k") / F.col("n")).alias("df"), "k").where((F.col("df") <= df_stop) & (F.col("k") > 1))
    x = buckets.distinct().where("memory_id is not null").join(share, ["bank", "bucket"])
    rows = x.groupBy("bank", F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("bucket").alias("item"), F.col("df").alias("value"), F.lit(1).alias("kind")))).alias("items"))

    def find(own: tuple, theirs: tuple) -> tuple[np.ndarray, np.ndarray, list]:
        least, n = np.full((theirs[0], own[0]), np.inf), np.zeros((theirs[0], own[0]), np.int32)
        for item in sorted(own[1].keys() & theirs[1].keys(), key=lambda x: -own[1][x][0]):  # the rarest last, which stays
            at = np.ix_(theirs[1][item][1], own[1][item][1])
            least[at] = own[1][item][0]
            n[at] += 1
        j, i = np.nonzero((n > 0) & ((least <= df_max) | (n >= min_shared)))
        return j, i, [least[j, i], n[j, i].astype(np.int64)]

    pairs = pairs_in_blocks(rows, ["bank"], by_side, find, "df double, shared long", [df(F.col("df")).alias("df"), F.col("shared")])
    return pairs.withColumnsRenamed({"a": "source", "b": "target"})


def relation_candidates(memories: DataFrame, extra: DataFrame, window: int = 1) -> DataFrame:
    """Pairs of sessions at most ``window`` apart, and given pairs, earlier first: memories (bank, memory_id, session, ord)."""
    slot = F.floor(F.col("session") / (window + 1))
    a = memories.withColumn("slot", slot).alias("a")
    b = memories.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("b")
    near = (F.col("a.bank") == F.col("b.bank")) & (F.col("a.slot") == F.col("b.slot")) & (F.abs(F.col("a.session") - F.col("b.session")) <= window) & (F.col("a.ord") < F.col("b.ord"))
    return a.join(b, near).select("a.bank", F.col("a.memory_id").alias("source"), F.col("b.memory_id").alias("target")).unionByName(extra.select(*PAIR)).distinct()


def conflicts(slots: DataFrame) -> DataFrame:
    """Two memories that give one entity's attribute different values (case apart), earlier first: slots (entity, attribute, memory_id, ord, value)."""
    a, b = slots.alias("a"), slots.alias("b")
    on = (F.col("a.entity") == F.col("b.entity")) & (F.col("a.attribute") == F.col("b.attribute")) & (F.col("a.ord") < F.col("b.ord")) & (F.lower("a.value") != F.lower("b.value"))
    return a.join(b, on).select("a.entity", "a.attribute", F.col("a.memory_id").alias("earlier"), F.col("b.memory_id").alias("later"), F.col("a.value").alias("earlier_value"), F.col("b.value").alias("later_value"))


def accept_relations(df: DataFrame, min_conf: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """One row per (source, target, type) at or above the confidence, the surest; and counts of all outcomes."""
    good = df.where(~F.col("type").isin("NONE", "PARSE_ERROR") & (F.col("confidence") >= min_conf))
    return good.groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence")), df.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= min_conf).alias("n_sure"))


def threshold_clusters(vectors: DataFrame, t: float, by: str) -> DataFrame:
    """Components of the graph that joins vectors of cosine at least ``t``; lone vectors are clusters of their own."""
    labels = connected_components(similarity_join(vectors, t, by))
    return vectors.select("memory_id").join(labels.withColumnRenamed("node", "memory_id"), "memory_id", "left").select("memory_id", F.coalesce("component", "memory_id").alias("cluster"))


def merge_entities(nodes: DataFrame, edges: DataFrame, alias_map: DataFrame, strategy: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with aliases (alias, name) replaced: self-loops go, equal edges fold. Fields merge by keep_first, keep_last, concatenate, join_unique or max, in id order."""

    def field(name: str, how: str, order: str) -> Column:
        if how == "max":
            return F.max(name).alias(name)
        every = ordered_collect(F.col(name).cast("string"), order)
        return {"keep_first": every[0], "keep_last": F.element_at(every, -1), "concatenate": F.array_join(every, "\n"), "join_unique": F.array_join(F.array_sort(F.array_distinct(every)), "|")}[how].alias(name)

    m = alias_map.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    renamed = lambda df, col: df.join(m, df[col] == m["_alias"], "left").withColumn(col, F.coalesce("_name", col)).drop("_alias", "_name")
    merged = renamed(nodes, "name").groupBy("name").agg(*(field(k, v, "node_id") for k, v in strategy.items()))
    e = renamed(renamed(edges, "source"), "target").where("source <> target")
    return merged, e.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def upsert_entities(base: DataFrame, new: DataFrame) -> DataFrame:
    """(name, type): sources and aliases united, first attribute value in seq order, mentions summed, earliest first_seen."""
    every = base.unionByName(new)
    return every.groupBy("name", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.min_by("attribute", "seq").alias("attribute"), F.sum("mentions").alias("mentions"), F.min("first_seen").alias("first_seen"))


def upsert_relations(base: DataFrame, new: DataFrame) -> DataFrame:
    """(s, p, o): mentions counted, largest confidence, sources united."""
    return base.unionByName(new).groupBy("s", "p", "o").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))


def merge_relations(rows: DataFrame) -> DataFrame:
    """One row per (s, p, o) of rows (s, p, o, mentions, confidence, sources array): mentions summed, largest confidence, sources united. May be applied to its own results."""
    return rows.groupBy("s", "p", "o").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, predicates: list[str] | None = None) -> DataFrame:
    """Nodes within ``k`` hops of the seeds with their least hop."""
    e = edges if predicates is None else edges.where(F.col("predicate").isin(predicates))
    e = e.select("source", "target").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = frontier = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, k + 1):
        step = frontier.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = checkpoint(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    i = ids.select("node").distinct()
    return edges.join(i, F.col("source") == F.col("node"), "left_semi").join(i, F.col("target") == F.col("node"), "left_semi")


def search_entities(df: DataFrame, text: str, kind: str | None = None, k: int = 10) -> DataFrame:
    """Entities whose name or an alias contains the text, most mentioned first."""
    t = text.lower()
    hit = F.lower("name").contains(t) | F.exists("aliases", lambda a: F.lower(a).contains(t))
    rows = df.where(hit if kind is None else hit & (F.col("type") == kind))
    return rows.orderBy(F.desc("mentions"), "name").limit(k)


def apply_weight_deltas(edges: DataFrame, deltas: DataFrame, factor: int = 2) -> DataFrame:
    """Each delta (node, seq, delta) changes every edge at its node by ``factor * delta``; an edge that falls to 0 or below at any step is gone."""
    ends = edges.select("source", "target", "weight", F.explode(F.array("source", "target")).alias("node"))
    steps = ends.join(deltas, "node").groupBy("source", "target", "weight", "seq").agg(F.sum(F.col("delta") * factor).alias("d"))
    run = Window.partitionBy("source", "target").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ended = steps.withColumn("now", F.col("weight") + F.sum("d").over(run)).groupBy("source", "target").agg(F.min("now").alias("low"), F.max_by("now", "seq").alias("last"))
    return edges.join(ended, ["source", "target"], "left").where("low is null or low > 0").select("source", "target", F.coalesce("last", "weight").alias("weight"))


def drop_redundant(edges: DataFrame, vectors: DataFrame, t: float = 0.9, rounds: int = 10) -> DataFrame:
    """Of two neighbours of one entity that are more similar than ``t``, the one with the lower weight (on ties the later) goes; repeated until nothing changes."""
    near = edges.select("source", "target").distinct().join(vectors.where("vector is not null and not exists(vector, x -> x is null)").select(F.col("memory_id").alias("target"), "vector"), "target")
    # cosines are found in blocks, with room for how the product rounds, and judged one by one
    found = similarity_join(near.select("source", F.col("target").alias("memory_id"), "vector"), t - 1e-6, "source", keep_by=True)
    v = vectors.select("memory_id", "vector")
    sure = found.where(F.abs(F.col("score") - t) > 1e-6).where(F.col("score") > t).select("source", "a", "b")
    open_ = found.where(F.abs(F.col("score") - t) <= 1e-6).join(v.select(F.col("memory_id").alias("a"), F.col("vector").alias("va")), "a").join(v.select(F.col("memory_id").alias("b"), F.col("vector").alias("vb")), "b")
    pairs = stage(sure.unionByName(open_.where(cosine(F.col("va"), F.col("vb")) > t).select("source", "a", "b")), "redundant")
    now = checkpoint(edges.join(vectors.select(F.col("memory_id").alias("target")), "target"))
    for _ in range(rounds):
        a, b = (now.select("source", F.col("target").alias(x), F.col("weight").alias(f"w{x}")) for x in "ab")
        met = pairs.join(a, ["source", "a"]).join(b, ["source", "b"])
        worse = met.select("source", F.when((F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") < F.col("b"))), F.col("b")).when(F.col("wb") > F.col("wa"), F.col("a")).alias("target")).where("target is not null").distinct()
        kept = checkpoint(now.join(worse, ["source", "target"], "left_anti"))
        if kept.count() == now.count():
            break
        now = kept
    return now


def graph_as_of(nodes: DataFrame, edges: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """Nodes up to clip ``t`` and the edges among them of that time."""
    n = nodes.where(F.col("clip") <= t)
    return n, subgraph(edges.where(F.col("clip") <= t), n)


def link_similar(vectors: DataFrame, k: int, t: float = 0.7) -> DataFrame:
    """For each vector (bank, memory_id, vector) its ``k`` most similar earlier ones, then those of cosine at least ``t``.

    Vectors are dealt to parts by a hash of the id; each pair of parts of a bank gives the ``k`` best earlier ones
    that it has for a source, and the ``k`` best of those are ranked. A task holds 2 * LINK_ROWS vectors about,
    whatever the bank. A matrix product finds the candidates, and sums by row score them, so equal vectors tie.
    In the ranking a bank of any type goes by 128 bits of hash.
    """
    parts = max(1, -(-vectors.count() // LINK_ROWS))
    names = [F.xxhash64("bank").alias("x"), F.xxhash64(F.lit(1), "bank").alias("y")]
    side = vectors.select("bank", *names, F.col("memory_id").alias("id"), "vector").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = side.withColumnRenamed("part", "p").withColumn("q", every)
    right = side.select(*(F.col(x).alias(x) for x in side.columns)).withColumnRenamed("part", "q").withColumn("p", every)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["x", "y", "source", "target", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: np.empty(0, np.float64 if n == "score" else np.int64) for n in names})
        unit = lambda x: (lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True)))(np.stack(x["vector"].to_list()).astype(np.float64))
        b = b.sort_values("id")
        mine, ids, u, v = a["id"].to_numpy(), b["id"].to_numpy(), unit(a), unit(b)
        earlier, sources, targets, scores = np.searchsorted(ids, mine), [], [np.empty(0, np.int64)], [np.empty(0)]
        for start in range(0, len(u), 256):
            for i, rough in enumerate(u[start : start + 256] @ v.T, start):
                rough = rough[: earlier[i]]
                least = t if len(rough) <= k else max(t, np.partition(rough, len(rough) - k)[-k])
                near = np.flatnonzero(rough >= least - 1e-9)
                s = (v[near] * u[i]).sum(axis=1)
                top = np.lexsort((ids[near], -s))[:k]
                top = top[s[top] >= t]
                sources.append(np.full(len(top), mine[i]))
                targets.append(ids[near[top]])
                scores.append(s[top])
        bank = {n: np.full(sum(map(len, sources)), a[n].iloc[0]) for n in names[:2]}
        return pd.DataFrame({**bank, "source": np.concatenate(sources), "target": np.concatenate(targets), "score": np.concatenate(scores)})

    found = left.groupBy("bank", "p", "q").cogroup(right.groupBy("bank", "p", "q")).applyInPandas(best, "x long, y long, source long, target long, score double")
    return rank_top(found, ["x", "y", "source"], k, F.desc("score"), F.asc("target")).select("source", "target", "score")


def concept_match(queries: DataFrame, nodes: DataFrame, min_overlap: float = 0.0, symmetric: bool = False, overlap: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Share of a query's concepts that a node has (or of the larger set): queries (query_id, concept), nodes (node, concept), both distinct. ``overlap`` is a rule for the share given."""
    items = lambda df, ident: df.where("concept is not null").groupBy(F.lit(0).alias("every"), F.col(ident).alias("id")).agg(F.sort_array(F.collect_list("concept")).alias("items"))
    q, n = items(queries.where("query_id is not null"), "query_id"), items(nodes.where("node is not null"), "node")

    def find(own: tuple, theirs: tuple) -> tuple[np.ndarray, np.ndarray, list]:
        k = counts(own, theirs)
        share = k / (np.maximum(theirs[1][:, None], own[1][None, :]) if symmetric else theirs[1][:, None])
        j, i = np.nonzero((k > 0) & (share > min_overlap))
        return j, i, [share[j, i]]

    found = pairs_in_blocks(n, ["every"], by_item, find, "overlap double", [overlap(F.col("overlap")).alias("overlap")], visitors=q)
    return found.drop("every").withColumnsRenamed({"a": "query_id", "b": "node"})


def similarity_links(vectors: DataFrame, a: float, b: float, k: int, low: float, by: str) -> DataFrame:
    """Per memory its ``k`` best others of a * cosine (above 0) + b * text ratio, at least ``low``; the ratio is 1 - edit distance / longer length.

    As no ratio is above 1, only pairs with a cosine of (low - b) / a at least can reach ``low``. Of these, a pair's cosine leaves it so many edits; pairs whose
    lengths differ by more are dropped, and the others' texts are compared in a band of that width.
    """
    pairs = similarity_join(vectors.select("memory_id", "vector", by), max(1e-9, (low - b) / a - 1e-9), by)
    two = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    text = vectors.select("memory_id", "text")
    x = two.join(text.select(F.col("memory_id").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("memory_id").alias("b"), F.col("text").alias("tb")), "b")
    longer = F.greatest(F.length("ta"), F.length("tb"), F.lit(1))
    edits = F.floor(longer * (1 - (low - a * F.col("score")) / b) + 1e-6).cast("int") if b > 0 else longer
    x = x.withColumn("edits", F.least(edits, longer)).where((F.col("edits") >= 0) & (F.abs(F.length("ta") - F.length("tb")) <= F.col("edits")))
    x = x.withColumn("distance", F.call_function("levenshtein", F.col("ta"), F.col("tb"), F.col("edits"))).where("distance >= 0")
    x = x.select(F.col("a").alias("source"), F.col("b").alias("target"), (a * F.col("score") + b * (1 - F.col("distance") / longer)).alias("weight")).where(F.col("weight") >= low)
    return rank_top(x, ["source"], k, F.desc("weight"), F.asc("target"))


def succession_edges(df: DataFrame, tau: float = 3600.0, clamp: tuple[float, float] | None = None) -> DataFrame:
    """An edge to each memory from the one before, weight exp(-seconds / tau), or exp(-1) where a time is missing: df (bank, memory_id, ord, ts)."""
    w = Window.partitionBy("bank").orderBy("ord")
    x = df.select("bank", F.lag("memory_id").over(w).alias("source"), F.col("memory_id").alias("target"), (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))).alias("gap")).where("source is not null")
    weight = F.exp(-F.coalesce(F.col("gap") / tau, F.lit(1.0)))
    return x.select("bank", "source", "target", (weight if clamp is None else F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), weight))).alias("weight"))


def concept_edges(concepts: DataFrame, m: int, weight: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Edges to earlier nodes with at least ``m`` common concepts, weight shared / larger set: concepts (bank, node, concept), distinct. ``weight`` is a rule for it."""
    rows = concepts.where("node is not null and concept is not null").groupBy("bank", F.col("node").alias("id")).agg(F.sort_array(F.collect_list("concept")).alias("items"))

    def find(own: tuple, theirs: tuple) -> tuple[np.ndarray, np.ndarray, list]:
        k = counts(own, theirs)
        j, i = np.nonzero(k >= max(m, 1))
        return j, i, [k[j, i] / np.maximum(own[1][i], theirs[1][j])]

    pairs = pairs_in_blocks(rows, ["bank"], by_item, find, "weight double", [weight(F.col("weight")).alias("weight")])
    return pairs.select("bank", F.col("b").alias("source"), F.col("a").alias("target"), "weight")
