"""Graphs of a bank's prefixes against a rebuild from the visible memories alone; signatures; gold points."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from mnemoloom.operators import graph as G
from mnemoloom.operators import lifecycle as L
from mnemoloom.operators import splits as D


def some_attrs(spark):
    rng = random.Random(5)
    rows = []
    for bank in ("x", "y"):
        for m in range(30):
            for a in rng.sample("abcdefg", rng.choice([1, 2, 3])):
                rows.append((bank, m, a, rng.choice(["text", "text", "visual"]), m // 4))
    return spark.createDataFrame(rows, "bank string, memory_id long, attribute string, side string, ord long")


def test_prefix_graphs_equal_a_rebuild(spark):
    attrs = some_attrs(spark)
    points = [("x", 1, 0), ("x", 2, 3), ("x", 3, 99), ("y", 1, 5), ("y", 2, -1)]
    checkpoints = spark.createDataFrame(points, "bank string, checkpoint long, at long")
    weights = {(r.bank, r.checkpoint, r.attribute): (r.df, round(r.weight, 9)) for r in G.prefix_weights(attrs, checkpoints).collect()}
    edges = {(r.bank, r.checkpoint, r.source, r.target): (round(r.weight, 9), r.n_text, r.n_cross, tuple(r["first"])) for r in G.prefix_edges(attrs, checkpoints).collect()}
    graphs = {(r.bank, r.checkpoint, r.source, r.target) for r in G.prefix_graphs(attrs, checkpoints, cap=3).collect()}
    want_weights, want_edges, want_graphs = {}, {}, set()
    for bank, checkpoint, at in points:
        seen = attrs.where((F.col("bank") == bank) & (F.col("ord") <= at)).drop("ord")
        w = G.attribute_weights(seen, seen.groupBy("bank").agg(F.countDistinct("memory_id").alias("n")))
        e = G.candidate_edges(seen, w)
        want_weights |= {(bank, checkpoint, r.attribute): (r.df, round(r.weight, 9)) for r in w.collect()}
        want_edges |= {(bank, checkpoint, r.source, r.target): (round(r.weight, 9), r.n_text, r.n_cross, tuple(r["first"])) for r in e.collect()}
        want_graphs |= {(bank, checkpoint, r.source, r.target) for r in G.cap_degree(e.withColumn("weight", F.round("weight", 9)), [-F.col("weight"), F.col("first")], 3).collect()}
    assert weights == want_weights and edges == want_edges and graphs == want_graphs and len(graphs) > 40
    known = spark.createDataFrame([("x", 1), ("x", 3)], "bank string, checkpoint long")
    assert {(r.bank, r.checkpoint, r.source, r.target) for r in G.prefix_graphs(attrs, checkpoints, cap=3, known=known).collect()} == {g for g in graphs if g[:2] not in (("x", 1), ("x", 3))}


def test_prefix_signatures_follow_what_is_visible(spark):
    attrs = some_attrs(spark)
    checkpoints = spark.createDataFrame([("x", 1, 2), ("x", 2, 4), ("x", 3, 50)], "bank string, checkpoint long, at long")
    take = lambda df, o="": {r.checkpoint: r.signature for r in G.prefix_signatures(df, checkpoints, o).collect()}
    base = take(attrs)
    assert len(set(base.values())) == 3 and take(attrs.repartition(7).orderBy(F.desc("memory_id"))) == base
    later = take(attrs.unionByName(spark.createDataFrame([("x", 500, "a", "text", 4)], attrs.schema)))
    assert later[1] == base[1] and later[2] != base[2] and later[3] != base[3]
    assert all(take(attrs, "cap=5")[k] != base[k] for k in base)


def test_signature_streams_sorted_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), i, rng.choice(["a", None, 'q"'])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, t string")
    want = {}
    for g in (None, 1, 2):
        lines = sorted(json.dumps({k: v for k, v in (("i", i), ("t", t)) if v is not None}, separators=(",", ":")).encode() for x, i, t in rows if x == g)
        want[g] = (hashlib.sha256(b"\n".join(lines)).hexdigest(), len(lines))
    assert {r.g: (r.signature, r.n) for r in D.signature(df.repartition(5), ["g"], ["i", "t"]).collect()} == want
    assert D.signature(df.limit(0), ["g"], ["i"]).collect() == []


def test_gold_points_as_of_a_session(spark):
    points = spark.createDataFrame([("b", 1, 10, "new"), ("b", 1, 11, "interference"), ("b", 2, 12, "update"), ("b", 3, 13, "new"), ("c", 1, 14, "new")], "bank string, session long, memory_id long, kind string")
    sessions = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4), ("c", 1, 1)], "bank string, session long, ord long")
    got = L.gold_at(L.gold_points(points, sessions), sessions)
    assert {(r.bank, r.session): r.ids for r in got.groupBy("bank", "session").agg(F.sort_array(F.collect_list("memory_id")).alias("ids")).collect()} == {("b", 1): [10], ("b", 2): [10, 12], ("b", 3): [10, 12, 13], ("b", 4): [10, 12, 13], ("c", 1): [14]}
    counts = {(r.bank, r.session): (r.n_new, r.n_update, r.n_interference, r.n_cumulative) for r in L.gold_states(points, sessions).collect()}
    assert counts == {("b", 1): (1, 0, 1, 1), ("b", 2): (0, 1, 0, 2), ("b", 3): (1, 0, 0, 3), ("b", 4): (0, 0, 0, 3), ("c", 1): (1, 0, 0, 1)}
