"""Pairs that share items: found in blocks, never a row of a shuffle."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoloom.operators import graph as G
from mnemoloom.operators import pairs as P
from mnemoloom.plans import QUERIES


def memories(seed=3, n=60):
    rng = np.random.default_rng(seed)
    rows = [(bank, int(i), f"a{a}", side) for bank in (1, 2) for i in range(n) for a, side in zip(rng.integers(0, 9, 4), rng.choice(["text", "visual"], 4), strict=True)]
    return sorted(set(rows))


@pytest.mark.parametrize("block", [7, 16, 4096])
def test_candidate_edges_by_blocks(spark, block):
    rows = memories()
    attrs = spark.createDataFrame(rows, "bank long, memory_id long, attribute string, side string")
    weight = {f"a{i}": 0.1 + 0.01 * i for i in range(9)}
    weights = spark.createDataFrame([(b, a, w) for b in (1, 2) for a, w in weight.items()], "bank long, attribute string, weight double")
    got = {tuple(r)[:3]: (round(r.weight, 9), r.n_text, r.n_cross, tuple(r["first"])) for r in P.side_pairs(G.sided_items(attrs, weights, ["bank"]), ["bank"], block=block).collect()}
    want = {}
    for bank in (1, 2):
        side = lambda i, s: {a for b, m, a, x in rows if b == bank and m == i and x == s}  # noqa: B023, E731
        for i, j in itertools.combinations(range(60), 2):
            text = side(i, "text") & side(j, "text")
            cross = (side(i, "text") & side(j, "visual")) | (side(i, "visual") & side(j, "text"))
            if text or cross:
                want[bank, i, j] = (round(sum(weight[a] for a in [*text, *cross]), 9), len(text), len(cross), min([*((0, a) for a in text), *((1, a) for a in cross)]))
    assert got == want


@pytest.mark.parametrize("band", [20, 4_000_000])
def test_greedy_by_classes_equals_the_rule(spark, band):
    attrs = spark.createDataFrame(memories(5), "bank long, memory_id long, attribute string, side string").where("bank = 1")
    weights = G.attribute_weights(attrs, attrs.groupBy("bank").agg(F.countDistinct("memory_id").alias("n")))
    edges = G.candidate_edges(attrs, weights).withColumn("weight", F.round("weight", 9))
    want = {tuple(r) for r in G.cap_degree(edges, [-F.col("weight"), F.col("first")], 3).select("source", "target").collect()}
    rows = G.sided_items(attrs, weights, ["bank"]).collect()
    s, t, _ = P.greedy_by_classes(np.array([r.id for r in rows]), [[x.asDict() for x in r["items"]] for r in rows], 3, band)
    assert set(zip(s, t, strict=True)) == want


@pytest.mark.parametrize("name", ["g2_candidate_edges", "g5_rare_pairs", "g21_concept_match", "g24_concept_edges", "v29_prefix_edges"])
def test_pairs_are_not_shuffled(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("MapInArrow") < plan.find("Exchange")


@pytest.mark.parametrize("name", ["g3_cap_degree", "v29_prefix_graphs"])
def test_capped_graphs_make_no_pairs(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("FlatMapGroupsInArrow") < plan.find("Exchange")


def test_redundant_neighbours_are_found_in_blocks(spark):
    edges = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 9), (2, 2, 1), (2, 4, 3), (2, 5, 2)], "source long, target long, weight long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [3.0, 4.0]), (5, None)], "memory_id long, vector array<double>")
    with_joins = []
    plain, G.similarity_join = G.similarity_join, lambda *a, **k: with_joins.append(k) or plain(*a, **k)
    try:
        got = G.drop_redundant(edges, vectors, 0.6)  # the cosine of 2 and 4 is 0.6, which is not above
    finally:
        G.similarity_join = plain
    assert sorted(tuple(r) for r in got.select("source", "target").collect()) == [(1, 1), (1, 3), (2, 2), (2, 4), (2, 5)] and with_joins


@pytest.mark.parametrize(("name", "value"), [("g2_candidate_edges", "weight"), ("v29_prefix_edges", "weight"), ("g5_rare_pairs", "df"), ("g24_concept_edges", "weight"), ("g21_concept_match", "overlap")])
def test_values_are_rounded_once_a_list(spark, sf_dir, name, value):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate explode(ys") < plan.find(f"round({value}") < plan.find("MapInArrow")


def test_equal_sets_go_through_the_shuffle_once(spark):
    sets = [["a", "b"], ["a"], ["b", "c", "d"]]
    rows = spark.createDataFrame([(1, i, sets[i % 3]) for i in range(3000)], "bank long, id long, items array<string>")
    assert P._classes(rows, ["bank"], 4096).count() == 3 * -(-1000 // P.PIECE)
    index = lambda items: (seen.add(len(items)), P.by_item(items))[1]
    seen = spark.sparkContext.accumulator(0)
    found = P.pairs_in_blocks(rows, ["bank"], index, lambda own, theirs: (*np.nonzero(k := P.counts(own, theirs)), [k[k > 0].astype(np.int64)]), "k long", [F.col("k")])
    assert {r.k: r["count"] for r in found.groupBy("k").count().collect()} == {1: 1000 * 1000 * 2 + 999 * 500, 2: 999 * 500, 3: 999 * 500}
    assert seen.value < 600  # item lists made ready: 12 of the block, and a few for each tile of 174 ids; not 6,000


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("name", [str, int])
def test_concepts_by_blocks(spark, monkeypatch, block, name):
    monkeypatch.setattr(G, "pairs_in_blocks", lambda *a, **k: P.pairs_in_blocks(*a, **{**k, "block": block}))
    rng = np.random.default_rng(9)
    held = {name(i + 100): {f"c{x}" for x in rng.integers(0, 8 if i % 2 else 2, 6)} for i in range(40)}
    kind = "string" if name is str else "long"
    c = spark.createDataFrame([(1, i, x) for i, s in held.items() for x in sorted(s)], f"bank long, node {kind}, concept string")
    asked = c.where("node % 4 = 0").select(F.col("node").alias("query_id"), "concept")
    got = {tuple(r) for r in G.concept_match(asked, c.select("node", "concept"), 0.4, symmetric=True, overlap=lambda x: F.round(x, 6)).collect()}
    share = lambda a, b: len(held[a] & held[b]) / max(len(held[a]), len(held[b]))
    assert got == {(a, b, round(share(a, b), 6)) for a in held if int(a) % 4 == 0 for b in held if share(a, b) > 0.4}
    edges = [tuple(r) for r in G.concept_edges(c, 2).collect()]
    assert sorted(edges) == sorted((1, max(a, b), min(a, b), share(a, b)) for a, b in itertools.combinations(held, 2) if len(held[a] & held[b]) >= 2)


def test_counts_by_product_and_item_by_item():
    rng = np.random.default_rng(4)
    for most, n in ((70, 40), (4000, 3)):  # common items, rare ones
        a, b = ([[f"i{x}" for x in set(rng.integers(0, most, n).tolist())] for _ in range(30)] for _ in range(2))
        got = P.counts(P.by_item(a), P.by_item(b))
        assert got.tolist() == [[len({*x} & {*y}) for x in a] for y in b]
