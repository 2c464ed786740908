"""The stored approximate index against exact search."""

import numpy as np
import pytest

from mnemoloom.operators import inverted_file as I
from mnemoloom.operators import retrieval as R


def frame(spark, rows, ident="memory_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{ident} long, vector array<double>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.memory_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 10))
    return [(i, centres[i % 40] + 0.2 * rng.normal(size=10)) for i in range(2000)]


def test_exact_with_all_cells_and_rows(spark, tmp_path, monkeypatch):
    """Every cell, every row: the exact search, with ties, nulls, hot equal vectors in several blocks, increments and a padded last part."""
    monkeypatch.setattr(I, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=7)) for i in range(150)] + [(i, np.ones(7)) for i in range(150, 230)] + [(None, np.ones(7)), (400, None)]
    later = frame(spark, [(500 + i, rng.normal(size=7)) for i in range(40)] + [(600, np.ones(7))])
    path = I.build_index(frame(spark, rows), str(tmp_path / "index"), cells=6)
    I.add_to_index(spark, path, later)
    asks = frame(spark, [(i, v) for i, v in rows[:12]] + [(160, np.ones(7)), (9000, 3 * np.ones(7)), (9001, None)], "query_id")
    found = I.index_topk(spark, path, asks, 9, probes=6, refine=60, own=False)
    want = R.vector_topk(asks, frame(spark, rows).unionByName(later), 9, own=False)
    assert hits(found) == hits(want)
    counts = {r.cell: (r.n, r.blocks) for r in I._cells(spark, path).collect()}
    assert sum(n for n, _ in counts.values()) == 271 and all(b >= n / 60 for n, b in counts.values()) and max(b for _, b in counts.values()) >= 3


def test_recall_and_pruning_on_clusters(spark, tmp_path, clustered):
    memories = frame(spark, clustered)
    asks = frame(spark, clustered[::50], "query_id")
    path = I.build_index(memories, str(tmp_path / "index"))
    probes = I.probes_for(spark, path, memories, 5, target=0.97)
    found = I.index_topk(spark, path, asks, 5, probes, own=False)
    assert I.recall(found, R.vector_topk(asks, memories, 5, own=False)).first().recall >= 0.9
    assert I.scanned_share(spark, path, asks, probes).first().share < 0.3
    one = asks.where("query_id = 50")
    few = I.index_topk(spark, path, one, 5, probes, own=False)
    assert few.count() == 5
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert I.scanned_share(spark, path, one, probes).first().cells_share < 0.5


def test_bad_input(spark, tmp_path):
    with pytest.raises(ValueError):
        I.build_index(frame(spark, [(1, None)]), str(tmp_path / "none"))
    path = I.build_index(frame(spark, [(1, [1.0, 0.0])]), str(tmp_path / "one"))
    assert hits(I.index_topk(spark, path, frame(spark, [(1, [1.0, 1.0]), (2, [0.0, -1.0])], "query_id"), 3, 5, own=False)) == [(2, 1, 1, 0.0)]
    with pytest.raises(Exception, match="zero or NaN"):
        I.index_topk(spark, path, frame(spark, [(1, [0.0, 0.0])], "query_id"), 3, 5).collect()


def test_products_with_centres_are_bounded():
    """What a product with the centres holds doesn't grow with rows times centres, and the nearest are the same."""
    import tracemalloc

    rng = np.random.default_rng(4)
    rows, centres = rng.normal(size=(20_000, 8)), rng.normal(size=(1_000, 8))
    tracemalloc.start()
    got = I.Model(centres, np.zeros((2, 1, 4))).cells(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[:500] == ((rows[:500, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(got) == 20_000 and most < 8 * 20_000 * 1_000 / 8
    assert [s for s in I.sliced(0, 5)] == [] and sum(s.stop - s.start for s in I.sliced(9, 1 << 30)) == 9
