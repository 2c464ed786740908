"""Exact quantiles against numpy."""

import numpy as np
import pytest

from mnemoloom.operators import aggregates as A


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_equal_numpy(spark, accuracy):
    """Groups of one value, of ties only, of many values, of none, a null key; a coarse sketch must not change a digit."""
    rng = np.random.default_rng(accuracy)
    groups = {("a", 1): rng.normal(size=5000), ("a", 2): np.full(300, 7.0), ("b", 1): rng.integers(0, 4, 999).astype(float), (None, 1): np.array([3.5]), ("c", 9): rng.normal(size=2), ("d", 1): np.array([])}
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("d", 1, None), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, h long, v double").repartition(5)
    shares = {"low": 0.0, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {(r.g, r.h): tuple(r[m] for m in shares) for r in A.exact_quantiles(df, ["g", "h"], "v", shares, accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == (tuple(pytest.approx(np.quantile(vs, p), rel=1e-12) for p in shares.values()) if len(vs) else (None,) * 4)


def test_sizes_keep_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", None), ("y", 5)], "lang string, v long")
    got = {r.lang: (r.n, r.failed, r.median, r.p95) for r in A.size_stats(df, "v", ["lang"]).collect()}
    assert got == {None: (2, 0, 1.5, pytest.approx(1.95)), "x": (1, 1, None, None), "y": (1, 0, 5.0, 5.0)}
