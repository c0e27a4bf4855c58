"""Metric joins against all pairs."""

import numpy as np
import pandas as pd
import pytest

from tangentia.functions import geometry as geo
from tangentia.functions.matrix import expm
from tangentia.operators import features, nearest


def _points(kind, n, rng):
    if kind == "euclid":
        return rng.normal(size=(n, 3)), features.mean_vector_euclidean().bind(3, 1)
    if kind == "airm":
        a = rng.normal(size=(n, 2, 2))
        return expm(a + np.swapaxes(a, -1, -2)), features.covariance().bind(2, 1)
    if kind == "grassmann":
        return np.linalg.qr(rng.normal(size=(n, 4, 2)))[0], features.subspace_SCM(2).bind(4, 1)
    x = (rng.normal(size=(n, 2)), np.exp(rng.normal(size=(n, 3))))
    space = [geo.Euclidean(2), geo.Positive(3)]
    return x, features.user_defined("both", lambda v: v, space, [1, 0.5]).bind(2, 1)


def _frame(spark, feature, x, keys):
    f = feature.encode(x).to_pylist()
    rows = [(k, v) for k, v in zip(keys, f, strict=True)] + [(None, f[0]), (7, None)]
    return spark.createDataFrame(rows, f"id long, f {feature.type}").repartition(3)


@pytest.mark.parametrize("kind, numbers", [("euclid", 60), ("airm", 1 << 20), ("grassmann", 1 << 20), ("product", 60)])
def test_joins_equal_all_pairs(spark, monkeypatch, kind, numbers):
    """One block of queries or many, a repeated key, an equal point, and rows without key or point."""
    monkeypatch.setattr(nearest, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(1)
    n = 40
    x, feature = _points(kind, n, rng)
    keys = [10 + k for k in range(n - 1)] + [10]
    x = tuple(np.concatenate([a[:-1], a[5:6]]) for a in x) if isinstance(x, tuple) else np.concatenate([x[:-1], x[5:6]])
    d = np.stack([nearest._distances(feature.geometry, nearest._at(x, i), x) for i in range(n)])
    df = _frame(spark, feature, x, keys)
    some = df.where("id < 25 or id is null")
    asked = [i for i in range(n) if keys[i] < 25]

    got = nearest.nearest(feature, some, df, 3)
    want = sorted((keys[i], r, k) for i in asked for r, (_, k) in enumerate(sorted((round(d[i, j], 9), keys[j]) for j in range(n) if keys[j] != keys[i])[:3], 1))
    assert sorted((r["query"], r["rank"], r["key"]) for r in got.rows.collect()) == want
    assert 0 < got.computed and got.pairs == len(asked) * n

    radius = float(np.quantile(d, 0.2))
    pairs = nearest.within(feature, some, df, radius)
    want = sorted((keys[i], keys[j], round(d[i, j], 6)) for i in asked for j in range(n) if d[i, j] <= radius)
    assert sorted((r["query"], r["key"], round(r["d"], 6)) for r in pairs.rows.collect()) == want


def test_clusters_are_passed_over(spark):
    """Of points in far clusters, pivots leave out most distances."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 3)) + c * 100 for c in range(5)])
    feature = features.mean_vector_euclidean().bind(3, 1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "f": [{"c0": v.tolist()} for v in x]}), f"id long, f {feature.type}")
    got = nearest.nearest(feature, df.where("id % 50 = 0"), df, 2)
    assert got.rows.count() == 40 and got.computed < 0.7 * got.pairs
    found = nearest.within(feature, df.where("id % 50 = 0"), df, 3.0)
    assert found.computed < 0.7 * found.pairs


def test_divergences_and_nothing(spark):
    feature = features.location_covariance_div_alpha().bind(2, 1)
    empty = spark.createDataFrame([], f"id long, f {feature.type}")
    with pytest.raises(ValueError):
        nearest.nearest(feature, empty, empty)
    feature = features.covariance().bind(2, 1)
    empty = spark.createDataFrame([], f"id long, f {feature.type}")
    assert nearest.nearest(feature, empty, empty).rows.count() == 0 and nearest.within(feature, empty, empty, 1.0).pairs == 0


@pytest.mark.parametrize("kind", ["euclid", "airm", "grassmann", "product"])
def test_blocks_equal_all_pairs(kind):
    """Blocks of queries against a task's blocks of points; far blocks don't meet."""
    rng = np.random.default_rng(3)
    x, feature = _points(kind, 300, rng)
    g = feature.geometry
    d = np.stack([nearest._distances(g, nearest._at(x, i), x) for i in range(300)])
    own, names = d[:, :8], np.arange(300)
    table, seen = nearest._Points(x, own, names, 20), 0
    limit = np.sort(d, axis=1)[:, 4]
    for at in nearest._cuts(own, 16):
        low, high = (v[0] for v in nearest._boxes(own, [at]))
        i, j, v, _ = table.within(g, nearest._at(x, at), low, high, limit[at])
        assert set(zip(at[i], j, strict=True)) == {(a, b) for a in at for b in np.flatnonzero(d[a] <= limit[a])}
        np.testing.assert_allclose(v, d[at[i], j], atol=1e-7)
        i, j, v, n = table.nearest(g, nearest._at(x, at), names[at], low, high, np.full(len(at), np.inf), 3)
        seen += n
        for row, a in enumerate(at):
            assert set(np.argsort(np.where(names == a, np.inf, d[a]), kind="stable")[:3]) == set(j[i == row])
    assert seen < 300 * 300 or kind in ("grassmann", "product")
