"""Estimators of batches against those of one sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangentia.functions import estimators, solvers
from tangentia.functions import geometry as geo
from tangentia.operators import features, pairs


def _samples(seed=0, lengths=(40, 25, 40, 40, 25, 60), cplx=False):
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.normal(size=(3, n)) * rng.gamma(1, 2, n) + rng.normal(size=(3, 1))
    return [draw(n) + (1j * draw(n) if cplx else 0) for n in lengths]


def _same(one, many, xs, tol=1e-8):
    got = estimators.by_length(many)(xs)
    for i, x in enumerate(xs):
        want = one(x)
        for a, b in zip(want, got, strict=True):
            np.testing.assert_allclose(b[i], a, rtol=tol, atol=tol)


@pytest.mark.parametrize("cplx", [False, True])
def test_fixed_points(cplx):
    xs = [np.resize(x, (3, 40)) for x in _samples(cplx=cplx)]
    for how in ({}, {"tol": -1, "max_iter": 6}, {"normalize": "trace"}):
        _same(lambda x, how=how: estimators.tyler(x, **how), lambda x, how=how: estimators.tyler_many(x, **how), xs)
    for how in ({}, {"tol": -1, "max_iter": 4}):
        _same(lambda x, how=how: estimators.joint_tyler(x, **how), lambda x, how=how: estimators.joint_tyler_many(x, **how), xs)
    for how in ({}, {"estimate_sigma": True}):
        own = lambda found: (found[0], found[1] @ np.conj(np.swapaxes(found[1], -1, -2)))
        _same(lambda x, how=how: own(estimators.tau_subspace(x, 1, **how)), lambda x, how=how: own(estimators.tau_subspace_many(x, 1, **how)), xs)


@pytest.mark.parametrize("how", [("scatter", 20), ("textures", 20, True, "steepest", "AF", 0.1), ("textures", 15, True, "conjugate", "KL", 0.1), ("scatter", 10, False)])
def test_compound_descents(how):
    """Every descent by its own steps, though all are made at once."""
    xs = [x for x in _samples(1, (40,) * 6)]
    _same(lambda x: estimators.compound(x, *how), lambda x: estimators.compound_many(x, *how), xs, 1e-6)


def test_guarded_steps_are_halved_one_by_one():
    g = geo.CompoundUnitTextures(2, 4)
    rng = np.random.default_rng(2)
    x = [g.rand(rng) for _ in range(5)]
    u = [tuple(s * a for a in g.rand_tangent(y, rng)) for y, s in zip(x, (0.1, 50, 1, 1000, 0), strict=True)]
    many = g.retract(*(tuple(np.stack(a) for a in zip(*z, strict=True)) for z in (x, u)))
    for i in range(5):
        for a, b in zip(g.retract(x[i], u[i]), many, strict=True):
            np.testing.assert_allclose(b[i], a, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("solver", ["steepest", "conjugate"])
def test_descents_of_matrices(solver):
    g, rng = geo.PositiveDefinite(2), np.random.default_rng(3)
    s = np.stack([g.rand(rng) for _ in range(20)] + [np.eye(2)])
    got = solvers.descend_many(g, lambda y, at: g.dist(y, s[at]) ** 2 / 2, lambda y, at: -g.log(y, s[at]), np.tile(np.eye(2), (21, 1, 1)), solver, 500, 1e-9, 1e-14)
    np.testing.assert_allclose(got, s, atol=1e-6)


def test_pairs_carry_no_blocks(spark):
    """No row holds a block of points: one side is sent, the other streams."""
    f = features.covariance().bind(2, 1)
    df = spark.createDataFrame([(i, {"c0": [1.0 + i, 0.1, 0.1, 1.0]}) for i in range(40)], f"id long, f {f.type}")
    found = pairs.distances(df, f)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and found.count() == 1600


def test_distances_of_like_points_take_little_room(spark, tmp_path):
    """Points that are alike are neighbours in the pairs, whatever their ids, so Parquet keeps the distances in runs."""
    f, rng = features.covariance().bind(2, 1), np.random.default_rng(5)
    distinct = [a @ a.T + np.eye(2) for a in rng.normal(size=(50, 2, 2))]
    ids = [int(i) for i in rng.permutation(1000)]
    df = spark.createDataFrame([(i, {"c0": [float(v) for v in distinct[i % 50].ravel()]}) for i in ids], f"id long, f {f.type}")
    pairs.distances(df, f).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.select("a", "b").distinct().count() == found.count() == 1000**2
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 1000**2
    want = [[f.distances(x, y)[0] for y in distinct] for x in distinct]
    got = found.groupBy((F.col("a") % 50).alias("a"), (F.col("b") % 50).alias("b")).agg(F.min("d").alias("low"), F.max("d").alias("high")).collect()
    for r in got:
        np.testing.assert_allclose([r["low"], r["high"]], want[r["a"]][r["b"]], atol=1e-6)


def test_only_long_samples_make_rounds(spark, monkeypatch):
    """The samples of more numbers than a task packs make rounds, the others don't, and all are as if packed; nulls take no part."""
    rng = np.random.default_rng(4)
    rows = [(s, i, *map(float, 5 * rng.normal(size=3))) for s, n in ((1, 12), (2, 60), (None, 60), (3, 20)) for i in range(n)]
    rows += [(1, 99, None, 1.0, 1.0), (2, 99, 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, obs long, a double, b double, c double")
    f, channels = features.subspace_tau_UUH(1, tol=-1, max_iter=4).bind(3, 1), ["a", "b", "c"]
    want = {r["id"]: np.outer(*[r["f"]["c0"]] * 2) for r in f.estimate(df.dropna(subset=channels), ["id"], channels, ["obs"]).collect()}
    monkeypatch.setattr(features, "PACKED_NUMBERS", 90)
    got = f.estimate(df, ["id"], channels, ["obs"], rounds="long").collect()
    assert sorted((str(r["id"]), r["n"]) for r in got) == [("1", 12), ("2", 60), ("3", 20), ("None", 60)]
    for r in got:
        np.testing.assert_allclose(np.outer(*[r["f"]["c0"]] * 2), want[r["id"]], atol=1e-6)
