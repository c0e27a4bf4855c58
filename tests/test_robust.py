"""Estimators by rounds against the estimators of one matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tangentia.functions import estimators
from tangentia.operators import features, robust, tables

SIZES = {"a": 60, "b": 500, None: 41}


@pytest.fixture(scope="module")
def real():
    rng = np.random.default_rng(0)
    out = {}
    for k, n in SIZES.items():
        a = rng.normal(size=(3, 3))
        out[k] = a @ rng.normal(size=(3, n)) * np.sqrt(rng.gamma(1, 1, n)) + rng.normal(size=(3, 1))
    return out


def _frame(spark, samples):
    """One row for each observation, channels of complex samples as pairs, dealt over many tasks."""
    rows = []
    for k, x in samples.items():
        flat = np.stack([v for z in x for v in (z.real, z.imag)]) if np.iscomplexobj(x) else x
        rows += [(k, i, *map(float, flat[:, i])) for i in range(x.shape[1])]
    names = ["key", "i", *[f"x{j}" for j in range(len(rows[0]) - 2)]]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names).replace({float("nan"): None})).repartition(5)


def _channels(x):
    p = len(x)
    return [(f"x{2 * j}", f"x{2 * j + 1}") for j in range(p)] if np.iscomplexobj(x) else [f"x{j}" for j in range(p)]


def _matrix(v, p):
    return (np.array(v["re"]) + 1j * np.array(v["im"])).reshape(p, -1)


@pytest.fixture(params=["broadcast", "dealt"])
def join(request, monkeypatch):
    if request.param == "dealt":
        monkeypatch.setattr(tables, "BROADCAST_NUMBERS", -1)


@pytest.mark.parametrize("normalize", ["det", None])
def test_tyler_is_that_of_one_matrix(spark, real, join, normalize):
    df = _frame(spark, real)
    fit = robust.tyler(df, ["key"], ["x0", "x1", "x2"], tol=0.02, normalize=normalize, carry=["i"])
    states = {r["key"]: r for r in fit.states.collect()}
    tau = fit.textures(["i"]).orderBy("i").toPandas()
    for k, x in real.items():
        sigma, textures = estimators.tyler(x, tol=0.02, normalize=normalize)
        assert states[k]["n"] == x.shape[1] and 1 < states[k]["rounds"] < 100
        np.testing.assert_allclose(_matrix(states[k]["sigma"], 3).real, sigma, rtol=1e-8)
        np.testing.assert_allclose(tau[tau["key"].isna() if k is None else tau["key"] == k]["tau"], textures, rtol=1e-8)


def test_location_and_scatter_are_those_of_one_matrix(spark, real, join):
    fit = robust.location_scatter(_frame(spark, real), ["key"], ["x0", "x1", "x2"], tol=0.02, carry=["i"])
    states = {r["key"]: r for r in fit.states.collect()}
    tau = fit.textures(["i"]).orderBy("i").toPandas()
    for k, x in real.items():
        mu, sigma, textures = estimators.joint_tyler(x, tol=0.02)
        np.testing.assert_allclose(_matrix(states[k]["mu"], 3).real.ravel(), mu, rtol=1e-8)
        np.testing.assert_allclose(_matrix(states[k]["sigma"], 3).real, sigma, rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(tau[tau["key"].isna() if k is None else tau["key"] == k]["tau"], textures, rtol=1e-7)


def test_complex_channels(spark):
    rng = np.random.default_rng(2)
    x = {"z": (rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2))) @ (rng.normal(size=(2, 90)) + 1j * rng.normal(size=(2, 90))) + (1 - 2j)}
    df = _frame(spark, x)
    fit = robust.tyler(df, ["key"], _channels(x["z"]), tol=0.02)
    np.testing.assert_allclose(_matrix(fit.states.first()["sigma"], 2), estimators.tyler(x["z"], tol=0.02)[0], rtol=1e-8)
    fit = robust.location_scatter(df, ["key"], _channels(x["z"]), tol=0.02)
    mu, sigma, _ = estimators.joint_tyler(x["z"], tol=0.02)
    np.testing.assert_allclose(_matrix(fit.states.first()["mu"], 2).ravel(), mu, rtol=1e-8)
    np.testing.assert_allclose(_matrix(fit.states.first()["sigma"], 2), sigma, rtol=1e-7)


@pytest.mark.parametrize("make", [features.covariance_texture, features.location_covariance_texture_Tyler_constrained_scatter])
@pytest.mark.parametrize("cplx", [False, True])
def test_features_by_rounds_are_those_of_packed_samples(spark, make, cplx):
    rng = np.random.default_rng(3)
    x = {k: rng.normal(size=(2, 50)) + (1j * rng.normal(size=(2, 50)) if cplx else 0) for k in ("u", "v")}
    df, bound = _frame(spark, x), make(tol=-1, max_iter=3).bind(2, 50, cplx)
    one, other = (
        {r["key"]: bound.point(r["f"]) for r in bound.estimate(df, ["key"], _channels(x["u"]), ["i"], rounds=rounds).collect()} for rounds in (True, False)
    )
    for k in x:
        for a, b in zip(one[k], other[k], strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-10)


def test_samples_without_an_answer(spark):
    """Observations at 0 weigh nothing, null channels drop the observation, too few directions give NaN, and nothing gives nothing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 40))
    rows = [("good", i, *map(float, x[:, i])) for i in range(40)] + [("good", 40, 0.0, 0.0), ("good", 41, None, 1.0)]
    rows += [("line", i, float(i), 2.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, i int, x0 double, x1 double")
    states = {r["key"]: r for r in robust.tyler(df, ["key"], ["x0", "x1"], tol=0.02).states.collect()}
    assert states["good"]["n"] == 41
    np.testing.assert_allclose(_matrix(states["good"]["sigma"], 2).real, estimators.tyler(np.c_[x, [0, 0]], tol=0.02)[0], rtol=1e-8)
    assert np.isnan(states["line"]["sigma"]["re"]).all() or not np.isfinite(states["line"]["sigma"]["re"]).all()
    empty = robust.tyler(df.where("i < 0"), ["key"], ["x0", "x1"])
    assert empty.states.count() == 0 and empty.textures().count() == 0


def test_no_sample_is_gathered(spark):
    """A long sample: one task's result is a row of sums, so no aggregate collects a list and the key's rows never move."""
    df = spark.range(200_000).select(F.lit(1).alias("key"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    fit = robust.tyler(df, ["key"], ["a", "b"], tol=1e-3)
    plan = fit.textures()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "collect_list" not in plan
    assert fit.states.first()["n"] == 200_000


def test_rounds_sort_no_rows(spark, monkeypatch):
    """A state among the sums of a round would make Spark sort all observations, which spills."""
    plans = []

    def told(df, name, written=robust.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(robust, "written", told)
    rows = [(k % 2, float(k % 5 + 1), float(k % 7) - 2) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for limit in (1 << 20, 0):  # states broadcast, and states that meet the rows by a shuffle
        monkeypatch.setattr(tables, "BROADCAST_NUMBERS", limit)
        assert robust.tyler(df, ["id"], ["a", "b"], tol=-1, max_iter=2).states.count() == 2
        assert robust.location_scatter(df, ["id"], ["a", "b"], tol=-1, max_iter=1).states.count() == 2
    assert len(plans) >= 8 and not any("SortAggregate" in p for p in plans)


def test_textures_of_zero(spark, real):
    """With no least texture a sample with an observation at the centre is NaN, packed and by rounds; the others are as ever."""
    samples = {k: x[:, :41].copy() for k, x in real.items()}
    samples["a"][:, 7] = 0
    df = _frame(spark, samples)
    for rounds in (False, True):
        bound = features.covariance_texture(tol=-1, max_iter=4, least=0).bind(3, 41)
        got = {r["key"]: r["f"] for r in bound.estimate(df, ["key"], ["x0", "x1", "x2"], ["i"], rounds=rounds).collect()}
        assert np.isnan(got["a"]["c0"]).all() and np.isnan(got["a"]["c1"]).all() and len(got["a"]["c1"]) == 41
        for k in ("b", None):
            sigma, tau = estimators.tyler(samples[k], tol=-1, max_iter=4)
            np.testing.assert_allclose(np.reshape(got[k]["c0"], (3, 3)), sigma, rtol=1e-8)
            np.testing.assert_allclose(got[k]["c1"], tau, rtol=1e-8)
    sigma, tau = estimators.tyler(samples["a"], tol=-1, max_iter=4, least=0)
    assert np.isnan(sigma).all() and np.isnan(tau).all()
    assert np.isfinite(estimators.tyler(samples["a"], tol=-1, max_iter=4)[0]).all()
