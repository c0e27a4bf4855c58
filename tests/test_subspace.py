"""Subspaces by rounds and by batches against the dense way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangentia.functions import estimators
from tangentia.operators import features, subspace


def _signal(rng, p, k, n, cplx=False, power=8.0):
    z = (lambda *s: rng.normal(size=s) + 1j * rng.normal(size=s)) if cplx else (lambda *s: rng.normal(size=s))
    u = np.linalg.qr(z(p, k))[0]
    return u @ (z(k, n) * np.sqrt(power * rng.gamma(2, 1, n))) + z(p, n)


def _frame(spark, samples):
    rows = []
    for key, x in samples.items():
        for i, v in enumerate(x.T):
            rows.append((key, i, (v.real.tolist(), v.imag.tolist()) if np.iscomplexobj(x) else v.tolist()))
    kind = "struct<re: array<double>, im: array<double>>" if np.iscomplexobj(next(iter(samples.values()))) else "array<double>"
    return spark.createDataFrame(rows, f"key string, i int, x {kind}").repartition(5)


def _projector(basis, k):
    u = (np.array(basis["re"]) + 1j * np.array(basis["im"])).reshape(-1, k)
    return u @ np.conj(u.T)


@pytest.mark.parametrize("numbers", [4_000_000, 4_000])
def test_wide_samples_as_dense(spark, monkeypatch, numbers):
    """300 channels, samples of different length and one of few rows, in one block or each in its own: projectors within 1e-6 of those of the p x p matrix."""
    monkeypatch.setattr(subspace, "BROADCAST_NUMBERS", numbers)
    rng = np.random.default_rng(0)
    x = {"a": _signal(rng, 300, 3, 700), None: _signal(rng, 300, 3, 120, power=30) + 2}
    found = subspace.top_subspace(_frame(spark, x), ["key"], F.col("x"), 3, assume_centered=False)
    bases = {r["key"]: r for r in found.bases.collect()}
    assert set(bases) == set(x)
    for key, v in x.items():
        u = estimators.top_subspace(estimators.scm(v, assume_centered=False), 3)
        assert bases[key]["n"] == v.shape[1]
        np.testing.assert_allclose(_projector(bases[key]["basis"], 3), u @ u.T, atol=1e-6)


@pytest.mark.parametrize("cplx, estimate_sigma", [(False, True), (True, False)])
def test_weighted_as_the_estimator_of_one_matrix(spark, cplx, estimate_sigma):
    rng = np.random.default_rng(1)
    x = {"a": _signal(rng, 40, 2, 300, cplx) * (3 if estimate_sigma else 1), "b": _signal(rng, 40, 2, 150, cplx)}
    found = subspace.top_subspace(_frame(spark, x), ["key"], F.col("x"), 2, weighted=True, estimate_sigma=estimate_sigma, tol=1e-8, carry=["i"])
    bases = {r["key"]: r for r in found.bases.collect()}
    tau = found.textures(["i"]).orderBy("i").toPandas()
    for key, v in x.items():
        textures, u = estimators.tau_subspace(v, 2, estimate_sigma, tol=1e-12)
        np.testing.assert_allclose(_projector(bases[key]["basis"], 2), u @ np.conj(u.T), atol=1e-6)
        np.testing.assert_allclose(tau[tau["key"] == key]["tau"], textures, rtol=1e-4, atol=1e-6)


def test_features_by_rounds(spark):
    """As many columns as channels: rounds are those of the estimator, whatever their number."""
    rng = np.random.default_rng(2)
    x = {"u": _signal(rng, 4, 1, 60), "v": _signal(rng, 4, 1, 60)}
    df = _frame(spark, x).select("key", "i", *[F.col("x")[j].alias(f"x{j}") for j in range(4)])
    for feature in (features.subspace_SCM(1), features.subspace_tau_UUH(1, tol=-1, max_iter=3), features.tau_UUH(1, tol=1e-10)):
        bound = feature.bind(4, 60)
        one, other = (
            {r["key"]: bound.point(r["f"]) for r in bound.estimate(df, ["key"], [f"x{j}" for j in range(4)], ["i"], rounds=rounds).collect()} for rounds in (True, False)
        )
        for key in x:
            a, b = ((v[1] if isinstance(v, tuple) else v) for v in (one[key], other[key]))
            np.testing.assert_allclose(a @ a.T, b @ b.T, atol=1e-7)
            if isinstance(one[key], tuple):
                np.testing.assert_allclose(one[key][0], other[key][0], rtol=1e-4, atol=1e-8)


def _cost(x, u):
    k = u.shape[1]
    e = (np.abs(np.conj(u.T) @ x) ** 2).sum(0)
    tau = np.maximum(e / k - 1, estimators.LEAST_TEXTURE)
    return estimators.SubspaceLikelihood(x, k).cost((tau, u))


def test_batches_reach_the_cost_of_all_rows_and_agree(spark):
    rng = np.random.default_rng(3)
    x = {"a": _signal(rng, 12, 2, 400), "b": _signal(rng, 12, 2, 90)}
    df = _frame(spark, x)
    runs = [
        {r["key"]: r["basis"] for r in subspace.descend(part, ["key"], F.col("x"), 2, ["i"], batches=4, epochs=6).bases.collect()}
        for part in (df, df.repartition(2, "i"))
    ]
    for key, v in x.items():
        np.testing.assert_allclose(_projector(runs[0][key], 2), _projector(runs[1][key], 2), atol=1e-9)
        u = np.array(runs[0][key]["re"]).reshape(-1, 2)
        best = _cost(v, estimators.tau_subspace(v, 2, tol=1e-12)[1])
        start = _cost(v, subspace._start(12, 2, False, 0))
        assert _cost(v, u) - best < 0.01 * (start - best)


def test_nothing_nulls_and_uneven_vectors(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, None), ("a", 2, [1.0, None]), ("a", 3, [2.0, 4.0]), (None, 4, [float("nan"), 1.0])], "key string, i int, x array<double>")
    found = subspace.top_subspace(df, ["key"], F.col("x"), 1)
    assert [(r["key"], r["n"]) for r in found.bases.collect()] == [("a", 2)]
    np.testing.assert_allclose(_projector(found.bases.first()["basis"], 1), np.array([[1, 2], [2, 4]]) / 5, atol=1e-12)
    empty = subspace.top_subspace(df.where("i < 0"), ["key"], F.col("x"), 1)
    assert empty.bases.count() == 0 and empty.textures().count() == 0
    assert subspace.descend(df.where("i < 0"), ["key"], F.col("x"), 1, ["i"]).bases.count() == 0
    with pytest.raises(ValueError):
        subspace.top_subspace(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "key string, x array<double>"), ["key"], F.col("x"), 1)
