import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tangentia.functions import estimators, generate
from tangentia.functions import geometry as geo
from tangentia.operators import estimate, features, learn, montecarlo
from tangentia.operators.features import Means

P, N, M = 3, 30, 16


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for i in range(M):
        rng = np.random.default_rng(i)
        x = generate.gaussian(generate.covariance(P, np.random.default_rng(100 + i % 2)), N, rng) + 4 * (i % 2)
        rows += [(i, j, *map(float, x[:, j]), i % 2) for j in range(N)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "obs", "a", "b", "c", "label"])).cache()
    df.count()
    return df


def _matrix(samples, i):
    return samples.where(F.col("id") == i).orderBy("obs").select("a", "b", "c").toPandas().to_numpy().T


def _bound(feature, samples):
    b = feature.bind(P, N)
    return b, b.estimate(samples, ["id"], ["a", "b", "c"], ["obs"])


ALL = {
    "identity": (features.identity_euclidean(), lambda x: x),
    "center": (features.center_euclidean(), lambda x: x[:, N // 2]),
    "center_intensity": (features.center_intensity_euclidean(), lambda x: [np.linalg.norm(x[:, N // 2])]),
    "mean": (features.mean_vector_euclidean(), lambda x: x.mean(axis=1)),
    "intensity": (features.intensity_vector_euclidean(), lambda x: np.linalg.norm(x, axis=0)),
    "covariance": (features.covariance(), estimators.scm),
    "covariance_centered": (features.covariance_euclidean(False), lambda x: estimators.scm(x, False)),
    "tyler": (features.covariance_texture(), estimators.tyler),
    "gaussian": (features.location_covariance_orth_triangle(), estimators.gaussian),
    "unit_scatter": (features.location_covariance_texture_Gaussian_constrained_scatter(), estimators.gaussian_unit_scatter),
    "unit_textures": (features.location_covariance_texture_Gaussian_constrained_texture(), estimators.gaussian_unit_textures),
    "tau_uuh": (features.tau_UUH(1), lambda x: estimators.tau_subspace(x, 1)),
}


@pytest.mark.parametrize("name", ALL)
def test_estimates_equal_numpy(samples, name):
    feature, want = ALL[name]
    b, df = _bound(feature, samples)
    rows = {r["id"]: b.point(r["f"]) for r in df.where("id < 3").collect()}
    for i in range(3):
        for got, expected in zip(*(z if isinstance(z, tuple) else (z,) for z in (rows[i], want(_matrix(samples, i)))), strict=True):
            np.testing.assert_allclose(got, expected, atol=1e-8)


def test_complex_estimates(spark):
    rng = np.random.default_rng(0)
    x = generate.gaussian(generate.covariance(2, rng, True), 50, rng)
    df = spark.createDataFrame(pd.DataFrame({"id": 0, "o": range(50), "r0": x[0].real, "i0": x[0].imag, "r1": x[1].real, "i1": x[1].imag}))
    channels = [("r0", "i0"), ("r1", "i1")]
    for feature, want in ((features.covariance(), estimators.scm(x)), (features.covariance(False), estimators.scm(x, False))):
        b = feature.bind(2, 50, complex_valued=True)
        np.testing.assert_allclose(b.point(b.estimate(df, ["id"], channels).first()["f"]), want, atol=1e-10)
    b = features.covariance_texture().bind(2, 50, True)
    sigma, tau = b.point(b.estimate(df, ["id"], channels, ["o"]).first()["f"])
    np.testing.assert_allclose(sigma, estimators.tyler(x)[0], atol=1e-10)


def test_orders_and_bindings_are_asked_for(samples):
    with pytest.raises(ValueError):
        features.covariance_texture().bind(P, N).estimate(samples, ["id"], ["a", "b", "c"])
    with pytest.raises(KeyError):
        _ = features.covariance().geometry
    with pytest.raises(TypeError):
        features.user_defined("x", 3, geo.Euclidean(2))


def test_partitions_do_not_matter(samples):
    one = _bound(features.covariance(), samples.repartition(1))[1].orderBy("id").collect()
    many = _bound(features.covariance(), samples.repartition(7))[1].orderBy("id").collect()
    for a, b in zip(one, many, strict=True):
        np.testing.assert_allclose(a["f"]["c0"], b["f"]["c0"], rtol=1e-12)


@pytest.mark.parametrize(
    "feature",
    [
        features.covariance(), features.covariance_texture(), features.subspace_SCM(1),
        features.covariance_div_alpha(alpha=0.5), features.location_covariance_orth_triangle(), features.location_covariance_scale_triangle(),
        features.location_covariance_div_alpha(alpha=0), features.location_covariance_div_alpha(alpha=1),
    ],
)
def test_means_are_least(samples, feature):
    """No small step from the mean lowers the objective."""
    b, df = _bound(feature, samples.where("label = 0"))
    g, m = b.geometry, b.mean(df)
    points = [b.point(r["f"]) for r in df.collect()]

    def cost(at):
        return np.mean([float(g.dist(at, x)) ** 2 for x in points])

    best = cost(m)
    for e in g.frame(m):
        for h in (1e-3, -1e-3):
            assert cost(g.retract(m, tuple(h * a for a in e) if isinstance(e, tuple) else h * e)) >= best - 1e-7


def test_distributed_means_equal_local_ones(samples, monkeypatch):
    for feature in (features.covariance(), features.covariance_div_alpha(alpha=0.5)):
        b, df = _bound(feature, samples)
        df = df.join(samples.select("id", "label").distinct(), "id").cache()
        local = b.means(df, "label")
        monkeypatch.setattr(Means, "_gather", lambda self: None)
        spread = b.means(df, "label", max_iter=6)
        monkeypatch.undo()
        assert list(local) == list(spread) == [0, 1]
        for k in local:
            np.testing.assert_allclose(local[k], spread[k], rtol=0.02, atol=0.02)


def test_closed_forms(samples):
    b, df = _bound(features.covariance_div_alpha(alpha=1), samples)
    points = np.stack([b.point(r["f"]) for r in df.collect()])
    np.testing.assert_allclose(b.mean(df), points.mean(axis=0), atol=1e-10)
    b, df = _bound(features.covariance_div_alpha(alpha=0), samples)
    np.testing.assert_allclose(b.mean(df), np.linalg.inv(np.linalg.inv(points).mean(axis=0)), atol=1e-8)
    b, df = _bound(features.covariance(), samples.where("id < 2"))
    x = [b.point(r["f"]) for r in df.collect()]
    half = b.geometry.exp(x[0], b.geometry.log(x[0], x[1]) / 2)
    np.testing.assert_allclose(b.mean(df), half, atol=1e-7)


def test_distances_logs_and_vectors(samples):
    b, df = _bound(features.covariance_texture(), samples)
    rows = df.orderBy("id").limit(3)
    points = [b.point(r["f"]) for r in rows.collect()]
    got = b.distances_to(rows, points[:2]).orderBy("id").collect()
    for r, x in zip(got, points, strict=True):
        np.testing.assert_allclose(r["d"], [b.distance(m, x) for m in points[:2]], atol=1e-8)
    assert len(b.distances(points[0], points[1])) == 3
    v = b.logs(rows, points[0]).orderBy("id").collect()
    assert len(v[0]["v"]) == P * (P + 1) // 2 + N
    np.testing.assert_allclose(v[0]["v"], 0, atol=1e-7)
    assert len(b.vectorized(rows).first()["v"]) == P * (P + 1) // 2 + N
    with pytest.raises(NotImplementedError):
        gauss, g = _bound(features.location_covariance_orth_triangle(), samples)
        gauss.logs(g, None)


def test_user_defined_feature(samples):
    f = features.user_defined("spread", lambda x: (x.std(axis=1), x.mean(axis=1)), [geo.Positive(P), geo.Euclidean(P)], [0, 1])
    b, df = _bound(f, samples)
    mean = b.mean(df)
    assert mean[0].shape == (P,) and mean[1].shape == (P,)


def test_mdm_and_tangent_space(samples):
    b, df = _bound(features.covariance(False), samples)
    df = df.join(samples.select("id", "label").distinct(), "id")
    model = learn.MDM(b).fit(df)
    assert model.classes == [0, 1]
    hit = model.predict(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.9
    for r in model.predict_proba(df).collect():
        assert sum(r["proba"]) == pytest.approx(1)
        assert int(np.argmax(r["proba"])) == int(np.argmin(r["d"]))
    v = np.array([r["v"] for r in learn.TangentSpace(b).fit_transform(df).collect()])
    np.testing.assert_allclose(v.mean(axis=0), 0, atol=1e-5)


def test_kmeans(samples):
    b, df = _bound(features.mean_vector_euclidean(), samples)
    df = df.join(samples.select("id", "label").distinct(), "id").cache()
    for init in ("random", "k-means++"):
        model = learn.KMeans(b, 2, init, n_init=3, max_iter=10).fit(df)
        table = model.predict(df).groupBy("label", "prediction").count().collect()
        assert len(table) == 2 and len(model.criteria) == 3
    with pytest.raises(ValueError):
        learn.KMeans(b, 0)


def test_kmeans_here_and_there_agree(samples, monkeypatch):
    b, df = _bound(features.covariance(False), samples)
    here = learn.KMeans(b, 2, n_init=1, max_iter=4).fit(df)
    monkeypatch.setattr(learn, "gather", lambda *a: None)
    there = learn.KMeans(b, 2, n_init=1, max_iter=4).fit(df)
    np.testing.assert_allclose(here.criteria[0], there.criteria[0], rtol=1e-6)


def test_monte_carlo_and_samples(spark):
    sigma = np.eye(2)
    df = montecarlo.monte_carlo(spark, {"scm": sigma}, lambda rng: generate.gaussian(sigma, 100, rng), {"scm": features.covariance().bind(2, 100)}, 20, 1)
    again = montecarlo.monte_carlo(spark, {"scm": sigma}, lambda rng: generate.gaussian(sigma, 100, rng), {"scm": features.covariance().bind(2, 100)}, 20, 1, partitions=3)
    a, b = df.first(), again.first()
    assert 0 < a["mse"] < 0.2 and a["mse"] == pytest.approx(b["mse"])
    drawn = montecarlo.samples(spark, 101, 2, lambda n, rng: generate.standard(2, n, rng))
    assert drawn.select("obs_idx").distinct().count() == 101


def test_empty_and_packed(spark, samples):
    assert _bound(features.covariance(), samples.where("id < 0"))[1].count() == 0
    packed = estimate.packed(samples, ["id"], ["a", "b", "c"], ["obs"])
    np.testing.assert_allclose(np.array(packed.where("id = 1").first()["f"]["c0"]).reshape(P, N), _matrix(samples, 1))


@pytest.mark.parametrize("block", [256, 5])
def test_all_pairs(samples, block):
    from tangentia.operators import pairs

    b, df = _bound(features.covariance_texture(), samples)
    points = [b.point(r["f"]) for r in df.orderBy("id").collect()]
    want = np.array([[b.distances(x, y) for y in points] for x in points])
    np.testing.assert_allclose(pairs.mean_squared_distances(df, b, block=block), (want**2).mean(axis=(0, 1)), rtol=1e-6)
    got = pairs.distances(df, b, block=block).toPandas().pivot(index="a", columns="b", values="d").to_numpy()
    np.testing.assert_allclose(got, want[:, :, 0], atol=1e-6)


@pytest.mark.parametrize(
    "feature",
    [
        features.covariance_div_alpha(alpha=0.5), features.covariance_div_alpha(alpha=0.3, symmetrize=True, real_case=True),
        features.location_covariance_orth_triangle(), features.location_covariance_scale_triangle(), features.location_covariance_div_alpha(alpha=0.33),
    ],
    ids=lambda f: f.name,
)
def test_means_of_many_channels_are_stationary(spark, feature):
    """p = 20 in seconds: the gradient of the mean squared divergence vanishes at the mean."""
    import time

    rng, p, n = np.random.default_rng(6), 20, 60
    base = np.eye(p) + 0.3
    bound = feature.bind(p, n)
    points = [bound.estimation(np.linalg.cholesky(base) @ rng.standard_normal((p, n)) + rng.standard_normal((p, 1)) * 0.3) for _ in range(12)]
    many = tuple(np.stack(z) for z in zip(*points, strict=True)) if isinstance(points[0], tuple) else np.stack(points)
    began = time.time()
    mean = features.Means(bound, {0: many}).run(1000)[0]
    assert time.time() - began < 20
    g = bound.geometry
    at = tuple(np.broadcast_to(a, (12, *a.shape)) for a in mean) if isinstance(mean, tuple) else np.broadcast_to(mean, (12, *mean.shape))
    slope = g.squared_gradient(at, many)
    slope = tuple(a.mean(axis=0) / 2 for a in slope) if isinstance(slope, tuple) else slope.mean(axis=0) / 2
    assert float(g.norm(mean, g.egrad2rgrad(mean, slope))) < 1e-4


def test_trials_around_the_rows_of_a_table(spark):
    """The same for any partitioning; rows without a point have none; a sampler without chance has known errors."""
    bound = features.covariance().bind(2, 2)
    rows = [("a", ([1.0, 0.0, 0.0, 2.0],)), ("b", ([3.0, 0.5, 0.5, 1.0],)), (None, ([1.0, 0.0, 0.0, 1.0],)), ("c", None)]
    df = spark.createDataFrame(rows, "key string, f struct<c0: array<double>>")

    runs = [
        sorted(map(tuple, montecarlo.around(x, ["key"], features.covariance().bind(2, 50), lambda s, n, rng: generate.gaussian(np.asarray(s), n, rng), 4, 50, seed=3).collect()), key=repr)
        for x in (df, df.repartition(4))
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 12 and len({r[3] for r in runs[0]}) == 12
    same = montecarlo.around(df, ["key"], bound, lambda s, n, rng: np.sqrt(2) * 2 * np.linalg.cholesky(np.asarray(s)), 2, 2).collect()
    assert all(abs(r["error"] - np.sqrt(2) * np.log(4)) < 1e-9 for r in same) and len(same) == 6


def test_subsamples_follow_the_rows(spark):
    df = spark.range(2000).withColumn("null", F.lit(None).cast("string"))
    one = montecarlo.subsamples(df, ["id", "null"], 3, 0.25, seed=2)
    other = montecarlo.subsamples(df.repartition(5), ["id", "null"], 3, 0.25, seed=2)
    assert sorted(map(tuple, one.select("id", "trial").collect())) == sorted(map(tuple, other.select("id", "trial").collect()))
    assert all(400 < r["count"] < 600 for r in one.groupBy("trial").count().collect())


@pytest.mark.parametrize("make", [lambda: features.covariance(), lambda: features.mean_vector_euclidean(), lambda: features.location_covariance_div_alpha(real_case=True)])
def test_distributed_rounds_are_those_of_the_driver(spark, monkeypatch, make):
    """Means and K-means of many rows, forced on few."""
    rng = np.random.default_rng(6)
    x = pd.DataFrame(rng.normal(size=(600, 2)) * np.repeat([1, 3], 300)[:, None], columns=["a", "b"]).assign(id=np.repeat(np.arange(20), 30))
    feature = make().bind(2, 30)
    f = feature.estimate(spark.createDataFrame(x), ["id"], ["a", "b"], ["id"]).withColumn("label", F.col("id") % 2).persist()
    runs = []
    for numbers in (2_000_000, 0):
        monkeypatch.setattr(features, "LOCAL_NUMBERS", numbers)
        means = feature.means(f, "label")
        model = learn.KMeans(feature, 2, init=[0, 19], n_init=1, max_iter=4, tol=0).fit(f)
        labels = {r["id"]: r["prediction"] for r in model.predict(f).collect()}
        runs.append((means, model.criteria[0], labels))
    f.unpersist()
    assert runs[0][2] == runs[1][2]
    np.testing.assert_allclose(runs[0][1], runs[1][1], rtol=1e-6)
    for k in runs[0][0]:
        a, b = ((v if isinstance(v, tuple) else (v,)) for v in (runs[0][0][k], runs[1][0][k]))
        for u, v in zip(a, b, strict=True):
            np.testing.assert_allclose(u, v, rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("kind", ["additive", "logs"])
def test_bounded_rounds_of_all_starts_are_those_of_lloyd(spark, monkeypatch, kind):
    """The same criteria and labels as one start after the other, and fewer than half of the distances at ten clusters."""
    rng = np.random.default_rng(8)
    if kind == "additive":
        feature, k = features.mean_vector_euclidean().bind(2, 1), 10
        points = rng.normal(size=(400, 2)) + rng.integers(0, 5, size=(400, 2)) * 6
    else:
        feature, k = features.covariance().bind(2, 1), 3
        a = rng.normal(size=(60, 2, 4)) * np.repeat([1, 4, 12], 20)[:, None, None]
        points = a @ np.swapaxes(a, 1, 2)
    f = spark.createDataFrame([(i, v) for i, v in enumerate(feature.encode(points).to_pylist())], f"id long, f {feature.type}").repartition(3).persist()
    runs = []
    for numbers in (2_000_000, 0):
        monkeypatch.setattr(features, "LOCAL_NUMBERS", numbers)
        model = learn.KMeans(feature, k, n_init=2, max_iter=6 if k > 3 else 3, tol=0, seed=4).fit(f)
        runs.append((model.criteria, {r["id"]: r["prediction"] for r in model.predict(f).collect()}, model))
    f.unpersist()
    for a, b in zip(runs[0][0], runs[1][0], strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-7)
    assert runs[0][1] == runs[1][1]
    if kind == "additive":
        rounds = sum(len(c) for c in runs[1][0])
        assert runs[1][2].distances < 0.5 * rounds * k * len(points)
