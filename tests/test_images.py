import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tangentia.operators import evaluation, features, images, learn
from tangentia.sources import images as source
from tangentia.streaming.covariance import windowed_covariance

H, W = 9, 11


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(0)
    rows = [(r, c, *(rng.normal(2 if c < 6 else -2, 1, 2)), 1 + int(c >= 6)) for r in range(H) for c in range(W)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["r", "c", "a", "b", "label"])).cache()


def _array(pixels):
    p = pixels.orderBy("r", "c").toPandas()
    return p[["a", "b"]].to_numpy().reshape(H, W, 2)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_windows_equal_slices(pixels, size):
    x, h = _array(pixels), size // 2
    got = {(r["r"], r["c"]): r["f"]["c0"] for r in images.window_covariances(pixels, ["a", "b"], size, H, W).collect()}
    assert len(got) == (H - 2 * h) * (W - 2 * h)
    order = images.exploded_windows(pixels, ["a", "b"], size, H, W)
    first = order.where((F.col("r") == h + 1) & (F.col("c") == h + 2)).orderBy("obs_idx").toPandas()[["a", "b"]].to_numpy()
    np.testing.assert_allclose(first, x[1 : 2 + 2 * h, 2 : 3 + 2 * h].reshape(-1, 2))
    for (r, c), v in got.items():
        w = x[r - h : r + h + 1, c - h : c + h + 1].reshape(-1, 2)
        np.testing.assert_allclose(np.reshape(v, (2, 2)), w.T @ w / len(w), atol=1e-10)


@pytest.mark.parametrize("how", ["row", "null"])
def test_windows_with_missing_pixels_have_no_feature(spark, pixels, how):
    """The same windows by sliding sums and exploded, of pixels without a row and with a null channel."""
    gone = ((F.col("r") == 0) & (F.col("c") == 0)) | ((F.col("r") == 4) & (F.col("c") == 7))
    holes = pixels.where(~gone) if how == "row" else pixels.withColumn("b", F.when(~gone, F.col("b")))
    x = _array(pixels)
    want = {(r, c) for r in range(1, H - 1) for c in range(1, W - 1) if not (r == c == 1) and not (abs(r - 4) < 2 and abs(c - 7) < 2)}
    mask = pixels.withColumn("mask", (F.col("r") + F.col("c")) % 3 == 0)
    for feature in (features.covariance(), features.user_defined("scm", lambda v: v @ v.T / v.shape[1], features.geo.PositiveDefinite(2))):
        got = images.window_features(holes, ["a", "b"], feature.bind(2, 9), 3, H, W)
        got = {(r["r"], r["c"]): (r["n"], r["f"]["c0"]) for r in got.collect()}
        assert set(got) == want, feature.name
        for (r, c), (n, v) in got.items():
            w = x[r - 1 : r + 2, c - 1 : c + 2].reshape(-1, 2)
            assert n == 9
            np.testing.assert_allclose(np.reshape(v, (2, 2)), w.T @ w / 9, atol=1e-10)
        masked = images.window_features(holes, ["a", "b"], feature.bind(2, 9), 3, H, W, mask=mask)
        assert {(r["r"], r["c"]) for r in masked.collect()} == {k for k in want if sum(k) % 3 == 0}
        assert {tuple(r["f"]["c0"]) for r in masked.collect()} <= {tuple(v) for _, v in got.values()}
    assert images.window_means(holes, ["a", "b"], 3, H, W).count() == len(want)
    tiny = spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 1, 1.0, 0.0), (2, 2, 1.0, 0.0)], "r int, c int, a double, b double")
    assert images.window_features(tiny, ["a", "b"], features.covariance().bind(2, 9), 3, 3, 3).count() == 0


@pytest.mark.parametrize("size, side", [(3, 4), (5, 5), (7, 100)])
def test_tiles_change_nothing(spark, pixels, size, side):
    """Every path at tiles smaller than the image (and than the window's reach) equals slices of the array, with and without a mask."""
    x, h = _array(pixels), size // 2
    mask = pixels.withColumn("mask", (F.col("r") * 2 + F.col("c")) % 3 == 0)
    want = {(r, c): x[r - h : r + h + 1, c - h : c + h + 1].reshape(-1, 2) for r in range(h, H - h) for c in range(h, W - h)}
    kinds = {
        "sums": (features.covariance(), lambda w: w.T @ w / len(w)),
        "centred": (features.covariance(assume_centered=False), lambda w: np.cov(w.T, bias=True)),
        "slices": (features.user_defined("scm", lambda v: v @ v.T / v.shape[1], features.geo.PositiveDefinite(2)), lambda w: w.T @ w / len(w)),
        "order": (features.identity_euclidean(), lambda w: w.T),
    }
    for name, (feature, of) in kinds.items():
        for m in (None, mask):
            got = images.window_features(pixels, ["a", "b"], feature.bind(2, size * size), size, H, W, mask=m, side=side).collect()
            assert len(got) == len({(r["r"], r["c"]) for r in got})
            assert {(r["r"], r["c"]) for r in got} == {k for k in want if m is None or (k[0] * 2 + k[1]) % 3 == 0}, name
            for r in got:
                assert r["n"] == size * size
                np.testing.assert_allclose(np.array(r["f"]["c0"]), of(want[r["r"], r["c"]]).ravel(), atol=1e-10)


def test_sums_of_long_rows_of_tiles(spark):
    """An image of one row of tiles, large values beside small ones, a repeated pixel, a NaN and an infinity."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 400)) + 100
    x[1, 50], x[0, 200] = np.nan, np.inf
    rows = [(r, c, float(x[r, c])) for r in range(3) for c in range(400)] + [(2, 300, 1.0)]
    df = spark.createDataFrame(rows, "r int, c int, a double")
    got = {r["c"]: r["m0"] for r in images.window_means(df, ["a"], 3, 3, 400, side=32).collect()}
    assert set(got) == set(range(1, 399)) - {49, 50, 51, 299, 300, 301}
    for c, m in got.items():
        if abs(c - 200) < 2:
            assert np.isnan(m)
        else:
            assert m == pytest.approx(x[:, c - 1 : c + 2].mean(), abs=1e-9)


def test_one_shuffle_and_no_whole_rows(spark, pixels):
    df = images.window_covariances(spark.createDataFrame(pixels.toPandas()), ["a", "b"], 5, H, W)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(_ti" in plan


def test_complex_windows_are_sliced_too(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(6, 7)) + 1j * rng.normal(size=(6, 7))
    df = spark.createDataFrame([(r, c, float(z[r, c].real), float(z[r, c].imag)) for r in range(6) for c in range(7)], "r long, c long, re double, im double")
    for side in (3, 50):
        f = images.window_features(df, [("re", "im")], features.identity_euclidean().bind(1, 9, True), 3, 6, 7, side=side)
        got = {(r["r"], r["c"]): np.array(r["f"]["c0"]["re"]) + 1j * np.array(r["f"]["c0"]["im"]) for r in f.collect()}
        assert len(got) == 4 * 5
        for (r, c), v in got.items():
            np.testing.assert_allclose(v, z[r - 1 : r + 2, c - 1 : c + 2].ravel())


def test_windows_apart_and_masked(pixels):
    apart = images.exploded_windows(pixels, ["a"], 3, H, W, overlapping=False).select("r", "c").distinct()
    assert {(r["r"], r["c"]) for r in apart.collect()} == {(r, c) for r in (1, 4, 7) for c in (1, 4, 7)}
    mask = images.build_mask(pixels, H, W, 3)
    f = images.window_features(pixels, ["a", "b"], features.covariance().bind(2, 9), 3, H, W, mask=mask)
    assert f.count() == 3 * 5
    with pytest.raises(ValueError):
        images.full_windows(5, 5, 2)


def test_centre_of_window_is_the_pixel(pixels):
    f = images.window_features(pixels, ["a", "b"], features.center_euclidean().bind(2, 9), 3, H, W)
    x = _array(pixels)
    for r in f.collect():
        np.testing.assert_allclose(r["f"]["c0"], x[r["r"], r["c"]])


def test_loading_steps(pixels):
    p = source.prepare(pixels, ["a", "b"], crop=True, border=1, center="column", crop_size=5)
    assert images.extent(p) == (5, 5)
    assert p.where("label >= 0").count() == 9
    assert abs(p.groupBy("c").agg(F.avg("a").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-12
    whole = images.remove_mean(pixels, ["a", "b"], "global")
    assert abs(whole.agg(F.avg("a")).first()[0]) < 1e-12
    with pytest.raises(NotImplementedError):
        source.Dataset("nowhere", "/tmp")
    assert source.Dataset("Pavia", "/data").info.bands == 103
    assert source.result_path("/x", "run").startswith("/x/results/run/")


def test_source_and_sink(spark, pixels, tmp_path):
    x = np.random.default_rng(1).standard_normal((4, 200))
    rows = [(k // 2, k % 2, x[k].tolist(), k % 3) for k in range(4)]
    spark.createDataFrame(rows, "r long, c long, x array<double>, label long").write.parquet(f"{tmp_path}/Indian_Pines.parquet")
    p = source.Dataset("Indian_Pines", str(tmp_path)).load(spark, center=None)
    assert len(p.columns) == 203 and p.agg(F.min("label")).first()[0] == -1
    source.save_segmentation(pixels.select("r", "c", F.col("label").alias("k")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == H * W


def test_evaluating_and_saving(spark, pixels, tmp_path):
    swapped = pixels.select("r", "c", (2 - F.col("label")).alias("k"))
    truth = pixels.select("r", "c", (F.col("label") - 1).alias("label"))
    assert source.evaluate_and_save(swapped, truth, f"{tmp_path}/seg")["oa"] == 1.0
    assert spark.read.parquet(f"{tmp_path}/seg").join(truth, ["r", "c"]).where("k <> label").count() == 0


def test_pca(pixels):
    x = _array(pixels).reshape(-1, 2)
    q = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1]
    got = images.pca(pixels, ["a", "b"], 2).orderBy("r", "c").toPandas()[["pc0", "pc1"]].to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ q), atol=1e-8)
    w, share = images.spectrum(pixels, ["a", "b"])
    np.testing.assert_allclose(w, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    assert share[-1] == pytest.approx(1)
    with pytest.raises(ValueError):
        images.pca(pixels, ["a", "b"], 3)


def test_datacube_clusters_halves(pixels):
    frame, criteria = learn.kmeans_datacube(pixels, ["a", "b"], features.mean_vector_euclidean(), 3, 2, n_init=2)
    assert frame.count() == (H - 2) * (W - 2) and len(criteria) == 2
    seg = frame.join(pixels, ["r", "c"]).select(F.col("k").alias("c"), (F.col("label") - 1).alias("gt"))
    assert evaluation.evaluate(seg)["oa"] > 0.85
    mask = images.build_mask(pixels, H, W, 3)
    masked, _ = learn.kmeans_datacube(pixels, ["a", "b"], features.mean_vector_euclidean(), 3, 2, mask=mask)
    assert masked.where("k >= 0").count() == 15
    full = learn.cluster_image(pixels, ["a", "b"], 2, learn.HyperparametersKMeans(feature="euclidean", mask=False, n_init=1))
    assert full.count() == H * W and full.where("k < 0").count() == 0


def test_streamed_covariance_equals_the_table(spark, tmp_path):
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(i % 5)) for i in range(60)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "v"]))
    table.write.parquet(f"{tmp_path}/in")
    stream = windowed_covariance(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), ["v"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cov").start()
    q.processAllAvailable()
    q.stop()
    a = {r["window_start"]: (r["n"], r["f"]["c0"][0]) for r in spark.table("cov").collect()}
    b = {r["window_start"]: (r["n"], r["f"]["c0"][0]) for r in windowed_covariance(table, ["v"]).collect()}
    assert a == b and len(a) == 3
