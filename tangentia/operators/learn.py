"""Nearest-centroid classification, K-means and tangent-space vectors over features.

Features are estimated once and persisted; every round sends K centroids out
and brings sums back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import checks
from tangentia.operators import images
from tangentia.operators.features import Feature, Means, _additive, by_label, gather
from tangentia.operators.nearest import is_metric
from tangentia.operators.tables import written


def _nearest(classes: list, d: str = "d") -> Column:
    """Class of the least distance; the first of equals."""
    at = F.array_position(d, F.array_min(d)) - 1
    return F.get(F.array(*[F.lit(c) for c in classes]), at.cast("int"))


def softmax_of_minus(d: str = "d") -> Column:
    e = F.transform(d, lambda x: F.exp(F.array_min(d) - x))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


@dataclass
class Centroids:
    """A fitted model: classes and their points."""

    feature: Feature
    classes: list
    points: list

    def transform(self, features: DataFrame) -> DataFrame:
        """``d``: distances to the centroids in order of the classes."""
        return self.feature.distances_to(features, self.points)

    def predict(self, features: DataFrame) -> DataFrame:
        return self.transform(features).withColumn("prediction", _nearest(self.classes))

    def predict_proba(self, features: DataFrame) -> DataFrame:
        """``proba``: softmax of minus the distances, in order of the classes."""
        return self.transform(features).withColumn("proba", softmax_of_minus())


class MDM:
    """Minimum distance to mean: the nearest of the classes' Frechet means."""

    def __init__(self, feature: Feature):
        checks.of_type("feature", feature, Feature)
        self.feature = feature

    def fit(self, features: DataFrame, label_col: str = "label") -> Centroids:
        means = self.feature.means(features, label_col)
        return Centroids(self.feature, list(means), list(means.values()))

    def fit_predict(self, features: DataFrame, label_col: str = "label") -> DataFrame:
        return self.fit(features, label_col).predict(features)


class TangentSpace:
    """Vectors of logarithms at the grand mean."""

    def __init__(self, feature: Feature):
        checks.of_type("feature", feature, Feature)
        self.feature, self.base = feature, None

    def fit(self, features: DataFrame) -> TangentSpace:
        self.base = self.feature.mean(features)
        return self

    def transform(self, features: DataFrame, out: str = "v") -> DataFrame:
        if self.base is None:
            raise ValueError("fit comes first")
        return self.feature.logs(features, self.base, out=out)

    def fit_transform(self, features: DataFrame, out: str = "v") -> DataFrame:
        return self.fit(features).transform(features, out)


@dataclass
class KMeansModel(Centroids):
    iterations: int = 0
    delta: float = np.inf
    criteria: list[list[float]] = field(default_factory=list)  # of every start
    distances: int | None = None  # computed by all starts of this one's fit, where they were counted


class KMeans:
    """Lloyd's algorithm with a feature's distance and mean.

    Starts from random rows, with ``init="k-means++"`` from the rows farthest from
    those chosen so far, or from the rows of the ids that ``init`` lists.  Ends when the criterion (sum of squared distances)
    changes by less than ``tol`` of itself; a criterion of 0 has converged.  An
    emptied cluster keeps its centroid, so cluster ids are stable.
    """

    def __init__(self, feature: Feature, n_clusters: int = 2, init: str | Sequence = "random", n_init: int = 10, max_iter: int = 100, tol: float = 1e-4, seed: int = 0, id_col: str = "id"):
        checks.positive("n_clusters", n_clusters)
        if isinstance(init, str):
            checks.one_of("init", init, ("random", "k-means++"))
        elif len(init) != n_clusters:
            raise ValueError("one id for each cluster")
        self.feature, self.k, self.init, self.n_init = feature, n_clusters, init, n_init
        self.max_iter, self.tol, self.seed, self.id_col = max_iter, tol, seed, id_col

    def _points(self, rows: list) -> list:
        return [self.feature.point(r["f"]) for r in rows]

    def _random(self, x: DataFrame, k: int, start: int) -> list:
        """k distinct rows, chosen by a hash of their ids: the same for any partitioning."""
        return self._points(x.orderBy(F.xxhash64(F.lit(f"{self.seed}/{start}"), F.col(self.id_col)), self.id_col).limit(k).select("f").collect())

    def initial(self, x: DataFrame, start: int = 0, first=None) -> list:
        """Points to start from; with ``first`` the farthest-first choice begins at the row of that id."""
        if not isinstance(self.init, str):
            rows = {r["k"]: r for r in x.where(F.col(self.id_col).isin(list(self.init))).select(F.col(self.id_col).alias("k"), "f").collect()}
            return self._points([rows[k] for k in self.init])
        if self.init == "random":
            return self._random(x, self.k, start)
        points = self._random(x, 1, start) if first is None else self._points(x.where(F.col(self.id_col) == first).select("f").collect())
        while len(points) < self.k:
            d = self.feature.distances_to(x, points)
            far = d.agg(F.max_by("f", F.struct(F.array_min("d"), -F.xxhash64(self.id_col)))).first()[0]
            if far is None:
                break
            points.append(self.feature.point(far))
        return points

    def fit(self, features: DataFrame) -> KMeansModel:
        x = features.select(self.id_col, "f").persist()
        try:
            best, criteria = None, []
            here = gather(self.feature, x, self.id_col)
            starts = [self.initial(x, start) for start in range(self.n_init)]
            if here is not None and here[1] is not None:
                models = [self._lloyd_here(here[1], first) for first in starts]
            elif is_metric(self.feature.geometry):
                models = self._lloyd_bounded(x, starts)
            else:
                models = [self._lloyd(x, first) for first in starts]
            for model in models:
                criteria.append(model.criteria[0])
                if best is None or model.criteria[0][-1] < best.criteria[0][-1]:
                    best = model
        finally:
            x.unpersist()
        best.criteria = criteria
        return best

    def _lloyd_here(self, x, points: list) -> KMeansModel:
        """The same rounds over few points, on the driver."""
        g, values, delta, it, used = self.feature.geometry, [], np.inf, 0, points
        n = len(x[0]) if isinstance(x, tuple) else len(x)
        for it in range(1, self.max_iter + 1):
            d = np.stack([np.broadcast_to(g.dist(m, x), (n,)) for m in points], axis=1)
            value, used = float((d.min(axis=1) ** 2).sum()), points
            if values:
                delta = abs(values[-1] - value) / values[-1] if values[-1] else 0.0
            values.append(value)
            if value == 0 or delta < self.tol or it == self.max_iter:
                break
            means = Means(self.feature, by_label(d.argmin(axis=1), x)).run(1000)
            points = [means.get(k, old) for k, old in enumerate(points)]
        return KMeansModel(self.feature, list(range(len(used))), used, it, float(delta), [values])

    def _lloyd(self, x: DataFrame, points: list) -> KMeansModel:
        values, delta, it, used = [], np.inf, 0, points
        for it in range(1, self.max_iter + 1):
            model = KMeansModel(self.feature, list(range(len(points))), points)
            d = model.predict(x).select(self.id_col, "f", F.array_min("d").alias("d"), F.col("prediction").alias("k"))
            d = d.persist()
            try:
                value = d.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
                used = points
                if values:
                    delta = abs(values[-1] - value) / values[-1] if values[-1] else 0.0
                values.append(float(value))
                if value == 0 or delta < self.tol or it == self.max_iter:
                    break
                means = self.feature.means(d, "k")
            finally:
                d.unpersist()
            points = [means.get(k, old) for k, old in enumerate(points)]
        return KMeansModel(self.feature, list(range(len(used))), used, it, float(delta), [values])

    def _lloyd_bounded(self, x: DataFrame, starts: list[list]) -> list[KMeansModel]:
        """The same rounds for all starts at once, one scan for each, in a metric.

        A row keeps, for each start, its cluster and a lower bound of its distance to every other centroid, which falls by the
        farthest move of a centroid.  While the distance to its own is below that, or below half of the way to the next centroid, no
        other is nearer, and none is computed.  A round writes the rows' new state, and beside it each task's criteria and sums.
        """
        g, n_starts, most = self.feature.geometry, len(starts), max(len(s) for s in starts)
        additive = self.feature.additive(g) if self.feature.additive else _additive(g)
        decode, encoded, id_col = self.feature.decode, self.feature.type, self.id_col
        kind = x.schema[id_col].dataType.simpleString()
        state = x.where("f is not null").select(F.col(id_col).alias("id"), "f", F.array(*[F.lit(-1)] * n_starts).alias("lab"), F.array(*[F.lit(0.0)] * n_starts).alias("lo"))
        points = [list(s) for s in starts]
        values, deltas, its, used = ([[] for _ in starts], [np.inf] * n_starts, [0] * n_starts, [list(s) for s in starts])
        moved, going, computed, context = [0.0] * n_starts, set(range(n_starts)), 0, x.sparkSession.sparkContext

        def many(ps: list):
            return tuple(np.stack(a) for a in zip(*ps, strict=True)) if isinstance(ps[0], tuple) else np.stack(ps)

        def to_all(p, ps: list) -> np.ndarray:
            return np.broadcast_to(np.real(g.dist(p, many(ps))), (len(ps),))

        for it in range(1, self.max_iter + 1):
            half = {s: [min([d for j, d in enumerate(to_all(p, points[s])) if j != c], default=np.inf) / 2 for c, p in enumerate(points[s])] for s in going}
            sent = context.broadcast((points, half, moved, sorted(going)))

            def run(batches, sent=sent):
                points, half, moved, active = sent.value
                total = {(s, c): [0, 0.0, 0.0] for s in active for c in range(len(points[s]))}
                seen, types = 0, None
                for batch in batches:
                    n = len(batch)
                    if not n:
                        continue
                    types = [batch.column(c).type for c in names[:4]]
                    f = decode(batch.column("f"))
                    lab = batch.column("lab").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()
                    lo = batch.column("lo").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()
                    stats = additive[0](f) if additive else None
                    for s in active:
                        ps, own, d = points[s], lab[:, s], np.full(n, np.inf)
                        low = np.maximum(lo[:, s] - moved[s], 0)
                        for c in range(len(ps)):
                            at = np.flatnonzero(own == c)
                            if len(at):
                                d[at] = g.dist(ps[c], _part(f, at))
                                low[at] = np.maximum(low[at], half[s][c])
                                seen += len(at)
                        new = np.flatnonzero((own < 0) | (d >= low * (1 - 1e-9)))
                        if len(new):
                            every = np.stack([np.broadcast_to(g.dist(p, _part(f, new)), (len(new),)) for p in ps], axis=1)
                            seen += len(new) * (len(ps) - 1)
                            own[new], d[new] = every.argmin(axis=1), every.min(axis=1)
                            every[np.arange(len(new)), own[new]] = np.inf
                            lo[new, s] = every.min(axis=1)
                            old = np.setdiff1d(np.arange(n), new)
                        else:
                            old = np.arange(n)
                        lo[old, s] = np.maximum(lo[old, s] - moved[s], 0)
                        for c in range(len(ps)):
                            at = own == c
                            t = total[s, c]
                            t[0] += int(at.sum())
                            t[1] += float((d[at] ** 2).sum())
                            if stats is not None:
                                t[2] = t[2] + stats[at].sum(axis=0)
                    nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))]
                    at = pa.array(np.arange(n + 1, dtype=np.int32) * n_starts)
                    lists = [pa.ListArray.from_arrays(at, pa.array(v), type=t) for v, t in ((lab.ravel().astype(np.int32), types[2]), (lo.ravel(), types[3]))]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("f"), *lists, *nothing], names)
                if types:
                    keys = list(total)
                    rows = [[s for s, _ in keys], [c for _, c in keys], [total[k][0] for k in keys], [total[k][1] for k in keys], [seen, *[0] * (len(keys) - 1)], [np.atleast_1d(total[k][2]).tolist() for k in keys]]
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(keys), t) for t in types], *[pa.array(r, t) for r, t in zip(rows, kinds, strict=True)]], names)

            names = ["id", "f", "lab", "lo", "start", "cluster", "n", "crit", "seen", "s"]
            out = written(state.mapInArrow(run, f"id {kind}, f {encoded}, lab array<int>, lo array<double>, start int, cluster int, n long, crit double, seen long, s array<double>"), "kmeans")
            state = out.where("start is null").select("id", "f", "lab", "lo")
            told = out.where("start is not null")
            sums = told.groupBy("start", "cluster").agg(F.sum("n").alias("n"), F.sum("crit").alias("crit"), F.sum("seen").alias("seen")).collect()
            sent.destroy()
            computed += sum(r["seen"] for r in sums)
            for s in sorted(going):
                value = float(sum(r["crit"] for r in sums if r["start"] == s))
                its[s], used[s] = it, points[s]
                if values[s]:
                    deltas[s] = abs(values[s][-1] - value) / values[s][-1] if values[s][-1] else 0.0
                values[s].append(value)
                if value == 0 or deltas[s] < self.tol or it == self.max_iter:
                    going.discard(s)
            if not going:
                break
            counts = {(r["start"], r["cluster"]): r["n"] for r in sums if r["n"] and r["start"] in going}
            if additive:
                flat = told.where(F.col("n") > 0).select("start", "cluster", F.posexplode("s").alias("i", "v")).groupBy("start", "cluster", "i").agg(F.sum("v").alias("v")).collect()
                stat = {k: np.zeros(1 + max(r["i"] for r in flat)) for k in counts}
                for r in flat:
                    if (r["start"], r["cluster"]) in stat:
                        stat[r["start"], r["cluster"]][r["i"]] = r["v"]
                means = {k: Means(self.feature, {})._cast(additive[1](v / counts[k])) for k, v in stat.items()}
            else:
                pairs = F.explode(F.filter(F.transform("lab", lambda c, s: s * most + c), lambda k: F.floor(k / most).isin(sorted(going))))
                found = self.feature.means(state.select("f", pairs.alias("k")), "k")
                means = {divmod(k, most): v for k, v in found.items()}
            for s in going:
                new = [means.get((s, c), old) for c, old in enumerate(points[s])]
                moved[s] = max(float(np.real(g.dist(a, b))) for a, b in zip(points[s], new, strict=True)) * (1 + 1e-9)
                points[s] = new
        return [
            KMeansModel(self.feature, list(range(len(used[s]))), used[s], its[s], float(deltas[s]), [values[s]], computed) for s in range(n_starts)
        ]

    def fit_predict(self, features: DataFrame) -> DataFrame:
        return self.fit(features).predict(features)


def _part(points, at: np.ndarray):
    return tuple(a[at] for a in points) if isinstance(points, tuple) else points[at]


def kmeans_datacube(
    pixels: DataFrame,
    channels: Sequence,
    feature: Feature,
    window_size: int,
    n_clusters: int,
    mask: DataFrame | None = None,
    init: str | Sequence = "random",
    n_init: int = 1,
    max_iter: int = 20,
    tol: float = 1e-2,
    seed: int = 0,
    complex_valued: bool = False,
) -> tuple[DataFrame, list[list[float]]]:
    """Clusters of the windows of an image: ``(r, c, k)`` with -1 outside the mask, and the criteria of all starts.

    Rows and columns are those of window centres; :func:`images.embed` puts them into the frame.
    """
    height, width = images.extent(pixels)
    bound = feature.bind(len(channels), window_size**2, complex_valued)
    f = images.window_features(pixels, channels, bound, window_size, height, width, mask=mask)
    f = f.withColumn("id", F.col("r") * width + F.col("c")).persist()
    try:
        model = KMeans(bound, n_clusters, init, n_init, max_iter, tol, seed).fit(f)
    finally:
        f.unpersist()
    found = model.predict(f).select("r", "c", F.col("prediction").alias("k"))
    h = window_size // 2
    frame = images.embed(found, height, width).where(
        F.col("r").between(h, height - 1 - h) & F.col("c").between(h, width - 1 - h)
    )
    return frame, model.criteria


@dataclass
class HyperparametersKMeans:
    """Settings of a clustering of a named image."""

    crop_image: bool = False
    n_experiments: int = 1
    pca: bool = False
    n_components: int | None = None
    mask: bool = True
    border_size: int = 0
    window_size: int = 7
    feature: Any = None
    init: str | Sequence = "random"
    n_init: int = 10
    max_iter: int = 100
    tol: float = 1e-4


def cluster_image(pixels: DataFrame, channels: Sequence[str], n_clusters: int, settings: HyperparametersKMeans, label: str = "label") -> DataFrame:
    """``(r, c, k)`` in the full frame for an image with ground truth; a feature ``"euclidean"`` clusters the pixels themselves."""
    height, width = images.extent(pixels)
    if settings.pca:
        pixels = images.pca(pixels, channels, settings.n_components or len(channels))
        channels = [f"pc{i}" for i in range(settings.n_components or len(channels))]
    mask = images.build_mask(pixels, height, width, settings.border_size, label) if settings.mask else None
    if settings.feature == "euclidean":
        from tangentia.operators.features import center_euclidean

        feature, size = center_euclidean(), 1
    else:
        feature, size = settings.feature, settings.window_size
    found, _ = kmeans_datacube(pixels, channels, feature, size, n_clusters, mask, settings.init, settings.n_init, settings.max_iter, settings.tol)
    return images.embed(found, height, width)
