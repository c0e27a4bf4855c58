"""Features: an estimator, a geometry and a strategy for means, over DataFrames.

A feature is made in two steps: ``covariance()`` is a prototype that
``bind(p, n)`` fixes for samples of p channels and n observations.  Bound features
live in a column ``f struct<c0, c1, ...>`` of row-major ``array<double>`` parts;
a complex part is ``struct<re, im>``.

Estimation uses built-in aggregates where the estimator is algebraic; other
estimators run on packed samples in Arrow batches.  Distances, logarithms and
means run the batched kernels of :mod:`tangentia.functions.geometry`, with few
base points broadcast and only sums coming back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.functions import checks, estimators
from tangentia.functions import geometry as geo
from tangentia.functions.matrix import hermitian_part, sqrtm
from tangentia.operators import estimate, robust, subspace, tables

#: Numbers of points up to which an iterative mean runs on the driver: rounds of a job each would cost more than they compute.
LOCAL_NUMBERS = 2_000_000
#: Numbers of a sample up to which a robust estimator takes it whole in one task; a longer one stays rows, and the estimator makes rounds over them.
PACKED_NUMBERS = 1 << 20
#: Most numbers of base points (classes times entries) that a closure carries to the workers.
CLOSURE_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Feature:
    """A feature's prototype, or a bound feature once ``p`` and ``n`` are set."""

    name: str
    estimator: Callable[[np.ndarray], Any]
    geometry_of: Callable[[int, int, bool], geo.Geometry]
    built_in: Callable[..., DataFrame] | None = None  # (samples, keys, channels, order)
    complex_built_in: Callable[..., DataFrame] | None = None
    least_gradient: float = 1e-6
    additive: Callable[[geo.Geometry], tuple[Callable, Callable] | None] | None = None
    needs_order: bool = False
    by_rounds: Callable[..., DataFrame] | None = None  # (samples, keys, channels, order), for samples of any length
    p: int = 0
    n: int = 0
    complex_valued: bool = False
    many: Callable[[list[np.ndarray]], Any] | None = None  # the estimator of a batch of samples at once
    options: dict = field(default_factory=dict)  # moments: those that the windows of an algebraic feature come from

    # -- binding and encoding

    def bind(self, p: int, n: int, complex_valued: bool = False) -> Feature:
        checks.positive("p", p)
        checks.positive("n", n)
        return replace(self, p=p, n=n, complex_valued=complex_valued)

    @property
    def geometry(self) -> geo.Geometry:
        if not self.p:
            raise KeyError(f"{self.name} is not bound to p and n")
        return self.geometry_of(self.p, self.n, self.complex_valued)

    @property
    def kinds(self) -> list[tuple[tuple[int, ...], bool]]:
        """Shape and complexity of each part."""
        g = self.geometry
        parts = getattr(g, "parts", [g])
        return [(p.shapes[0], p.complex_valued) for p in parts]

    @property
    def type(self) -> str:
        one = {False: "array<double>", True: "struct<re: array<double>, im: array<double>>"}
        return "struct<" + ", ".join(f"c{i}: {one[c]}" for i, (_, c) in enumerate(self.kinds)) + ">"

    def decode(self, column: pa.StructArray | pa.ChunkedArray):
        """A batch of points from an Arrow column."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()

        def flat(a) -> np.ndarray:
            return a.flatten().to_numpy(zero_copy_only=False)

        out = []
        for i, (shape, cplx) in enumerate(self.kinds):
            a = column.field(f"c{i}")
            x = flat(a.field("re")) + 1j * flat(a.field("im")) if cplx else flat(a)
            out.append(x.reshape(len(column), *shape))
        return tuple(out) if len(out) > 1 or isinstance(self.geometry, geo.Product) else out[0]

    def encode(self, points) -> pa.StructArray:
        parts = points if isinstance(points, tuple) else (points,)
        arrays = []
        for x, (shape, cplx) in zip(parts, self.kinds, strict=True):
            size = int(np.prod(shape))
            flat = np.asarray(x).reshape(-1, size)
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size)

            def listed(v, offsets=offsets) -> pa.ListArray:
                return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v, dtype=np.float64).ravel()))

            arrays.append(pa.StructArray.from_arrays([listed(flat.real), listed(flat.imag)], ["re", "im"]) if cplx else listed(flat.real))
        return pa.StructArray.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    def point(self, row) -> Any:
        """A point from a collected ``f`` value."""
        out = []
        for i, (shape, cplx) in enumerate(self.kinds):
            v = row[f"c{i}"]
            out.append((np.array(v["re"]) + 1j * np.array(v["im"]) if cplx else np.array(v, dtype=float)).reshape(shape))
        return tuple(out) if len(out) > 1 or isinstance(self.geometry, geo.Product) else out[0]

    # -- estimation

    def estimation(self, x: np.ndarray):
        """The feature of one p x n matrix."""
        return self.estimator(x)

    def estimate(self, samples: DataFrame, keys: Sequence[str], channels: Sequence, order: Sequence[str] = (), rounds: bool | str | None = None) -> DataFrame:
        """``(keys, n, f)`` from observations in long form; complex channels are (re, im) pairs of columns.

        Features with a part as long as the sample, and those that pick an
        observation, need ``order``, a total order within a sample.  Robust estimators gather samples of up to
        ``PACKED_NUMBERS`` numbers and make rounds over the rows of longer ones, with the same result; ``rounds`` decides otherwise.
        With ``"long"`` the samples are counted first, and only those that are too long make rounds, however long the others were bound to be;
        observations with a channel that is null or NaN take no part.
        """
        if self.needs_order and not order:
            raise ValueError(f"{self.name} needs the order of the observations")
        if self.complex_valued and self.complex_built_in:
            return self.complex_built_in(samples, keys, channels)
        if not self.complex_valued and self.built_in:
            return self.built_in(samples, keys, channels, order)
        if self.by_rounds and rounds == "long":
            return self._by_length(samples, keys, channels, list(order))
        if self.by_rounds and (self.p * self.n > PACKED_NUMBERS if rounds is None else rounds):
            return self.by_rounds(samples, keys, channels, list(order))
        flat = [c for pair in channels for c in pair] if self.complex_valued else list(channels)
        return self.estimate_packed(estimate.packed(samples, keys, flat, list(order) or flat), keys)

    def _by_length(self, samples: DataFrame, keys: Sequence[str], channels: Sequence, order: list[str]) -> DataFrame:
        flat = [c for pair in channels for c in pair] if self.complex_valued else list(channels)
        samples = samples.dropna(subset=flat)
        names = {k: f"_long_{k}" for k in keys}
        sizes = samples.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > PACKED_NUMBERS // len(flat))
        long = tables.written(sizes.drop("_n").withColumnsRenamed(names), "long")  # few: each has so many observations
        if not long.limit(1).count():
            return self.estimate(samples, keys, channels, order, rounds=False)
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{v}`")) for k, v in names.items()]
        short, rest = (samples.join(F.broadcast(long), same, how) for how in ("left_anti", "left_semi"))
        return self.estimate(short, keys, channels, order, rounds=False).unionByName(self.by_rounds(rest, keys, channels, order).select(*keys, "n", "f"))

    def estimate_packed(self, packed: DataFrame, keys: Sequence[str]) -> DataFrame:
        """From rows ``(keys, n, f.c0)`` of packed p x n matrices (2p rows, re and im in turn, if complex)."""
        rows = 2 * self.p if self.complex_valued else self.p
        own, schema = list(keys), packed.select(*keys, "n").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = batch.column("f").field("c0")
                samples = [data[i].values.to_numpy(zero_copy_only=False).reshape(rows, -1) for i in range(len(batch))]
                if self.complex_valued:
                    samples = [x[::2] + 1j * x[1::2] for x in samples]
                points = [] if self.many else [self.estimator(x) for x in samples]
                if samples:
                    many = self.many(samples) if self.many else tuple(np.stack(z) for z in zip(*points, strict=True)) if isinstance(points[0], tuple) else np.stack(points)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k) for k in own], batch.column("n"), self.encode(many)], [*own, "n", "f"]
                    )

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return packed.mapInArrow(run, f"{fields}, f {self.type}")

    # -- geometry over DataFrames

    def _with(self, df: DataFrame, f_col: str, name: str, kind: str, run: Callable[[Any], pa.Array]) -> DataFrame:
        """``df`` with a column computed from the points of ``f_col``, batch by batch."""
        names = [c for c in df.columns if c != name]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in names]).schema.fields)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    out = run(self.decode(batch.column(f_col)))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], out], [*names, name])

        return df.select(*[f"`{c}`" for c in names]).mapInArrow(go, f"{fields}, `{name}` {kind}")

    def _check(self, points: list) -> None:
        size = sum(np.size(a) for p in points for a in (p if isinstance(p, tuple) else (p,)))
        if size > CLOSURE_NUMBERS:
            raise ValueError(f"{size} numbers of base points are too many to carry to the workers; work in blocks of them")

    def distances_to(self, df: DataFrame, points: list, f_col: str = "f", out: str = "d") -> DataFrame:
        """``out array<double>``: distance from each of ``points`` (first argument) to the row's point."""
        if not self.geometry.has_dist:
            raise NotImplementedError(f"{self.name} has no distance")
        self._check(points)
        g = self.geometry

        def run(x) -> pa.Array:
            d = np.stack([np.broadcast_to(g.dist(m, x), (_len(x),)) for m in points], axis=1)
            return _lists(d)

        return self._with(df, f_col, out, "array<double>", run)

    def component_distances_to(self, df: DataFrame, point, f_col: str = "f", out: str = "d") -> DataFrame:
        """``out array<double>``: total distance from ``point`` to the row's point, then those of the parts of a product, unweighted."""
        g = self.geometry

        def run(x) -> pa.Array:
            return _lists(np.stack([np.broadcast_to(d, (_len(x),)) for d in g.dists(point, x)], axis=1))

        return self._with(df, f_col, out, "array<double>", run)

    def distances(self, x, y) -> list[float]:
        """Total distance, then those of the parts of a product, unweighted."""
        return [float(d) for d in self.geometry.dists(x, y)]

    def distance(self, x, y) -> float:
        return float(self.geometry.dist(x, y))

    def logs(self, df: DataFrame, base, f_col: str = "f", out: str = "v") -> DataFrame:
        """``out array<double>``: flattened logarithm of every row's point at ``base`` (re then im if complex)."""
        g = self.geometry
        if not g.has_log:
            raise NotImplementedError(f"{self.name} has no logarithm")

        def run(x) -> pa.Array:
            v = g.vectorize(g.log(_tile(base, _len(x)), x))
            return _lists(np.concatenate([v.real, v.imag], axis=-1) if np.iscomplexobj(v) else v)

        return self._with(df, f_col, out, "array<double>", run)

    def vectorized(self, df: DataFrame, f_col: str = "f", out: str = "v") -> DataFrame:
        """``out array<double>``: parts flattened side by side; of Hermitian parts the upper triangle."""
        g = self.geometry

        def run(x) -> pa.Array:
            v = g.vectorize(x)
            return _lists(np.concatenate([v.real, v.imag], axis=-1) if np.iscomplexobj(v) else v)

        return self._with(df, f_col, out, "array<double>", run)

    # -- means

    def means(self, df: DataFrame, label_col: str | None = None, f_col: str = "f", max_iter: int = 1000) -> dict[Any, Any]:
        """Frechet mean of every label (one label None without ``label_col``), in order of the labels.

        Closed forms take one pass over the rows; geometries with a logarithm
        a pass for each step of a fixed-step descent; divergences a pass for each
        gradient, in closed form, and one for each line search.  Only sums leave the workers.
        """
        return Means(self, df, label_col, f_col).run(max_iter)

    def mean(self, df: DataFrame, f_col: str = "f") -> Any:
        return self.means(df, None, f_col).get(None)


def gather(feature: Feature, df: DataFrame, key: str, f_col: str = "f") -> tuple[np.ndarray, Any] | None:
    """Keys and points of all rows if they are at most ``LOCAL_NUMBERS`` numbers together, else None."""
    width = sum(int(np.prod(s)) * (1 + c) for s, c in feature.kinds)
    rows = df.select(F.col(key).alias("k"), F.col(f_col).alias("f"))
    table = rows.limit(LOCAL_NUMBERS // width + 1).toArrow()
    if len(table) * width > LOCAL_NUMBERS:
        return None
    keys = np.array(table.column("k").to_pylist(), dtype=object)
    return keys, feature.decode(table.column("f")) if len(table) else None


def by_label(labels: np.ndarray, points) -> dict[Any, Any]:
    out = {}
    for label in dict.fromkeys(labels):
        at = np.array([v == label for v in labels])
        out[label] = tuple(a[at] for a in points) if isinstance(points, tuple) else points[at]
    return out


def _len(x) -> int:
    return len(x[0]) if isinstance(x, tuple) else len(x)


def _tile(point, n: int):
    return tuple(_tile(a, n) for a in point) if isinstance(point, tuple) else np.broadcast_to(point, (n, *np.shape(point)))


def _lists(a: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(a, dtype=np.float64).ravel()))


def _real(u) -> np.ndarray:
    """Real coordinates (batch, d) of arrays or tuples of them."""
    if isinstance(u, tuple):
        return np.concatenate([_real(a) for a in u], axis=1)
    u = u.reshape(len(u), -1)
    return np.concatenate([u.real, u.imag], axis=1) if np.iscomplexobj(u) else u


def _unreal(v: np.ndarray, kinds: list[tuple[tuple[int, ...], bool]], one: bool):
    out, at = [], 0
    for shape, cplx in kinds:
        size = int(np.prod(shape))
        x = v[at : at + size]
        at += size
        if cplx:
            x = x + 1j * v[at : at + size]
            at += size
        out.append(x.reshape(shape))
    return out[0] if one else tuple(out)


class Means:
    """Means of the labels of a DataFrame, or of points at hand (a dict of label to points)."""

    def __init__(self, feature: Feature, df: DataFrame | dict[Any, Any], label_col: str | None = None, f_col: str = "f"):
        self.f, self.g, self.kinds = feature, feature.geometry, feature.kinds
        self.one = not isinstance(self.g, geo.Product)
        self.labelled, self.rows, self.local = True, None, None
        if isinstance(df, dict):
            self.local = df
            return
        self.rows = df.select(
            (F.col(label_col) if label_col else F.lit(0)).alias("label"), F.col(f_col).alias("f")
        ).where(F.col("f").isNotNull())
        self.labelled = label_col is not None
        self.label_type = self.rows.schema["label"].dataType.simpleString()

    def sums(self, fn: Callable[[Any, Any], np.ndarray], extra: dict | None = None) -> dict[Any, tuple[int, np.ndarray]]:
        """Per label the number of rows and the sum of ``fn(points, extra[label])``, rows of real coordinates."""
        if self.local is not None:
            return {
                k: (_len(x), fn(x, None if extra is None else extra[k]).sum(axis=0))
                for k, x in self.local.items()
                if extra is None or k in extra
            }
        decode = self.f.decode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[Any, list] = {}
            kind = None
            for batch in batches:
                kind = batch.column("label").type
                labels = np.array(batch.column("label").to_pylist(), dtype=object)
                points = decode(batch.column("f"))
                for label in dict.fromkeys(labels):
                    if extra is not None and label not in extra:
                        continue
                    at = np.array([v == label or (v is None and label is None) for v in labels])
                    mine = tuple(a[at] for a in points) if isinstance(points, tuple) else points[at]
                    s = fn(mine, None if extra is None else extra[label]).sum(axis=0)
                    if label in totals:
                        totals[label][0] += int(at.sum())
                        totals[label][1] = totals[label][1] + s
                    else:
                        totals[label] = [int(at.sum()), s]
            if totals:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(totals), kind),
                        pa.array([t[0] for t in totals.values()], pa.int64()),
                        pa.array([t[1].tolist() for t in totals.values()], pa.list_(pa.float64())),
                    ],
                    ["label", "n", "s"],
                )

        parts = self.rows.mapInArrow(run, f"label {self.label_type}, n long, s array<double>")
        flat = parts.select("label", "n", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        got = flat.groupBy("label").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).collect()
        return {r["label"]: (r["n"], np.array([x["v"] for x in r["s"]])) for r in got}

    def run(self, max_iter: int) -> dict[Any, Any]:
        additive = self.f.additive(self.g) if self.f.additive else _additive(self.g)
        if additive is not None:
            stat, back = additive
            out = {k: back(s / n) for k, (n, s) in self.sums(lambda x, _: stat(x)).items()}
        elif self.local is not None:
            out = self._descend(self._start(), max_iter)
        else:
            self.rows = self.rows.persist()
            try:
                self._gather()
                out = self._descend(self._start(), max_iter)
            finally:
                self.rows.unpersist()
        out = {k: self._cast(v) for k, v in out.items()}
        labels = sorted((k for k in out if k is not None), key=lambda k: (str(type(k)), k))
        ordered = {k: out[k] for k in labels} | ({None: out[None]} if None in out else {})
        return ordered if self.labelled else {None: v for v in ordered.values()}

    def _gather(self) -> None:
        """Brings the points here if they are few."""
        found = gather(self.f, self.rows, "label")
        if found is not None:
            self.local = by_label(*found)

    def _cast(self, point):
        parts = point if isinstance(point, tuple) else (point,)
        parts = tuple(a if c else np.real(a) for a, (_, c) in zip(parts, self.kinds, strict=True))
        return parts[0] if self.one else parts

    def _start(self) -> dict[Any, Any]:
        """Componentwise means where they stay in the geometry; for subspaces the top of the mean projector, so no order matters."""
        parts = getattr(self.g, "parts", [self.g])
        spaces = [getattr(p, "base", p) for p in parts]

        def stat(x, _):
            out = []
            for a, p in zip(x if isinstance(x, tuple) else (x,), spaces, strict=True):
                if isinstance(p, geo.Grassmann):
                    out.append(a @ np.conj(np.swapaxes(a, -1, -2)))
                else:
                    out.append(np.log(a) if isinstance(p, geo.Positive) else a)
            return _real(tuple(out))

        start = {}
        for label, (n, s) in self.sums(stat).items():
            shapes = [((p.shapes[0][0],) * 2 if isinstance(p, geo.Grassmann) else p.shapes[0], p.complex_valued) for p in spaces]
            point = []
            for a, p in zip(_unreal(s / n, shapes, False), spaces, strict=True):
                if isinstance(p, geo.Grassmann):
                    a = estimators.top_subspace(hermitian_part(a), p.shapes[0][1])
                elif isinstance(p, geo.Positive):
                    a = p.mean(np.exp(a)[None])
                elif isinstance(p, geo.UnitDeterminant):
                    a = geo.unit_det(hermitian_part(a))[0]
                point.append(a)
            start[label] = point[0] if self.one else tuple(point)
        return start

    def _descend(self, at: dict[Any, Any], max_iter: int) -> dict[Any, Any]:
        return self._by_logs(at, max_iter) if self.g.has_log else self._by_gradients(at, max_iter)

    def _by_logs(self, at: dict[Any, Any], max_iter: int) -> dict[Any, Any]:
        g, open_, rate = self.g, dict(at), 1.0
        for it in range(max_iter):
            if not open_:
                break
            rate *= 0.1 if it in (250, 750) else 1
            got = self.sums(lambda x, m: _real(g.log(_tile(m, _len(x)), x)), dict(open_))
            for label, (n, s) in got.items():
                step = _unreal(s / n, self.kinds, self.one)
                if float(g.norm(open_[label], step)) <= self.f.least_gradient:
                    open_.pop(label)
                    continue
                moved = tuple(rate * a for a in step) if isinstance(step, tuple) else rate * step
                at[label] = open_[label] = g.exp(open_[label], moved)
        return at

    def _by_gradients(self, at: dict[Any, Any], max_iter: int) -> dict[Any, Any]:
        g, open_, steps = self.g, dict(at), dict.fromkeys(at, 1.0)
        width = objective_width(g)

        def scaled(u, a):
            return tuple(a * x for x in u) if isinstance(u, tuple) else a * u

        def costs(x, points):
            return np.concatenate([objective_terms(g, m, x) for m in points], axis=1)

        def slopes(x, m):
            return np.concatenate([objective_terms(g, m, x), *[_real(u) for u in objective_gradients(g, m, x)]], axis=1)

        for _ in range(max_iter):
            if not open_:
                break
            tries, falls, now = {}, {}, {}
            for k, (n, s) in self.sums(slopes, dict(open_)).items():
                parts = np.split(s[width:], width)
                euclidean = combined(g, s[:width], [_unreal(v, self.kinds, self.one) for v in parts], n)
                d = g.egrad2rgrad(open_[k], euclidean)
                size = float(g.norm(open_[k], d))
                if not size > max(self.f.least_gradient, 1e-9):
                    open_.pop(k)
                    continue
                ts = [steps[k] * 2 / size * 0.5**j for j in range(10)]
                tries[k] = (ts, [g.retract(open_[k], scaled(d, -t)) for t in ts])
                falls[k], now[k] = size * size, float(objective(g, s[None, :width], n)[0])
            if not tries:
                continue
            got = self.sums(costs, {k: t[1] for k, t in tries.items()})
            for k, (n, s) in got.items():
                f = objective(g, s.reshape(-1, width), n)
                ts, points = tries[k]
                ok = [j for j in range(len(ts)) if f[j] <= now[k] - 1e-4 * ts[j] * falls[k]]
                best = min(ok, key=lambda j: f[j]) if ok else int(np.argmin(f))
                if not f[best] < now[k]:
                    steps[k] *= 0.5**10
                    if steps[k] < 1e-8:
                        open_.pop(k)
                    continue
                steps[k] = min(4.0, ts[best] * np.sqrt(falls[k]))
                at[k] = open_[k] = points[best]
        return at


def objective_width(g) -> int:
    return 2 if _mixes_exponents(g) and "sym" in g.divergence else 1


def _mixes_exponents(g) -> bool:
    return isinstance(g, geo.CompoundUnitTextures) and g.alpha not in (0, 1) and "alpha" in g.divergence


def objective_terms(g, m, x) -> np.ndarray:
    """What is summed over the rows for the objective at ``m``: squared distances, or integrals for compound alpha divergences."""
    if not _mixes_exponents(g):
        return np.atleast_1d(g.dist(m, x))[:, None] ** 2
    half = 0.5 if "real" in g.divergence else 1.0
    terms = [np.exp(half * g.log_integral(m, x))]
    if "sym" in g.divergence:
        terms.append(np.exp(half * g.log_integral(x, m)))
    return np.stack(terms, axis=1)


def objective_gradients(g, m, x) -> list:
    """Euclidean gradients at ``m`` of the columns of :func:`objective_terms`."""
    m = _tile(m, _len(x))
    if not _mixes_exponents(g):
        return [g.squared_gradient(m, x)]
    half = 0.5 if "real" in g.divergence else 1.0

    def one(y, z, second: bool):
        i = half * np.exp(half * g.log_integral(y, z))
        return tuple(i.reshape(-1, *[1] * (u.ndim - 1)) * u for u in g.log_integral_gradient(y, z, second))

    return [one(m, x, False), one(x, m, True)] if "sym" in g.divergence else [one(m, x, False)]


def combined(g, terms: np.ndarray, gradients: list, n: int):
    """Gradient of :func:`objective` from the sums of terms and of their gradients."""
    weights = -1 / np.maximum(terms, 1e-300) / len(terms) if _mixes_exponents(g) else np.full(1, 1 / (2 * n))
    many = [u if isinstance(u, tuple) else (u,) for u in gradients]
    out = tuple(sum(w * a for w, a in zip(weights, parts, strict=True)) for parts in zip(*many, strict=True))
    return out if isinstance(gradients[0], tuple) else out[0]


def objective(g, sums: np.ndarray, n: int) -> np.ndarray:
    """Half the mean squared distance; for compound alpha divergences minus the logarithm of the mean integral."""
    if not _mixes_exponents(g):
        return sums[:, 0] / (2 * n)
    return -np.log(np.maximum(sums / n, 1e-300)).mean(axis=1)


def _additive(g: geo.Geometry) -> tuple[Callable, Callable] | None:
    """A statistic whose average gives the mean in closed form, and the way back; None where there is none."""
    parts = getattr(g, "parts", [g])
    if isinstance(g, geo._Divergences) or not all(type(p) in (geo.Geometry, geo.Euclidean, geo.Positive, geo.UnitProduct) for p in parts):
        return None
    kinds = [(p.shapes[0], p.complex_valued) for p in parts]
    one = not isinstance(g, geo.Product)

    def stat(x):
        return _real(tuple(np.log(a) if isinstance(p, geo.Positive) else a for a, p in zip((x,) if one else x, parts, strict=True)))

    def back(s):
        out = [p.mean(np.exp(a)[None]) if isinstance(p, geo.Positive) else a for a, p in zip(_unreal(s, kinds, False), parts, strict=True)]
        return out[0] if one else tuple(out)

    return stat, back


def _gaussian_additive(g) -> tuple[Callable, Callable] | None:
    """Closed forms of Kullback-Leibler means of Gaussians: alpha 0 averages inverses, alpha 1 moments."""
    name, alpha = g.divergence, g.alpha
    if name not in ("alpha", "alpha_real") or alpha not in (0, 1):
        return None
    kinds = [(p.shapes[0], p.complex_valued) for p in g.parts]

    def stat(x):
        m, s = x
        if alpha == 1:
            return _real((m, s + m[..., :, None] * np.conj(m)[..., None, :]))
        i = np.linalg.inv(s)
        return _real(((i @ m[..., None])[..., 0], i))

    def back(v):
        a, b = _unreal(v, kinds, False)
        if alpha == 1:
            return a, hermitian_part(b - a[:, None] * np.conj(a)[None, :])
        s = hermitian_part(np.linalg.inv(b))
        return s @ a, s

    return stat, back


def _covariance_additive(g) -> tuple[Callable, Callable] | None:
    """Arithmetic, harmonic, or the geometric mean of both."""
    name, alpha = g.gauss.divergence, g.gauss.alpha
    if alpha not in (0, 1):
        return None
    kinds = [(g.shapes[0], g.complex_valued)] * 2

    def stat(x):
        return _real((x, np.linalg.inv(x)))

    def back(v):
        a, h = _unreal(v, kinds, False)
        a, h = hermitian_part(a), hermitian_part(np.linalg.inv(h))
        if "sym" in name:
            r = sqrtm(a)
            i = np.linalg.inv(r)
            return hermitian_part(r @ sqrtm(hermitian_part(i @ h @ i)) @ r)
        return a if alpha == 1 else h

    return stat, back


# -- the features

def _name(real_case: bool, symmetrize: bool) -> str:
    return "alpha" + ("_sym" if symmetrize else "") + ("_real" if real_case else "")


def _mid(x: np.ndarray) -> np.ndarray:
    return x[:, x.shape[1] // 2]


def identity_euclidean() -> Feature:
    return Feature("identity_euclidean", lambda x: x, lambda p, n, c: geo.Euclidean(p, n, complex_valued=c), needs_order=True)


def center_euclidean() -> Feature:
    return Feature("center_euclidean", _mid, lambda p, n, c: geo.Euclidean(p, complex_valued=c), estimate.center_observation, needs_order=True)


def center_intensity_euclidean() -> Feature:
    return Feature("center_intensity_euclidean", lambda x: np.array([np.linalg.norm(_mid(x))]), lambda p, n, c: geo.Euclidean(1), estimate.center_intensity, needs_order=True)


def mean_vector_euclidean() -> Feature:
    return Feature("mean_vector_euclidean", lambda x: x.mean(axis=1), lambda p, n, c: geo.Euclidean(p, complex_valued=c), lambda s, k, ch, o: estimate.mean_vector(s, k, ch), options={"moments": "mean"})


def intensity_vector_euclidean() -> Feature:
    return Feature("intensity_vector_euclidean", lambda x: np.linalg.norm(x, axis=0), lambda p, n, c: geo.Euclidean(n), estimate.intensities, needs_order=True)


def _scm_parts(assume_centered: bool) -> dict:
    return {
        "estimator": lambda x: estimators.scm(x, assume_centered),
        "built_in": lambda s, k, ch, o: estimate.covariance(s, k, ch, assume_centered),
        "complex_built_in": lambda s, k, ch: estimate.complex_covariance(s, k, ch, assume_centered),
        "options": {"moments": "second" if assume_centered else "centred"},
    }


def covariance(assume_centered: bool = True, least_gradient: float = 1e-8) -> Feature:
    return Feature("covariance", geometry_of=lambda p, n, c: geo.PositiveDefinite(p, c), least_gradient=least_gradient, **_scm_parts(assume_centered))


def covariance_euclidean(assume_centered: bool = True) -> Feature:
    return Feature("covariance_euclidean", geometry_of=lambda p, n, c: geo.Euclidean(p, p, complex_valued=c), **_scm_parts(assume_centered))


def covariance_div_alpha(assume_centered: bool = True, real_case: bool = False, symmetrize: bool = False, alpha: float = 0.5, least_gradient: float = 1e-7) -> Feature:
    return Feature(
        "covariance_div_alpha",
        geometry_of=lambda p, n, c: geo.CovarianceAlpha(p, c, _name(real_case, symmetrize), alpha),
        least_gradient=least_gradient, additive=_covariance_additive, **_scm_parts(assume_centered),
    )


def covariance_texture(weights=None, least_gradient: float = 1e-8, **options) -> Feature:
    def rounds(s, k, ch, o) -> DataFrame:
        return robust.tyler(s, k, ch, carry=o, **options).features(["sigma"], o, textures_at=1)

    return Feature(
        "covariance_texture", lambda x: estimators.tyler(x, **options),
        lambda p, n, c: geo.Product([geo.UnitDeterminant(p, c), geo.Positive(n)], weights or (1 / p, 1 / n)),
        least_gradient=least_gradient, needs_order=True, by_rounds=None if "start" in options else rounds,
        many=None if "start" in options else estimators.by_length(lambda x: estimators.tyler_many(x, **options)),
    )


def _location(name: str, divergence: str, alpha: float, least_gradient: float) -> Feature:
    return Feature(
        name, estimators.gaussian, lambda p, n, c: geo.GaussianIG(p, c, divergence, alpha),
        lambda s, k, ch, o: estimate.gaussian(s, k, ch), least_gradient=least_gradient, additive=_gaussian_additive, options={"moments": "gaussian"},
    )


def location_covariance_orth_triangle(least_gradient: float = 1e-6) -> Feature:
    return _location("location_covariance_orth_triangle", "orth", 0.5, least_gradient)


def location_covariance_scale_triangle(least_gradient: float = 1e-6) -> Feature:
    return _location("location_covariance_scale_triangle", "scale", 0.5, least_gradient)


def location_covariance_div_alpha(alpha: float = 0.5, real_case: bool = False, symmetrize: bool = False, least_gradient: float = 1e-6) -> Feature:
    return _location("location_covariance_div_alpha", _name(real_case, symmetrize), alpha, least_gradient)


def _three(name: str, estimator: Callable, unit: str, weights, least_gradient: float = 1e-6, many: Callable | None = None) -> Feature:
    def space(p: int, n: int, c: bool) -> geo.Geometry:
        middle, last = (geo.UnitDeterminant(p, c), geo.Positive(n)) if unit == "scatter" else (geo.PositiveDefinite(p, c), geo.UnitProduct(n))
        return geo.Product([geo.Euclidean(p, complex_valued=c), middle, last], weights)

    return Feature(name, estimator, space, least_gradient=least_gradient, needs_order=True, many=many)


def location_covariance_texture_Gaussian_constrained_scatter(weights=(1, 1, 1)) -> Feature:  # noqa: N802
    return _three("location_covariance_texture_Gaussian_constrained_scatter", estimators.gaussian_unit_scatter, "scatter", weights)


def location_covariance_texture_Tyler_constrained_scatter(weights=(1, 1, 1), **options) -> Feature:  # noqa: N802
    def rounds(s, k, ch, o) -> DataFrame:
        return robust.location_scatter(s, k, ch, carry=o, **options).features(["mu", "sigma"], o, textures_at=2)

    three = _three("location_covariance_texture_Tyler_constrained_scatter", lambda x: estimators.joint_tyler(x, **options), "scatter", weights)
    return replace(three, by_rounds=rounds, many=estimators.by_length(lambda x: estimators.joint_tyler_many(x, **options)))


def location_covariance_texture_constrained_scatter(max_iter: int = 30_000, information_geometry: bool = True, solver: str = "steepest", weights=(1, 1, 1)) -> Feature:
    return _three(
        "location_covariance_texture_constrained_scatter",
        lambda x: estimators.compound(x, "scatter", max_iter, information_geometry, solver), "scatter", weights,
        many=estimators.by_length(lambda x: estimators.compound_many(x, "scatter", max_iter, information_geometry, solver)),
    )


def location_covariance_texture_Gaussian_constrained_texture(weights=(1, 1, 1)) -> Feature:  # noqa: N802
    return _three("location_covariance_texture_Gaussian_constrained_texture", estimators.gaussian_unit_textures, "textures", weights)


def _regularized(max_iter: int, information_geometry: bool, solver: str, penalty: str, beta: float, kappa) -> Callable:
    return lambda x: estimators.compound(x, "textures", max_iter, information_geometry, solver, penalty, beta, kappa)


def _regularized_many(*how) -> Callable:
    return estimators.by_length(lambda x: estimators.compound_many(x, "textures", *how))


def location_covariance_texture_constrained_texture(
    max_iter: int = 300, information_geometry: bool = True, solver: str = "steepest", penalty: str = "AF", beta: float = 0.0, kappa="trace_SCM", weights=(1, 1, 1)
) -> Feature:
    return _three(
        "location_covariance_texture_constrained_texture",
        _regularized(max_iter, information_geometry, solver, penalty, beta, kappa), "textures", weights,
        many=_regularized_many(max_iter, information_geometry, solver, penalty, beta, kappa),
    )


def location_covariance_texture_constrained_texture_triangle(
    max_iter: int = 300, information_geometry: bool = True, solver: str = "steepest", penalty: str = "AF", beta: float = 0.0, kappa="trace_SCM",
    divergence: str = "orth", weights=(1, 1), least_gradient: float = 1e-6,
) -> Feature:
    return Feature(
        "location_covariance_texture_constrained_texture_triangle",
        _regularized(max_iter, information_geometry, solver, penalty, beta, kappa),
        lambda p, n, c: geo.CompoundTriangle(p, n, c, weights, divergence), least_gradient=least_gradient, needs_order=True,
        additive=lambda g: None, many=_regularized_many(max_iter, information_geometry, solver, penalty, beta, kappa),
    )


def location_covariance_texture_constrained_texture_div_alpha(
    max_iter: int = 300, information_geometry: bool = True, solver: str = "steepest", penalty: str = "AF", beta: float = 0.0, kappa="trace_SCM",
    alpha: float = 0.5, real_case: bool = False, symmetrize: bool = False, least_gradient: float = 1e-6,
) -> Feature:
    return Feature(
        "location_covariance_texture_constrained_texture_div_alpha",
        _regularized(max_iter, information_geometry, solver, penalty, beta, kappa),
        lambda p, n, c: geo.CompoundUnitTextures(p, n, c, _name(real_case, symmetrize), alpha),
        least_gradient=least_gradient, needs_order=True, additive=lambda g: None,
        many=_regularized_many(max_iter, information_geometry, solver, penalty, beta, kappa),
    )


def _subspace_rounds(k: int, textured: bool, **how) -> Callable[..., DataFrame]:
    """For samples too long to be packed, or of too many channels: rounds over the rows."""

    def run(samples: DataFrame, keys: Sequence[str], channels: Sequence, order: Sequence[str]) -> DataFrame:
        vector = subspace.vector_of(channels)
        if "batches" in how:
            found = subspace.descend(samples, keys, vector, k, order, **how)
        else:
            found = subspace.top_subspace(samples, keys, vector, k, carry=order, **how)
        return found.features(order, not isinstance(channels[0], str), textured)

    return run


def subspace_SCM(k: int, assume_centered: bool = True, least_gradient: float = 1e-6) -> Feature:  # noqa: N802
    return Feature(
        "subspace_SCM", lambda x: estimators.top_subspace(estimators.scm(x, assume_centered), k),
        lambda p, n, c: geo.Grassmann(p, k, c), least_gradient=least_gradient,
        by_rounds=_subspace_rounds(k, False, assume_centered=assume_centered),
        many=lambda xs: estimators.top_subspace(np.stack([estimators.scm(x, assume_centered) for x in xs]), k),
    )


def _weighted(k: int, textured: bool, estimate_sigma: bool, options: dict) -> Callable[..., DataFrame]:
    """Rounds for the textured models; a descent of batches where its solver is ``SGD``, for the others the fixed point that they end at too."""
    if options.get("solver") == "SGD":
        return _subspace_rounds(k, textured, estimate_sigma=estimate_sigma, batches=options.get("batches", 10), seed=options.get("seed", 0))
    return _subspace_rounds(k, textured, weighted=True, estimate_sigma=estimate_sigma, **{x: options[x] for x in ("tol", "max_iter") if x in options})


def subspace_tau_UUH(k: int, estimate_sigma: bool = False, **options) -> Feature:  # noqa: N802
    return Feature(
        "subspace_tau_UUH", lambda x: estimators.tau_subspace(x, k, estimate_sigma, **options)[1], lambda p, n, c: geo.Grassmann(p, k, c),
        by_rounds=_weighted(k, False, estimate_sigma, options),
        many=estimators.by_length(lambda x: estimators.tau_subspace_many(x, k, estimate_sigma, **options)[1]),
    )


def subspace_tau_UUH_RO(k: int, estimate_sigma: bool = False, **options) -> Feature:  # noqa: N802
    return Feature(
        "subspace_tau_UUH_RO", lambda x: estimators.tau_subspace_riemannian(x, k, estimate_sigma, **options)[1], lambda p, n, c: geo.Grassmann(p, k, c),
        by_rounds=_weighted(k, False, estimate_sigma, {x: v for x, v in options.items() if x != "max_iter"}),
    )


def _tau_u(name: str, estimator: Callable, k: int, weights, by_rounds: Callable) -> Feature:
    return Feature(
        name, estimator, lambda p, n, c: geo.Product([geo.Positive(n), geo.Grassmann(p, k, c)], weights or (1 / n, 1 / k)),
        needs_order=True, by_rounds=by_rounds,
    )


def tau_UUH(k: int, estimate_sigma: bool = False, weights=None, **options) -> Feature:  # noqa: N802
    many = estimators.by_length(lambda x: estimators.tau_subspace_many(x, k, estimate_sigma, **options))
    return replace(_tau_u("tau_UUH", lambda x: estimators.tau_subspace(x, k, estimate_sigma, **options), k, weights, _weighted(k, True, estimate_sigma, options)), many=many)


def tau_UUH_RO(k: int, estimate_sigma: bool = False, weights=None, **options) -> Feature:  # noqa: N802
    rounds = _weighted(k, True, estimate_sigma, {x: v for x, v in options.items() if x != "max_iter"})
    return _tau_u("tau_UUH_RO", lambda x: estimators.tau_subspace_riemannian(x, k, estimate_sigma, **options), k, weights, rounds)


def user_defined(name: str, estimator: Callable, geometries: geo.Geometry | list[geo.Geometry], weights=None, least_gradient: float = 1e-4, many: Callable | None = None) -> Feature:
    """Any estimator of a p x n matrix with any geometry, or a list of them for a weighted product.

    ``many``, if there is one, gives the same for a list of such matrices at once, as points with one leading axis.
    """
    checks.is_callable("estimator", estimator)
    space = geo.Product(geometries, weights) if isinstance(geometries, list) else geometries
    return Feature(name, estimator, lambda p, n, c: space, least_gradient=least_gradient, many=many)
