"""Images as one row for each pixel, ``(r, c, channels..., label)``: crops, borders, centring, masks, windows, PCA.

Windows are centre-indexed, odd and full: one that reaches over the edge, or that
holds a pixel without a row or with a channel that is null or NaN, or a pixel twice, has no feature, however it is computed.
Overlapping windows are cut out of square tiles.  A pixel goes to its own tile and, within half a window of an
edge, to the neighbours', so a tile holds all that its windows need and image rows and columns never meet
whole.  Algebraic features are differences of running sums inside a tile, along rows and then columns: their cost
for a pixel doesn't grow with the window.  Other features take their windows as slices of the tile.
Windows apart from each other hold each pixel once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangentia.functions import checks
from tangentia.operators import estimate

#: Least side of a tile, and how many times the window's side it is at least, so that halos stay few.
TILE, TILE_WINDOWS = 128, 4


def extent(pixels: DataFrame) -> tuple[int, int]:
    """Height and width: one more than the largest row and column."""
    r = pixels.agg(F.max("r"), F.max("c")).first()
    return (0, 0) if r[0] is None else (r[0] + 1, r[1] + 1)


def crop_center(pixels: DataFrame, height: int, width: int, size: int = 30) -> DataFrame:
    """The ``size`` x ``size`` pixels in the middle, renumbered from 0."""
    r0, c0 = (height - size) // 2, (width - size) // 2
    inside = F.col("r").between(r0, r0 + size - 1) & F.col("c").between(c0, c0 + size - 1)
    return pixels.where(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def blank_border(pixels: DataFrame, height: int, width: int, border: int, label: str = "label") -> DataFrame:
    """Labels within ``border`` pixels of the edge become -1."""
    inside = F.col("r").between(border, height - 1 - border) & F.col("c").between(border, width - 1 - border)
    return pixels.withColumn(label, F.when(inside, F.col(label)).otherwise(F.lit(-1)))


def remove_mean(pixels: DataFrame, channels: Sequence[str], by: str = "column") -> DataFrame:
    """Channels less their means: over each image column, or over the whole image (``global``)."""
    checks.one_of("by", by, ("column", "global"))
    if by == "global":
        means = pixels.agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(channels)])
        out = pixels.join(F.broadcast(means))
    else:
        means = pixels.groupBy(F.col("c").alias("_c")).agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(channels)])
        out = pixels.join(means, F.col("c") == F.col("_c")).drop("_c")
    out = out.withColumns({x: F.col(x) - F.col(f"_m{i}") for i, x in enumerate(channels)})
    return out.drop(*[f"_m{i}" for i in range(len(channels))])


def build_mask(pixels: DataFrame, height: int, width: int, border: int, label: str = "label", unlabelled: bool = True) -> DataFrame:
    """``mask``: true outside the border and, if asked, where the label isn't negative."""
    inside = F.col("r").between(border, height - 1 - border) & F.col("c").between(border, width - 1 - border)
    return pixels.withColumn("mask", inside & (F.col(label) >= 0) if unlabelled else inside)


def full_windows(height: int, width: int, size: int, overlapping: bool = True) -> Column:
    """Whether ``(r, c)`` is the centre of a full window (of every ``size``-th one, if they don't overlap)."""
    if size % 2 != 1:
        raise ValueError("windows are odd")
    h = size // 2
    full = F.col("r").between(h, height - 1 - h) & F.col("c").between(h, width - 1 - h)
    return full if overlapping else full & ((F.col("r") - h) % size == 0) & ((F.col("c") - h) % size == 0)


def _present(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Pixels with all their channels, none of them null or NaN."""
    return pixels.dropna(subset=list(channels)) if channels else pixels


def tile_side(size: int, least: int | None = None) -> int:
    """Side of the tiles for windows of ``size``."""
    return max(TILE if least is None else least, TILE_WINDOWS * size)


def tiled(pixels: DataFrame, size: int, side: int) -> DataFrame:
    """``pixels`` with the tile ``(_ti, _tj)``, once for each tile that has a window of ``size`` which reaches them.

    The tile of a window is that of its centre, so tiles don't shift or restart any stride.
    """
    h = size // 2

    def tiles(x: str) -> Column:
        least = F.greatest(F.floor((F.col(x) - h) / side), F.lit(0))
        return F.explode(F.sequence(least, F.floor((F.col(x) + h) / side)))

    return pixels.select("*", tiles("r").alias("_ti")).select("*", tiles("c").alias("_tj"))


def _own(side: int) -> Column:
    """Whether a pixel is of the tile itself, not of its halo."""
    return (F.floor(F.col("r") / side) == F.col("_ti")) & (F.floor(F.col("c") / side) == F.col("_tj"))


def _sliding(names: Sequence[str], along: Sequence[str], order: str, h: int) -> list[Column]:
    """Sums of columns over the rows within ``h`` in ``order``: what has come up to the end less what had come before the beginning.

    Both frames begin at the partition's first row, so each is one running sum.
    """
    w = Window.partitionBy(*along).orderBy(order)
    to, before = w.rangeBetween(Window.unboundedPreceding, h), w.rangeBetween(Window.unboundedPreceding, -h - 1)
    return [(F.sum(k).over(to) - F.coalesce(F.sum(k).over(before), F.lit(0))).alias(k) for k in names]


def _window_sums(
    pixels: DataFrame, values: dict[str, Column], size: int, height: int, width: int, centres: DataFrame | None = None, side: int | None = None
) -> DataFrame:
    """Sums of ``values`` over the full windows, by rows and then columns of tiles; of those centred at ``centres`` (r, c) if given.

    One shuffle brings the tiles together.  Where a window holds an infinity, all its sums are NaN.
    """
    h, side = size // 2, side or tile_side(size)
    finite = [F.abs(v) < F.lit(float("inf")) for v in values.values()]
    odd = ~F.coalesce(F.array_min(F.array(*finite)), F.lit(False)) if values else F.lit(False)
    x = pixels.select("r", "c", F.lit(1).alias("_n"), odd.cast("int").alias("_odd"), *[v.cast("double").alias(k) for k, v in values.items()])
    x = x.withColumns({k: F.when(F.col("_odd") == 0, F.col(k)).otherwise(0.0) for k in values})
    names = ["_n", "_odd", *values]
    x = tiled(x, size, side).repartition("_ti", "_tj")
    # a centre without a pixel is not full, so it is enough to sum at the pixels
    x = x.select("r", "c", "_ti", "_tj", *_sliding(names, ["_ti", "_tj", "r"], "c", h)).where(F.col("_n") == size)
    x = x.select("r", "c", "_ti", "_tj", *_sliding(names, ["_ti", "_tj", "c"], "r", h))
    x = x.where((F.col("_n") == size * size) & full_windows(height, width, size) & _own(side))
    x = x.select("r", "c", *[F.when(F.col("_odd") == 0, F.col(k)).otherwise(float("nan")).alias(k) for k in values])
    return x if centres is None else x.join(centres.select("r", "c").distinct(), ["r", "c"], "left_semi")


def window_means(
    pixels: DataFrame, channels: Sequence[str], size: int, height: int, width: int, centres: DataFrame | None = None, side: int | None = None
) -> DataFrame:
    """``(r, c, m0, m1, ...)``: mean of every channel over each full window."""
    values = {f"m{i}": F.col(x) for i, x in enumerate(channels)}
    sums = _window_sums(_present(pixels, channels), values, size, height, width, centres, side)
    return sums.select("r", "c", *[(F.col(f"m{i}") / (size * size)).alias(f"m{i}") for i in range(len(channels))])


def window_gaussians(
    pixels: DataFrame, channels: Sequence[str], size: int, height: int, width: int, assume_centered: bool = False, centres: DataFrame | None = None, side: int | None = None
) -> DataFrame:
    """``(r, c, n, f struct<c0, c1>)``: mean and sample covariance (about it, or about 0) of each full window, row-major."""
    p, n = len(channels), size * size
    values = {f"s{i}_{j}": F.col(channels[i]) * F.col(channels[j]) for i in range(p) for j in range(i, p)}
    values |= {f"m{i}": F.col(x) for i, x in enumerate(channels)}
    sums = _window_sums(_present(pixels, channels), values, size, height, width, centres, side)

    def entry(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        second = F.col(f"s{i}_{j}") / n
        return second if assume_centered else second - F.col(f"m{i}") / n * F.col(f"m{j}") / n

    mu = F.array(*[F.col(f"m{i}") / n for i in range(p)])
    sigma = F.array(*[entry(i, j) for i in range(p) for j in range(p)])
    return sums.select("r", "c", F.lit(n).cast("long").alias("n"), F.struct(mu.alias("c0"), sigma.alias("c1")).alias("f"))


def window_covariances(
    pixels: DataFrame, channels: Sequence[str], size: int, height: int, width: int, assume_centered: bool = True, centres: DataFrame | None = None, side: int | None = None
) -> DataFrame:
    """``(r, c, n, f struct<c0>)``: sample covariance of each full window (centred at ``centres``, if given), row-major."""
    both = window_gaussians(pixels, channels, size, height, width, assume_centered, centres, side)
    return both.withColumn("f", F.struct(F.col("f.c1").alias("c0")))


def _mean_features(pixels: DataFrame, channels: Sequence[str], size: int, height: int, width: int, **how) -> DataFrame:
    m = window_means(pixels, channels, size, height, width, **how)
    mu = F.array(*[F.col(f"m{i}") for i in range(len(channels))])
    return m.select("r", "c", F.lit(size * size).cast("long").alias("n"), F.struct(mu.alias("c0")).alias("f"))


#: How the algebraic features' windows come from sums, by the ``moments`` that a feature names.
_WINDOW_MOMENTS = {
    "mean": _mean_features,
    "second": window_covariances,
    "centred": lambda *a, **how: window_covariances(*a, assume_centered=False, **how),
    "gaussian": window_gaussians,
}


def exploded_windows(
    pixels: DataFrame, channels: Sequence[str], size: int, height: int, width: int, overlapping: bool = True, centres: DataFrame | None = None
) -> DataFrame:
    """Observations ``(r, c, obs_idx, channels)`` of each window centred at (r, c) within the frame, row-major within it.

    ``centres`` (r, c) keeps the windows of a mask; they are filtered before anything is estimated.
    A window that lacks pixels has fewer observations: :func:`window_features` passes it over.
    Of windows apart, every pixel is in one; overlapping ones copy it to all that hold it.
    """
    h = size // 2
    x = _present(pixels, channels).select(F.col("r").alias("_r"), F.col("c").alias("_c"), *channels)
    if overlapping:
        x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("obs_idx"))
        r, c = F.col("_r") - F.floor(F.col("obs_idx") / size) + h, F.col("_c") - F.col("obs_idx") % size + h
    else:
        x = x.withColumn("obs_idx", (F.col("_r") % size * size + F.col("_c") % size).cast("int"))
        r, c = (F.floor(F.col(k) / size) * size + h for k in ("_r", "_c"))
    x = x.select(r.cast("long").alias("r"), c.cast("long").alias("c"), "obs_idx", *channels).where(full_windows(height, width, size, overlapping))
    return x if centres is None else x.join(centres.select("r", "c").distinct(), ["r", "c"], "left_semi")


def _sliced_windows(pixels: DataFrame, channels: Sequence[str], feature, size: int, height: int, width: int, centres: DataFrame | None, side: int) -> DataFrame:
    """``(r, c, n, f)``: a feature's estimator over the windows of each tile, cut out of it one after the other."""
    h, p = size // 2, len(channels)
    x = _present(pixels, channels).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(k).cast("double").alias(k) for k in channels])
    flag = F.lit(True)
    if centres is not None:
        x = x.join(centres.select("r", "c", F.lit(True).alias("_at")).distinct(), ["r", "c"], "left")
        flag = F.coalesce("_at", F.lit(False))
    x = tiled(x.withColumn("_at", flag), size, side)
    x = x.withColumn("_at", F.col("_at") & _own(side) & full_windows(height, width, size))

    def run(tile: pa.Table) -> pa.Table:
        r, c, at = (tile.column(k).to_numpy() for k in ("r", "c", "_at"))
        at = at.astype(bool)
        top, left = r.min(), c.min()
        shape = (int(r.max() - top) + 1, int(c.max() - left) + 1)
        seen, data = np.zeros(shape, dtype=np.int64), np.zeros((p, *shape))
        np.add.at(seen, (r - top, c - left), 1)
        for k, name in enumerate(channels):
            data[k, r - top, c - left] = tile.column(name).to_numpy()
        rows, cols, points = [], [], []
        for i, j in sorted(set(zip((r[at] - top).tolist(), (c[at] - left).tolist(), strict=True))):
            window = (slice(i - h, i + h + 1), slice(j - h, j + h + 1)) if i >= h and j >= h else (slice(0), slice(0))
            if seen[window].shape == (size, size) and (seen[window] == 1).all():
                v = data[(slice(None), *window)].reshape(p, -1)
                points.append(feature.estimation(v[::2] + 1j * v[1::2] if feature.complex_valued else v))
                rows.append(i + top)
                cols.append(j + left)
        many = tuple(np.stack(z) for z in zip(*points, strict=True)) if points and isinstance(points[0], tuple) else np.array(points)
        f = feature.encode(many) if points else pa.array([], feature_type)
        return pa.table([pa.array(rows, pa.int64()), pa.array(cols, pa.int64()), pa.array([size * size] * len(rows), pa.int64()), f], ["r", "c", "n", "f"])

    one = pa.list_(pa.float64())
    both = pa.struct([("re", one), ("im", one)])
    feature_type = pa.struct([(f"c{i}", both if cplx else one) for i, (_, cplx) in enumerate(feature.kinds)])
    return x.groupBy("_ti", "_tj").applyInArrow(run, f"r long, c long, n long, f {feature.type}")


def window_features(
    pixels: DataFrame, channels: Sequence, feature, size: int, height: int, width: int, overlapping: bool = True, mask: DataFrame | None = None, side: int | None = None
) -> DataFrame:
    """``(r, c, n, f)`` of a bound feature over every full window; ``mask`` rows (r, c, mask) keep centres, before estimation.

    ``side`` is that of the tiles (:func:`tile_side` by default); no result depends on it.
    """
    centres = None if mask is None else mask.where("mask").select("r", "c")
    flat = [c for pair in channels for c in pair] if feature.complex_valued else list(channels)
    moments = None if feature.complex_valued or not overlapping else feature.options.get("moments")
    if moments:
        return _WINDOW_MOMENTS[moments](pixels, flat, size, height, width, centres=centres, side=side)
    built_in = feature.complex_built_in if feature.complex_valued else feature.built_in
    if overlapping and not built_in:
        # estimators cost more than sums: smaller tiles, so that there are more tasks
        return _sliced_windows(pixels, flat, feature, size, height, width, centres, side or tile_side(size, TILE // 4))
    seen = exploded_windows(pixels, flat, size, height, width, overlapping, centres)
    full = F.col("n") == size * size
    if built_in:
        return feature.estimate(seen, ["r", "c"], channels, ["obs_idx"]).where(full)
    return feature.estimate_packed(estimate.packed(seen, ["r", "c"], flat, ["obs_idx"]).where(full), ["r", "c"])


def embed(labels: DataFrame, height: int, width: int, k_col: str = "k") -> DataFrame:
    """``(r, c, k)`` for every pixel of the frame, -1 where ``labels`` has none."""
    grid = labels.sparkSession.range(height * width).select(
        F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c")
    )
    return grid.join(labels.select("r", "c", F.col(k_col).alias("k")), ["r", "c"], "left").select(
        "r", "c", F.coalesce("k", F.lit(-1)).cast("int").alias("k")
    )


def moments(pixels: DataFrame, channels: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, covariance about it (divisor n) and the number of rows, from one aggregation."""
    p = len(channels)
    aggs = [F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(channels)]]
    aggs += [F.covar_pop(channels[i], channels[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    row = pixels.agg(*aggs).first()
    mean = np.array([row[f"m{i}"] for i in range(p)], dtype=float)
    cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    return mean, cov, row["n"]


def spectrum(pixels: DataFrame, channels: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the global covariance, largest first, and the share of variance up to each."""
    w = np.linalg.eigvalsh(moments(pixels, channels)[1])[::-1]
    return w, np.cumsum(w) / w.sum()


def pca(pixels: DataFrame, channels: Sequence[str], k: int) -> DataFrame:
    """Channels replaced by ``pc0..``: coordinates of the centred pixels on the k first principal directions.

    The p x p moments are the only thing collected; projection is an expression.
    The sign of a direction makes its largest entry positive.
    """
    if not 0 < k <= len(channels):
        raise ValueError("k is at least 1 and at most the number of channels")
    mean, cov, _ = moments(pixels, channels)
    q = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(k)])
    centred = [F.col(x) - F.lit(float(m)) for x, m in zip(channels, mean, strict=True)]
    scores = [sum((c * float(v) for c, v in zip(centred[1:], col[1:], strict=True)), centred[0] * float(col[0])) for col in q.T]
    rest = [c for c in pixels.columns if c not in channels]
    return pixels.select(*rest, *[s.alias(f"pc{i}") for i, s in enumerate(scores)])


def pauli(pixels: DataFrame, hh: tuple[str, str], hv: tuple[str, str], vv: tuple[str, str]) -> DataFrame:
    """``(r, c, red, green, blue)`` of polarimetric channels: |HH - VV|, |HV|, |HH + VV|, less the least, at most 1."""

    def size(re: Column, im: Column) -> Column:
        return F.sqrt(re * re + im * im)

    a, b, v = [(F.col(x), F.col(y)) for x, y in (hh, hv, vv)]
    rgb = pixels.select(
        "r", "c", size(a[0] - v[0], a[1] - v[1]).alias("red"), size(*b).alias("green"), size(a[0] + v[0], a[1] + v[1]).alias("blue")
    )
    low = rgb.agg(F.min(F.least("red", "green", "blue")).alias("_low"))
    out = rgb.join(F.broadcast(low))
    return out.select("r", "c", *[F.least(F.col(x) - F.col("_low"), F.lit(1.0)).alias(x) for x in ("red", "green", "blue")])

