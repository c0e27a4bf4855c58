"""Nearest and radius joins in a metric, exact, with a pivot table instead of all distances.

Every point keeps its distances to a few pivots.  By the triangle inequality, |d(q, p) - d(x, p)| for each pivot p is at most
d(q, x).  Points are dealt to tasks by ranges of their nearest pivot and cut there, as queries are, into small blocks whose pivot distances lie close
together; two blocks meet only if the gap of their pivot distances leaves room for a pair that is close enough, and then the kernel runs on all
their pairs at once (of Euclidean points as a product of matrices, with the distances of what is left taken exactly).  A query of a nearest join starts from
the bound that a sample of the points gives.  Queries go out in blocks of a fixed size; of a nearest join a task returns no more than the best of each query.

Only metrics have the inequality: Euclidean, logarithms of positive numbers, affine-invariant, Grassmann, and weighted
products of them.  Divergences are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangentia.functions import geometry as geo
from tangentia.operators.features import Feature, _len
from tangentia.operators.tables import written

#: Pivots, numbers of a block of queries, and points of the sample that gives the first bounds.
PIVOTS, BLOCK_NUMBERS, SAMPLE = 8, 1 << 20, 8192
#: Queries and points of a block, points that a task is dealt, and numbers that a kernel is called for at once.
QUERIES, POINTS, DEAL, AT_ONCE = 128, 256, 8192, 1 << 18
#: Rounding of bounds, relative.
SLACK = 1e-9


def is_metric(g: geo.Geometry) -> bool:
    """Whether a geometry's distance is symmetric and has the triangle inequality."""
    if type(g) is geo.Product:
        return all(is_metric(p) for p in g.parts) and all(w >= 0 for w in g.weights)
    return type(g) in (geo.Euclidean, geo.Positive, geo.UnitProduct, geo.PositiveDefinite, geo.UnitDeterminant, geo.Grassmann)


@dataclass(frozen=True)
class Joined:
    """``rows``: (query, key, d), of a nearest join also ``rank``; distances that were computed (those to the sample aside), and those of all pairs."""

    rows: DataFrame
    computed: int
    pairs: int


def _at(points: Any, i) -> Any:
    return tuple(a[i] for a in points) if isinstance(points, tuple) else points[i]


def _distances(g: geo.Geometry, q, x) -> np.ndarray:
    return np.broadcast_to(np.real(g.dist(q, x)), (_len(x),))


def _cuts(d: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions in blocks of at most ``size`` rows (fewer of few rows) of close pivot distances, by halves along the widest column."""
    size = max(1, min(size, int(np.sqrt(len(d)))))
    d, out, open_ = np.nan_to_num(d), [], [np.arange(len(d))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = d[at]
        order = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], len(at) // 2)
        open_ += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return [at for at in out if len(at)]


def _boxes(d: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance to each pivot of every block; one that isn't known bounds nothing."""
    low, high = (np.stack([f(d[at], axis=0) for at in cuts]) for f in (np.min, np.max))
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances between the points of a block and those of others."""
    gap = np.maximum(lows - high, low - highs).max(axis=1)
    slack = SLACK * np.where(np.isfinite(highs), highs, 0).max(axis=1, initial=0) + SLACK * np.where(np.isfinite(high), high, 0).max(initial=0)
    return np.maximum(gap - slack, 0)


def _matrix(g: geo.Geometry, q, x, limit: np.ndarray) -> np.ndarray:
    """Distances of each query to each point; those beyond a query's limit may be infinite."""
    m, n = _len(q), _len(x)
    if type(g) is geo.Euclidean and not g.complex_valued and np.isfinite(limit).all():
        q, x = q.reshape(m, -1), x.reshape(n, -1)
        size = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)
        i, j = np.nonzero(size - 2 * (q @ x.T) <= limit[:, None] ** 2 + SLACK * size)
        d = np.full((m, n), np.inf)
        d[i, j] = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
        return d
    width = sum(int(np.prod(a.shape[1:])) for a in (x if isinstance(x, tuple) else (x,)))
    step = max(1, AT_ONCE // (n * width))
    parts = []
    for k in range(0, m, step):
        own = _at(q, slice(k, k + step))
        own = tuple(a[:, None] for a in own) if isinstance(own, tuple) else own[:, None]
        parts.append(np.broadcast_to(np.real(g.dist(own, x)), (min(step, m - k), n)))
    return np.concatenate(parts)


class _Points:
    """A task's points in blocks."""

    def __init__(self, points, d: np.ndarray, names: np.ndarray, size: int = POINTS):
        self.cuts = _cuts(d, size)
        order = np.concatenate(self.cuts)
        ends = np.cumsum([0, *map(len, self.cuts)])
        self.points, self.names, self.order = _at(points, order), names[order], order
        self.cuts = [slice(a, z) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        self.low, self.high = _boxes(d[order], self.cuts)

    def within(self, g, q, low, high, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, position, d) of the pairs up to the queries' limits, and how many distances that took."""
        seen, found = 0, []
        for c in np.flatnonzero(_gaps(low, high, self.low, self.high) <= limit.max()):
            at = self.cuts[c]
            d = _matrix(g, q, _at(self.points, at), limit)
            seen += d.size
            i, j = np.nonzero(d <= limit[:, None])
            found.append((i, self.order[at.start + j], d[i, j]))
        return *_joined(found), seen

    def nearest(self, g, q, names: np.ndarray | None, low, high, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same of the ``k`` nearest of each query (and ties) up to its limit; points of its own name (of ``names``) don't count."""
        gaps = _gaps(low, high, self.low, self.high)
        seen, found, best = 0, [], np.full((len(limit), k), np.inf)
        for c in np.argsort(gaps, kind="stable"):
            most = np.minimum(limit, best[:, -1])
            if gaps[c] > most.max():
                break
            at = self.cuts[c]
            d = _matrix(g, q, _at(self.points, at), most)
            seen += d.size
            d = np.where(np.isnan(d), np.inf, d)
            if names is not None:
                d = np.where(names[:, None] == self.names[at], np.inf, d)
            i, j = np.nonzero((d <= most[:, None]) & np.isfinite(d))
            found.append((i, self.order[at.start + j], d[i, j]))
            best = np.sort(np.concatenate([best, np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
        i, j, d = _joined(found)
        keep = d <= best[i, -1]
        return i[keep], j[keep], d[keep], seen


def _joined(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _codes(keys: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the keys are."""
    if pa.types.is_integer(keys.type):
        return keys.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
    every = pa.concat_arrays([keys, others]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return every[: len(keys)], every[len(keys) :]


def _plain(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pivot_distances(column) -> np.ndarray:
    column = _plain(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _table(feature: Feature, df: DataFrame, key: str, f_col: str, pivots: list) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(f_col).alias("f")).where("key is not null and f is not null")
    return feature.distances_to(rows, pivots, out="_d") if pivots else rows.withColumn("_d", F.array(F.lit(0.0)))


def _limits(feature: Feature, asked: DataFrame, sample: pa.Table, k: int, apart: bool) -> DataFrame:
    """``asked`` with ``_t``: the distance to the ``k``-th nearest of a sample of the points, beyond which no neighbour lies."""
    g, fields = feature.geometry, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    sent = asked.sparkSession.sparkContext.broadcast((_plain(sample.column("key")), feature.decode(sample.column("f")), _pivot_distances(sample.column("_d"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x, dx = sent.value
        for batch in batches:
            if not len(batch):
                continue
            q, dq = feature.decode(batch.column("f")), _pivot_distances(batch.column("_d"))
            own, names = _codes(batch.column("key"), keys)
            table, limit = _Points(x, dx, names), np.full(len(batch), np.inf)
            for at in _cuts(dq, QUERIES):
                low, high = (v[0] for v in _boxes(dq, [at]))
                i, _, d, _ = table.nearest(g, _at(q, at), own[at] if apart else None, low, high, np.full(len(at), np.inf), k)
                i, d = (v[np.lexsort((d, i))] for v in (i, d))
                first = np.searchsorted(i, np.arange(len(at)))
                full = np.bincount(i, minlength=len(at)) >= k
                limit[at[full]] = d[first[full] + k - 1] * (1 + SLACK) + np.finfo(float).tiny
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limit)], [*batch.schema.names, "_t"])

    return asked.mapInArrow(run, f"{fields}, _t double")


def _join(
    feature: Feature, queries: DataFrame, points: DataFrame, key: str, f_col: str, pivots: int, radius: float | None, k: int = 0, apart: bool = False
) -> tuple[DataFrame, int, int]:
    """Rows (i, query, key, d) of the pairs within ``radius``, or of the ``k`` nearest in each task's points (and ties)."""
    g = feature.geometry
    if not is_metric(g):
        raise ValueError(f"{feature.name} has no metric: its distance needn't have the triangle inequality")
    spark, context = points.sparkSession, points.sparkSession.sparkContext
    raw = written(points.select(F.col(key).alias("key"), F.col(f_col).alias("f")).where("key is not null and f is not null"), "points")
    chosen = raw.orderBy(F.xxhash64(F.col("key")), "key").limit(pivots).select("f").collect()
    pivot_points = [feature.point(r[0]) for r in chosen]
    n_points = raw.count()
    deal = max(1, min(n_points // POINTS, max(n_points // DEAL, 2 * context.defaultParallelism)))
    near = F.array_min(F.col("_d"))
    table = written(_table(feature, raw.repartition(deal), "key", "f", pivot_points).repartitionByRange(deal, F.array_position("_d", near), near), "pivots")
    kind = table.schema["key"].dataType.simpleString()
    rows = raw if queries is points else queries.select(F.col(key).alias("key"), F.col(f_col).alias("f"))
    asked = _table(feature, rows.repartition(deal), "key", "f", pivot_points).withColumn("_i", F.monotonically_increasing_id())
    width = sum(int(np.prod(s)) * (1 + c) for s, c in feature.kinds) + max(len(pivot_points), 1)
    if k:
        sample = table.orderBy(F.xxhash64(F.col("key"), F.lit(1)), "key").limit(max(1, min(SAMPLE, BLOCK_NUMBERS // width))).toArrow()
        asked = _limits(feature, asked, sample, k, apart) if sample.num_rows else asked.withColumn("_t", F.lit(float("inf")))
    asked = written(asked, "queries")
    n = asked.count()
    blocks, found, computed = max(1, -(-n * width // BLOCK_NUMBERS)), [], (n + n_points) * len(pivot_points)
    for b in range(blocks if n and n_points else 0):
        block = asked.where(F.pmod("_i", F.lit(blocks)) == b).drop("_i").toArrow()
        if not block.num_rows:
            continue
        dq = _pivot_distances(block.column("_d"))
        limit = block.column("_t").to_numpy() if k else np.full(len(dq), float(radius))
        cuts = _cuts(dq, QUERIES)
        sent = context.broadcast((_plain(block.column("key")), feature.decode(block.column("f")), cuts, *_boxes(dq, cuts), limit))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q, cuts, low, high, limit = sent.value
            own_batches, seen = [x for x in batches if len(x)], 0
            if own_batches:
                whole = pa.Table.from_batches(own_batches)
                keys = _plain(whole.column("key"))
                own, others = _codes(names, keys)
                table = _Points(feature.decode(whole.column("f")), _pivot_distances(whole.column("_d")), others)
                rank = np.empty(len(keys), dtype=np.int64)
                rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                for c, at in enumerate(cuts):
                    if k:
                        i, j, d, n = table.nearest(g, _at(q, at), own[at] if apart else None, low[c], high[c], limit[at], k)
                        order = np.lexsort((rank[j], d, i))
                        i, j, d = i[order], j[order], d[order]
                        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, j, d = i[keep], j[keep], d[keep]
                    else:
                        i, j, d, n = table.within(g, _at(q, at), low[c], high[c], limit[at])
                    seen += n
                    if len(i):
                        i = at[i]
                        yield pa.RecordBatch.from_arrays([pa.array(i), names.take(pa.array(i)), keys.take(pa.array(j)), pa.array(d)], ["i", "query", "key", "d"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.nulls(1, names.type), pa.nulls(1, names.type), pa.array([float(seen)])], ["i", "query", "key", "d"])

        out = table.mapInArrow(run, f"i long, query {kind}, key {kind}, d double")
        out = written(out, "joined")
        computed += int(out.where("i < 0").agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0])
        sent.destroy()
        found.append(out.where("i >= 0").withColumn("b", F.lit(b)))
    if not found:
        empty = spark.createDataFrame([], f"i long, query {kind}, key {kind}, d double, b int")
        return empty, computed, n * n_points
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out, computed, n * n_points


def within(feature: Feature, queries: DataFrame, points: DataFrame, radius: float, key: str = "id", f_col: str = "f", pivots: int = PIVOTS) -> Joined:
    """Every pair of a query and a point at a distance of at most ``radius``, a point itself among them.

    Rows without a key or a point take no part; rows that repeat a key are rows of their own.
    """
    found, computed, pairs = _join(feature, queries, points, key, f_col, pivots, radius)
    return Joined(found.select("query", "key", "d"), computed, pairs)


def nearest(feature: Feature, queries: DataFrame, points: DataFrame, k: int = 1, key: str = "id", f_col: str = "f", pivots: int = PIVOTS, apart: bool = True) -> Joined:
    """For each query the ``k`` nearest points (all, if there are fewer), ranked from 1; ties go to the smaller key.

    With ``apart`` points of the query's own key don't count.  Rows without a key or a point take no part; rows that repeat a key are rows of their own.
    """
    found, computed, pairs = _join(feature, queries, points, key, f_col, pivots, None, k, apart)
    order = Window.partitionBy("b", "i").orderBy("d", "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return Joined(ranked.select("query", "rank", "key", "d"), computed, pairs)
