"""Exact top-k search of inner products by pivot-table elimination.

Inner products of integer vectors follow from their distance and lengths,
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, and every pivot p bounds the distance from below,
d(q, x) >= |d(q, p) - d(x, p)|.  So the distances of all rows to many pivots,
computed once and kept in a table, give each pair an upper bound of its score
without a look at its components.  A query's candidates are taken in the order of that
bound and evaluated until the bound is less than the k-th score found.

Queries go out in blocks of a fixed size; a task holds such a block, some rows, and the best rows
of each query, which merge.  Nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangentia.llm import vectors
from tangentia.llm.common import written
from tangentia.llm.vectors import LOW, QUERY_ROWS, Best, column, matrix, products, whole

#: Pivots besides the origin; components of the sample of rows they are taken from, and from which queries get a first bound.
PIVOTS, SAMPLE_NUMBERS = 64, 1 << 18
#: Candidates evaluated before a query's next bound is looked at; four times as many after every look.
FIRST = 64
#: Rows of a block of candidates.
ROWS = 4_096
#: Rounding of bounds, in parts of the squared lengths.
SLACK = 1e-9

TABLE = "vec_id long, v array<double>, d array<double>"


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the origin and to each pivot."""
    lengths = (x * x).sum(1)
    squared = lengths[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(np.column_stack([lengths, squared]), 0))


def bounds(dq: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all pairs, from their distances to the pivots."""
    gap = np.abs(dq[:, :1] - dx[:, 0])
    for p in range(1, dq.shape[1]):
        np.maximum(gap, np.abs(dq[:, p : p + 1] - dx[:, p]), out=gap)
    lengths = dq[:, :1] ** 2 + dx[:, 0] ** 2
    # a distance comes from a difference of squares, so it is only as sure as the root of their rounding
    gap = np.maximum(gap - np.sqrt(SLACK * lengths), 0)
    return (lengths - gap * gap) / 2 + SLACK * lengths + 0.5


def search_block(best: Best, lists: np.ndarray, q: tuple, c: tuple) -> int:
    """Offers block ``c`` to the queries ``lists``; both are (ids, vectors, distances).  Returns the pairs evaluated."""
    (q_ids, q_v, q_d), (c_ids, c_v, c_d) = q, c
    upper = bounds(q_d, c_d)
    upper[q_ids[:, None] == c_ids] = -np.inf
    order = np.argsort(-upper, axis=1, kind="stable")
    active, at, step, seen = np.arange(len(q_ids)), 0, FIRST, 0
    while at < len(c_ids):
        active = active[upper[active, order[active, at]] >= best.least(lists[active])]
        if not len(active):
            break
        picked = order[active, at : at + step]
        bound = np.take_along_axis(upper[active], picked, 1)
        alive = (bound >= best.least(lists[active])[:, None]) & (bound > -np.inf)
        if 4 * step >= len(c_ids):
            scores = np.take_along_axis(products(q_v[active], c_v), picked, 1)
        else:
            scores = np.stack([products(q_v[k : k + 1], c_v[p])[0] for k, p in zip(active, picked, strict=True)])
        best.offer(lists[active], np.where(alive, scores, LOW), c_ids[picked])
        seen += int(alive.sum())
        at, step = at + step, 4 * step
    return seen


def _sample(rows: DataFrame, scale: int, width: int, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that come first by a hash."""
    n = max(PIVOTS, SAMPLE_NUMBERS // width)
    first = rows.orderBy(F.xxhash64("vec_id", vec_col), "vec_id").limit(n).toArrow()
    if not first.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, width))
    taken, v = matrix(column(first, vec_col), scale, width)
    return whole(column(first, "vec_id"))[taken], v


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def pivot_table(rows: DataFrame, pivots: np.ndarray, scale: int, width: int, vec_col: str) -> DataFrame:
    """``(vec_id, v, d)`` of the rows that take part: integers, and distances to the origin and the pivots."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, v = matrix(b.column(vec_col), scale, width)
            ids = whole(b.column("vec_id"))[taken]
            yield pa.RecordBatch.from_arrays([pa.array(ids), _listed(v), _listed(distances(v, pivots))], ["vec_id", "v", "d"])

    return rows.mapInArrow(table, TABLE)


def _bounded(queries: DataFrame, ids: np.ndarray, sample: np.ndarray, k: int, width: int) -> DataFrame:
    """Queries with ``least``: their k-th score in the sample, which rows of the result reach."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = np.full(b.num_rows, LOW, dtype=np.int64)
            own, v = whole(b.column("vec_id")), _dense(b.column("v"), width)
            for at in range(0, b.num_rows if len(ids) >= k else 0, QUERY_ROWS):
                part = slice(at, at + QUERY_ROWS)
                scores = np.where(own[part, None] == ids, LOW, products(v[part], sample))
                least[part] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], ["vec_id", "v", "d", "least"])

    return queries.mapInArrow(first, f"{TABLE}, least long")


def search(queries: DataFrame, rows: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries`` the ``k`` rows of the highest scores, exactly.

    The score is the inner product of the vectors' integers floor(scale * x); ties go to the smaller id, ranks
    count from 1, and a query has fewer rows only if there are fewer.  Vectors that are null or have a null or non-finite component
    take no part, nor do rows without an id; shorter vectors are padded with 0.  Rows with a query's id are not among its
    candidates.  Rows that repeat an id are rows of their own, and so are queries: each has its ``k`` rows.  Integers saturate where
    scores could leave 64 bits (:func:`vectors.matrix`).  Empty tables give no rows; other columns are ignored.
    """

    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v_")).where("vec_id is not null and v_ is not null")

    rows, queries = side(rows), side(queries)
    (width, _), (wide, n) = vectors.extent(rows, "v_"), vectors.extent(queries, "v_")
    width = max(width, wide)
    ids, sample = _sample(rows, scale, width, "v_")
    pivots = sample[:PIVOTS]
    table = written(pivot_table(rows, pivots, scale, width, "v_"), "pivots")
    asked = _bounded(pivot_table(queries, pivots, scale, width, "v_"), ids, sample, k, width)
    spark = rows.sparkSession
    found = [_answer(spark, block, table, k, width, len(pivots) + 1) for block in vectors.blocks(asked, n, width, "queries")]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _answer(spark, block: pa.Table, table: DataFrame, k: int, width: int, pivots: int) -> DataFrame:
    """The result of one block of queries, written, so that its broadcast isn't needed again."""
    q_ids = whole(column(block, "vec_id"))
    sent = spark.sparkContext.broadcast((q_ids, _dense(column(block, "v"), width), _dense(column(block, "d"), pivots), whole(column(block, "least"))))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v, d, least = sent.value
        best = Best(len(ids), k, least)
        for b in batches:
            rows = (whole(b.column("vec_id")), _dense(b.column("v"), width), _dense(b.column("d"), pivots))
            for r in range(0, b.num_rows, ROWS):
                c = tuple(x[r : r + ROWS] for x in rows)
                for at in range(0, len(ids), QUERY_ROWS):
                    lists = np.arange(at, min(at + QUERY_ROWS, len(ids)))
                    search_block(best, lists, (ids[lists], v[lists], d[lists]), c)
        lists, scores, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lists, ids[lists], found, scores)], ["q", "query_id", "vec_id", "score"])

    every = table.mapInArrow(tops, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", "rank", "vec_id", "score"), "top")
    sent.destroy()
    return out
