"""Vectors as integers, exact products of blocks of them, and best rows that merge: what operators on embeddings share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.common import written

#: Numbers of a block of vectors that is broadcast (8 MB as float64), and rows of a block of it inside a task.
BLOCK_NUMBERS, QUERY_ROWS = 1 << 20, 256
#: Below every score.
LOW = -(1 << 62)


def finite(vec_col: str):
    """Whether a vector takes part: neither null nor with a null or non-finite component."""
    every = F.col(vec_col).cast("array<double>")
    return F.coalesce(F.forall(every, lambda x: F.abs(x) < F.lit(math.inf)), F.lit(False))


def matrix(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and floor(scale * x) of theirs, padded with 0 to ``width``, as float64.

    Integers saturate where products of two rows, or squared distances, could leave 64 bits:
    beyond 2^27 at 64 components.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    taken = pc.is_valid(column).to_numpy(zero_copy_only=False).astype(bool)
    taken[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(lengths), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    most = math.isqrt((1 << 60) // max(width, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.clip(np.floor(scale * flat), -most, most)
    out[row[at < width], at[at < width]] = flat[at < width]
    return taken, out[taken]


def whole(column: pa.Array) -> np.ndarray:
    """A column of integers without nulls."""
    return pc.cast(column, pa.int64()).to_numpy(zero_copy_only=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of integers: one float64 product below 2^53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The ``k`` best (score, id) of each of ``n`` lists so far: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), LOW, dtype=np.int64)
        self.ids = np.zeros((n, k), dtype=np.int64)
        #: scores that a list's rows must reach anyway
        self.floor = np.full(n, LOW, dtype=np.int64) if least is None else least

    def least(self, lists: np.ndarray) -> np.ndarray:
        """The score from which a row can still enter each of these lists."""
        return np.maximum(self.scores[lists, -1], self.floor[lists])

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """One row of scores for each of ``lists`` (different ones), of rows ``ids`` (a vector, or one for each score); ``LOW`` is none."""
        width = scores.shape[1]
        if not len(lists) or not width:
            return
        enough = self.least(lists)
        if width > self.k:
            enough = np.maximum(enough, np.partition(scores, width - self.k, axis=1)[:, width - self.k])
        new, at = np.nonzero((scores >= enough[:, None]) & (scores > LOW))
        if not len(new):
            return
        hit = np.unique(new)  # only lists with a new row are sorted again
        of = np.concatenate([np.repeat(hit, self.k), new])
        score = np.concatenate([self.scores[lists[hit]].ravel(), scores[new, at]])
        id_ = np.concatenate([self.ids[lists[hit]].ravel(), ids[at] if ids.ndim == 1 else ids[new, at]])
        order = np.lexsort((id_, -score, of))
        of, score, id_ = of[order], score[order], id_[order]
        first = np.searchsorted(of, hit)
        rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        kept = rank < self.k
        self.scores[lists[of[kept]], rank[kept]] = score[kept]
        self.ids[lists[of[kept]], rank[kept]] = id_[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that was kept."""
        lists, at = np.nonzero(self.scores > LOW)
        return lists, self.scores[lists, at], self.ids[lists, at]


def extent(rows: DataFrame, vec_col: str) -> tuple[int, int]:
    """Components of the longest vector, to which the others are padded, and the number of rows."""
    most, n = rows.agg(F.max(F.size(vec_col)), F.count("*")).first()
    return max(most or 0, 1), n


def blocks(rows: DataFrame, n: int, width: int, tag: str) -> Iterator[pa.Table]:
    """``rows``, of which there are at most ``n``, in blocks of about ``BLOCK_NUMBERS`` components, each small enough to be broadcast.

    Rows are dealt in turn to as many blocks as are needed, so repeated ids or vectors fill none.
    """
    count = max(1, -(-n * width // BLOCK_NUMBERS))
    dealt = rows.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int"))
    dealt = written(dealt.sortWithinPartitions("_block"), tag)
    for k in range(count if n else 0):
        block = dealt.where(F.col("_block") == k).drop("_block").toArrow()
        if block.num_rows:
            yield block


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table that has rows, as one array."""
    return pa.concat_arrays(table.column(name).chunks)
