"""Hard negatives by blocked dense products: anchors go out in blocks, candidates stay where they are.

A block of anchors is broadcast and multiplied with each block of rows, in float64 below 2^53.
The first pass keeps every anchor's best rows of its own label, the second, for each of these
positives, the best rows of other labels whose score lies in a window that follows from the positive's.
What a task keeps for an anchor merges with what others keep, so no label's rows ever meet in one place.
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

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Percent of a positive's score between which a negative's lies.
WINDOW = (30, 90)
#: Rows of a block of candidates.
ROWS = 4_096

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _scored(batches: Iterator[pa.RecordBatch], anchors: tuple, scale: int, width: int):
    """(anchors' places, scores, whether the label is the same, ids) of every pair of blocks; ``LOW`` where the id is the anchor's."""
    ids, labels, v = anchors
    for b in batches:
        taken, x = matrix(b.column("v_"), scale, width)
        own, kind = whole(b.column("vec_id"))[taken], whole(b.column("label"))[taken]
        for r in range(0, len(own), ROWS):
            part = slice(r, r + ROWS)
            for at in range(0, len(ids), QUERY_ROWS):
                some = np.arange(at, min(at + QUERY_ROWS, len(ids)))
                scores = products(v[some], x[part])
                scores[ids[some, None] == own[part]] = LOW
                yield some, scores, labels[some, None] == kind[part], own[part]


def _merged(rows: DataFrame, by: list[str], id_col: str, score_col: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score_col).desc(), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, sent, scale: int, width: int, k: int) -> DataFrame:
    """``(a, vec_id, score, rank)``: each anchor's best rows of its label; ``a`` is its place in the block."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sent.value[0]), k)
        for some, scores, same, ids in _scored(batches, sent.value, scale, width):
            best.offer(some, np.where(same, scores, LOW), ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["a", "score", "vec_id"])

    return _merged(rows.mapInArrow(tops, "a long, score long, vec_id long"), ["a"], "vec_id", "score", k)


def _negatives(rows: DataFrame, sent, positives, scale: int, width: int, k: int) -> DataFrame:
    """``(slot, vec_id, score, rank)`` for each of the ``positives`` (anchor's place, least score, most score)."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, least, most = positives.value
        best = Best(len(anchor), k, least)
        for some, scores, same, ids in _scored(batches, sent.value, scale, width):
            other = np.where(same, LOW, scores)
            slots = np.arange(*np.searchsorted(anchor, [some[0], some[-1] + 1]))
            mine = other[anchor[slots] - some[0]]
            best.offer(slots, np.where((mine >= least[slots, None]) & (mine <= most[slots, None]), mine, LOW), ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["slot", "score", "vec_id"])

    return _merged(rows.mapInArrow(tops, "slot long, score long, vec_id long"), ["slot"], "vec_id", "score", k)


def mine(
    anchors: DataFrame,
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For each anchor the ``positives`` rows of its label with the highest scores, and for each of these the
    ``negatives`` rows of other labels with the highest scores s for which low * p <= 100 * s <= high * p, with p the
    positive's score and (low, high) the ``window``: none where p is negative.  Scores are inner products of floor(scale * x); ties go to the
    smaller id; ranks count from 1.  Rows with a null label, id or vector, or a null or non-finite
    component, take no part; shorter vectors are padded with 0.  Rows with the anchor's id are neither its
    positives nor its negatives.  Rows that repeat an id are rows of their own, and so are anchors.  Integers saturate
    where scores could leave 64 bits (:func:`vectors.matrix`).  Empty tables give no rows; other columns are ignored.
    """

    def side(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v_"))
        return df.where("vec_id is not null and label is not null and v_ is not null")

    rows, anchors = side(rows), side(anchors)
    (width, _), (wide, n) = vectors.extent(rows, "v_"), vectors.extent(anchors, "v_")
    width = max(width, wide)
    found = [_mined(rows, block, positives, negatives, window, scale, width) for block in vectors.blocks(anchors, n, width, "anchors")]
    return reduce(DataFrame.unionAll, found) if found else rows.sparkSession.createDataFrame([], RESULT)


def _mined(rows: DataFrame, block: pa.Table, positives: int, negatives: int, window: tuple[int, int], scale: int, width: int) -> DataFrame:
    """The result of one block of anchors, written, so that its broadcasts aren't needed again."""
    context = rows.sparkSession.sparkContext
    taken, v = matrix(column(block, "v_"), scale, width)
    ids = whole(column(block, "vec_id"))[taken]
    sent = context.broadcast((ids, whole(column(block, "label"))[taken], v))
    best = _positives(rows, sent, scale, width, positives).toArrow()  # at most ``positives`` rows for each anchor
    a, p, score, rank = (whole(column(best, c)) if best.num_rows else np.zeros(0, dtype=np.int64) for c in ("a", "vec_id", "score", "rank"))
    order = np.lexsort((rank, a))
    a, p, score = a[order], p[order], score[order]
    exact = [(int(x) * window[0], int(x) * window[1]) for x in score]
    least = np.array([max(-(-x // 100), LOW + 1) for x, _ in exact], dtype=np.int64)
    most = np.array([x // 100 for _, x in exact], dtype=np.int64)
    slots = context.broadcast((a, least, most))
    pairs = context.broadcast((ids[a], p, score))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positive, scores = pairs.value
        for b in batches:
            s = whole(b.column("slot"))
            columns = [anchor[s], positive[s], b.column("rank"), b.column("vec_id"), scores[s], b.column("score")]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], [c.split()[0] for c in RESULT.split(", ")])

    out = written(_negatives(rows, sent, slots, scale, width, negatives).mapInArrow(named, RESULT), "negatives")
    for x in (sent, slots, pairs):
        x.destroy()
    return out
