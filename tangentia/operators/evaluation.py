"""Scores of a segmentation ``c`` against a ground truth ``gt`` in the same rows.

Negative or null values are unlabelled.  Everything but the assignment of classes comes from
one contingency table, which has a row for each pair of classes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classes(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``k``: all labels of either column, in order."""
    both = rows.select(F.col(c).alias("k")).union(rows.select(F.col(gt).alias("k")))
    return both.where("k >= 0").distinct().orderBy("k")


def contingency(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``(c, gt, n)`` over all rows, unlabelled ones included."""
    return rows.groupBy(F.col(c).alias("c"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))


def overall_accuracy(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``oa``: share of the labelled rows with equal labels."""
    return rows.where(F.col(gt) >= 0).agg(F.avg(F.col(c).eqNullSafe(F.col(gt)).cast("double")).alias("oa"))


def iou_by_class(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``(k, n_inter, n_union, iou)``; the union counts labelled rows only, and ``iou`` is null where it is empty."""
    t = contingency(rows, c, gt)
    each = t.select(F.explode(F.array_distinct(F.array("c", "gt"))).alias("k"), "c", "gt", "n").where("k >= 0")
    labelled = F.col("gt") >= 0
    each = each.groupBy("k").agg(
        F.coalesce(F.sum(F.when((F.col("c") == F.col("gt")), F.col("n"))), F.lit(0)).alias("n_inter"),
        F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)).alias("n_union"),
    )
    return each.withColumn("iou", F.when(F.col("n_union") > 0, F.col("n_inter") / F.col("n_union")))


def mean_iou(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``miou``: average over the classes that have a union."""
    return iou_by_class(rows, c, gt).agg(F.avg("iou").alias("miou"))


def adjusted_rand(rows: DataFrame, c: str = "c", gt: str = "gt") -> DataFrame:
    """``ari`` of the labelled rows, by counting pairs in the contingency table; 1 for two trivial partitions."""
    t = contingency(rows.where((F.col(c) >= 0) & (F.col(gt) >= 0)), c, gt)

    def pairs(x):
        return x * (x - 1) / 2

    cells = t.agg(F.sum(pairs(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    a = t.groupBy("c").agg(F.sum("n").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("a"))
    b = t.groupBy("gt").agg(F.sum("n").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("b"))
    x = cells.join(F.broadcast(a)).join(F.broadcast(b))
    expected = F.col("a") * F.col("b") / pairs(F.col("n"))
    most = (F.col("a") + F.col("b")) / 2
    return x.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("i") - expected) / (most - expected)).alias("ari"))


def _expected_term(x: int, y: int, n: int) -> float:
    """Expected k/n log(nk/(xy)) of an overlap k of sets of x and y among n, by chance.

    Overlaps further than 12 standard deviations and 30 from the mean are left out: by
    Bernstein's inequality they have a probability below e^-40 together, and no
    term is larger than log n.  So the work grows with the square root of n.
    """
    mean = x * y / n
    reach = 12 * math.sqrt(mean * (1 - x / n) * (n - y) / max(n - 1, 1)) + 30
    low, high = max(1, x + y - n, math.floor(mean - reach)), min(x, y, math.ceil(mean + reach))
    if low > high:
        return 0.0
    k = np.arange(max(0, low - 1) if low == 1 and x + y <= n else low, high + 1, dtype=float)
    # probabilities relative to the first overlap, from the ratio of each to the one before
    ratio = np.log(x - k[:-1]) + np.log(y - k[:-1]) - np.log(k[1:]) - np.log(n - x - y + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(k > 0, k / n * np.log(n * k / (x * y)), 0.0)
    return float((p * value).sum())


def adjusted_mutual_information(rows: DataFrame, c: str = "c", gt: str = "gt") -> float:
    """Mutual information adjusted for chance, over the mean of the entropies.

    The table of counts is collected: it has a cell for each pair of classes.
    What chance alone would give is summed where it isn't negligible (:func:`_expected_term`).
    """
    cells = contingency(rows.where((F.col(c) >= 0) & (F.col(gt) >= 0)), c, gt).collect()
    if not cells:
        return 1.0
    a: dict = {}
    b: dict = {}
    for r in cells:
        a[r["c"]] = a.get(r["c"], 0) + r["n"]
        b[r["gt"]] = b.get(r["gt"], 0) + r["n"]
    n = sum(a.values())
    if len(a) == len(b) == 1:
        return 1.0
    mi = sum(r["n"] / n * math.log(n * r["n"] / (a[r["c"]] * b[r["gt"]])) for r in cells)
    entropy = [-sum(v / n * math.log(v / n) for v in side.values()) for side in (a, b)]
    expected = sum(_expected_term(x, y, n) for x in a.values() for y in b.values())
    most = sum(entropy) / 2
    return 1.0 if abs(most - expected) < 1e-15 else (mi - expected) / (most - expected)


def best_assignment(gain: np.ndarray) -> list[int]:
    """For every row a column of its own so that the sum of ``gain`` is greatest; rows are at most as many as columns.

    Shortest augmenting paths with potentials.
    """
    cost = -np.asarray(gain, dtype=float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more clusters than classes")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j0]:
            done[j0] = True
            reduced = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(done[1:], np.inf, least[1:])))
            step = least[j1]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j0 = j1
        while j0:
            row_of[j0], j0 = row_of[came[j0]], came[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def assignment(rows: DataFrame, c: str = "c", gt: str = "gt", normalize: bool = False) -> dict[int, int]:
    """Class of the ground truth for every cluster so that they overlap most (of each class's size, if normalised)."""
    cells = contingency(rows.where((F.col(c) >= 0) & (F.col(gt) >= 0)), c, gt).collect()
    mine, theirs = sorted({r["c"] for r in cells}), sorted({r["gt"] for r in cells})
    table = np.zeros((len(mine), len(theirs)))
    for r in cells:
        table[mine.index(r["c"]), theirs.index(r["gt"])] = r["n"]
    if normalize:
        table = table / table.sum(axis=0)
    return {k: theirs[j] for k, j in zip(mine, best_assignment(table), strict=True)} if cells else {}


def assign(rows: DataFrame, c: str = "c", gt: str = "gt", normalize: bool = False, out: str = "c") -> DataFrame:
    """``rows`` with the clusters renamed to the classes they match; labels without a match stay."""
    found = assignment(rows, c, gt, normalize)
    if not found:
        return rows.withColumn(out, F.col(c))
    table = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    return rows.withColumn(out, F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)))


def true_false_map(rows: DataFrame, k: int, c: str = "c", gt: str = "gt", out: str = "outcome") -> DataFrame:
    """For class ``k``: 3 true positive, 2 false positive (labelled rows only), 1 false negative, 0 other."""
    mine, theirs = F.coalesce(F.col(c) == k, F.lit(False)), F.coalesce(F.col(gt) == k, F.lit(False))
    value = F.when(mine & theirs, 3).when(mine & (F.col(gt) >= 0), 2).when(~mine & theirs, 1).otherwise(0)
    return rows.withColumn(out, value)


def evaluate(rows: DataFrame, c: str = "c", gt: str = "gt", normalize: bool = False) -> dict[str, float]:
    """Mean IoU and overall accuracy after the assignment, and ARI and AMI."""
    named = assign(rows, c, gt, normalize, out="_assigned")
    return {
        "miou": mean_iou(named, "_assigned", gt).first()[0],
        "oa": overall_accuracy(named, "_assigned", gt).first()[0],
        "ari": adjusted_rand(rows, c, gt).first()[0],
        "ami": adjusted_mutual_information(rows, c, gt),
    }
