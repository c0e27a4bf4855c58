"""Estimators that are algebraic in the observations, as built-in aggregates.

Samples are in long form: one row for each observation, the sample's key in one
or more columns and the channels in columns of their own, so that the scan reads
no more than it needs and every estimator is one partial aggregation and one
shuffle of its small result.  Complex channels are pairs of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flat(rows: list[list[Column]]) -> Column:
    return F.array(*[x for row in rows for x in row])


def second_moments(channels: Sequence[Column], centered: bool = True) -> list[list[Column]]:
    """Aggregates of the p x p sample covariance, divisor N: about zero, or about the mean.

    Only the upper triangle is aggregated.
    """
    p = len(channels)

    def one(i: int, j: int) -> Column:
        a, b = channels[i], channels[j]
        return F.avg(a * b) if centered else F.covar_pop(a, b)

    upper = {(i, j): one(i, j) for i in range(p) for j in range(i, p)}
    return [[upper[min(i, j), max(i, j)] for j in range(p)] for i in range(p)]


def covariance(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], assume_centered: bool = True) -> DataFrame:
    """Sample covariance of every sample as ``(keys, n, f struct<c0 array<double>>)``, row-major."""
    cols = [F.col(c) for c in channels]
    sigma = _flat(second_moments(cols, assume_centered))
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(sigma.alias("c0")).alias("f"))


def complex_covariance(
    samples: DataFrame, keys: Sequence[str], channels: Sequence[tuple[str, str]], assume_centered: bool = True
) -> DataFrame:
    """Hermitian sample covariance of complex channels, given as (real, imaginary) columns: ``c0 struct<re, im>``."""
    parts = [(F.col(a), F.col(b)) for a, b in channels]

    def mean(x: Column, y: Column) -> Column:
        return F.avg(x * y) if assume_centered else F.covar_pop(x, y)

    re = [[mean(a, c) + mean(b, d) for c, d in parts] for a, b in parts]
    im = [[mean(b, c) - mean(a, d) for c, d in parts] for a, b in parts]
    both = F.struct(_flat(re).alias("re"), _flat(im).alias("im"))
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(both.alias("c0")).alias("f"))


def mean_vector(samples: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean of every channel."""
    mu = F.array(*[F.avg(c) for c in channels])
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(mu.alias("c0")).alias("f"))


def gaussian(samples: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean and covariance about it."""
    cols = [F.col(c) for c in channels]
    mu = F.array(*[F.avg(c) for c in cols])
    sigma = _flat(second_moments(cols, centered=False))
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(mu.alias("c0"), sigma.alias("c1")).alias("f"))


def center_observation(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The observation in the middle (index N div 2 in ``order``) of every sample.

    Kept by a filter on the row number; the order must be total within a sample.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    picked = samples.select(
        *keys,
        *channels,
        (F.row_number().over(w.orderBy(*order)) - 1).alias("_at"),
        F.count("*").over(w).alias("n"),
    ).where(F.col("_at") == F.floor(F.col("n") / 2))
    return picked.select(*keys, "n", F.struct(F.array(*channels).alias("c0")).alias("f"))


def norm(x: Column) -> Column:
    """Euclidean norm of an array column."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def center_intensity(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Norm of the middle observation."""
    mid = center_observation(samples, keys, channels, order)
    return mid.withColumn("f", F.struct(F.array(norm(F.col("f.c0"))).alias("c0")))


def intensities(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Norms of all observations in order; the length of a sample is the length of its feature."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0])))
    pairs = F.array_sort(F.collect_list(F.struct(*order, n.alias("_norm"))))
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), pairs.alias("_p"))
    return out.select(*keys, "n", F.struct(F.transform("_p", lambda x: x["_norm"]).alias("c0")).alias("f"))


def packed(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every sample as one row-major p x N matrix, for estimators that need all observations together."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(channels)])))
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), rows.alias("_r"))
    flat = F.concat(*[_channel(i) for i in range(len(channels))])
    return out.select(*keys, "n", F.struct(flat.alias("c0")).alias("f"))


def _channel(i: int) -> Column:
    return F.transform("_r", lambda r: r[f"_x{i}"])


def unit_determinant_2x2(s00: Column, s01: Column, s11: Column) -> tuple[Column, Column, Column, Column]:
    """A symmetric 2 x 2 matrix scaled to determinant 1, and the scale that was taken out."""
    c = F.sqrt(s00 * s11 - s01 * s01)
    return s00 / c, s01 / c, s11 / c, c
