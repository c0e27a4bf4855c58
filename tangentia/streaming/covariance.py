"""Covariances of a stream in event-time windows.

An extension: sample covariance is an algebraic aggregate, so stock windowed
aggregation with a watermark is all it takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.operators.estimate import second_moments


def windowed_covariance(
    stream: DataFrame,
    channels: Sequence[str],
    time_col: str = "ts",
    keys: Sequence[str] = (),
    length: str = "1 day",
    slide: str | None = None,
    lateness: str = "1 hour",
    assume_centered: bool = True,
) -> DataFrame:
    """``(window_start, keys, n, f)`` for every window; works on streams and on tables alike."""
    sigma = F.array(*[x for row in second_moments([F.col(c) for c in channels], assume_centered) for x in row])
    at = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    if stream.isStreaming:
        stream = stream.withWatermark(time_col, lateness)
    out = stream.groupBy(at.alias("_w"), *keys).agg(F.count("*").alias("n"), F.struct(sigma.alias("c0")).alias("f"))
    return out.select(F.col("_w.start").alias("window_start"), *keys, "n", "f")
