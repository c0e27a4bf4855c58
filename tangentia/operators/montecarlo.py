"""Monte-Carlo errors of estimators: one row for each trial, a seed of its own for each.

Truths may be points at hand, or the estimates of a table's samples: then trials are drawn around each row
(:func:`around`), or from a sample's own observations (:func:`subsamples`), wherever the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.operators.features import Feature


def trials(
    spark: SparkSession, truths: dict[str, Any], sampler: Callable[[np.random.Generator], np.ndarray], features: dict[str, Feature], n_trials: int, seed: int = 0, partitions: int | None = None
) -> DataFrame:
    """``(trial, feature, component, error)``: distances of every trial's estimates to the truth.

    ``features`` are bound; component 0 is the whole, those of a product follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["id"]:
                x = sampler(np.random.default_rng([seed, int(t)]))
                for name, f in features.items():
                    for k, d in enumerate(f.distances(f.estimation(x), truths[name])):
                        rows.append((int(t), name, k, d))
            yield pd.DataFrame(rows, columns=["trial", "feature", "component", "error"])

    ids = spark.range(0, n_trials, 1, partitions or spark.sparkContext.defaultParallelism)
    return ids.mapInPandas(run, "trial long, feature string, component int, error double")


def monte_carlo(*args, **kwargs) -> DataFrame:
    """``(feature, component, mse)``: mean squared errors over the trials of :func:`trials`."""
    return trials(*args, **kwargs).groupBy("feature", "component").agg(F.avg(F.col("error") * F.col("error")).alias("mse"))


def around(
    estimates: DataFrame, keys: list[str], feature: Feature, sampler: Callable[[Any, int, np.random.Generator], np.ndarray], n_trials: int, n: int, seed: int = 0
) -> DataFrame:
    """``(keys, trial, component, error)``: distances of estimates to the row's point ``f`` that they were drawn around.

    ``sampler(point, n, rng)`` draws a p x n matrix; ``feature`` is bound.  A trial's seed follows from the seed, its number and the row's
    keys, so reruns agree however the table is partitioned.  Component 0 is the whole, those of a product follow.  Rows with a null point have no trials.
    """
    rows = estimates.where("f is not null").select(*[f"`{k}`" for k in keys], "f", F.crc32(F.to_json(F.struct(*[f"`{k}`" for k in keys]))).alias("_key"))
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trials - 1).cast("long"))))
    own = rows.select(*[f"`{k}`" for k in keys], "trial").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            points = feature.decode(batch.column("f"))
            found, at = [], []
            for i, (key, trial) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("trial").to_pylist(), strict=True)):
                truth = tuple(a[i] for a in points) if isinstance(points, tuple) else points[i]
                x = sampler(truth, n, np.random.default_rng([seed, trial, key]))
                for k, d in enumerate(feature.distances(feature.estimation(x), truth)):
                    found.append((k, d))
                    at.append(i)
            taken = batch.take(pa.array(at, pa.int64()))
            columns = [taken.column(f.name) for f in own.fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.float64())], [*own.names, "component", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.fields)
    return rows.mapInArrow(run, f"{schema}, component int, error double")


def subsamples(samples: DataFrame, by: list[str], n_trials: int, share: float = 0.5, seed: int = 0) -> DataFrame:
    """``samples`` with ``trial``: of each trial the rows whose hash of ``by`` and the trial falls into ``share`` of its range.

    The draw is a function of the row, so it needs no order and no shuffle, and rows equal in ``by`` stay together.  Nulls in ``by`` count as empty.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    return samples.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))).where(drawn)


def summarize(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and population standard deviation of ``value`` over experiments."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def samples(spark: SparkSession, n: int, p: int, sampler: Callable[[int, np.random.Generator], np.ndarray], seed: int = 0, partitions: int = 8) -> DataFrame:
    """``(obs_idx, x array<double>)``: n observations drawn in ``partitions`` parts, each with a seed of its own.

    ``sampler(m, rng)`` gives a real p x m matrix; the parts are the same for any cluster.
    """
    sizes = [n // partitions + (k < n % partitions) for k in range(partitions)]
    firsts = np.cumsum([0, *sizes])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                x = sampler(sizes[k], np.random.default_rng([seed, int(k)]))
                yield pd.DataFrame({"obs_idx": np.arange(firsts[k], firsts[k + 1]), "x": list(x.T)})

    return spark.range(0, partitions, 1, partitions).mapInPandas(run, "obs_idx long, x array<double>")
