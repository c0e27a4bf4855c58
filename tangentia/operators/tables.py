"""Tables that outlive their lineage, in the folder a session's executors share, and joins with small state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most numbers of a state that is broadcast to the observations.
BROADCAST_NUMBERS = 4_000_000
#: Parts that the rows of a key are dealt to where the state is too large to be broadcast.
DEAL = 16

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's executors share; only a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="tangentia-")
        _OWN[app] = root
    return f"{root.rstrip('/')}/tangentia/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: a lost executor costs a re-read of it, no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_state(rows: DataFrame, state: DataFrame, keys: Sequence[str], numbers: int, deal: int | None = None) -> DataFrame:
    """``rows`` whose key has a ``state``, with a struct ``_s`` of its other columns; null keys are equal.

    A state of up to ``BROADCAST_NUMBERS`` numbers (``numbers`` of them, as counted) is broadcast.  A larger one meets the
    rows by a shuffle in which each key's rows are dealt to ``deal`` parts (``DEAL`` unless given), so that those of a frequent key never meet in one task.
    """
    names = {k: f"_state_{k}" for k in keys}
    rest = [f"`{c}`" for c in state.columns if c not in keys]
    side = state.select(*[F.col(f"`{k}`").alias(s) for k, s in names.items()], F.struct(*rest).alias("_s"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{s}`")) for k, s in names.items()]
    if numbers <= BROADCAST_NUMBERS:
        return rows.join(F.broadcast(side), same, "inner").drop(*names.values())
    deal = deal or DEAL
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns]), F.lit(deal)).cast("int"))
    side = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    return rows.join(side, [*same, F.col("_deal") == F.col("_part")], "inner").drop("_deal", "_part", *names.values())
