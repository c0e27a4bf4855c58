"""Session-level helpers: shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}

#: Letters that the contracts lower-case, and their lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one the context was given.

    Where there is neither, a local session (tests) gets one of its own; a
    cluster is refused, as its executors share no folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="tangentia-")
    return _OWN_DIRS[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of what went before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tangentia/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table of :func:`written` that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _content(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], count: str, most: int, spread: str, hint: str | None = None) -> DataFrame:
    """Left join of ``rows`` with ``one``, which has a row for each key, without a task for all rows of a frequent key.

    ``one[count]`` is at least the number of ``rows`` of its key.  Keys with more than ``most`` are
    broadcast, of which there are no more than all counts over ``most``; their rows are
    dealt by ``spread`` as well.  Key and ``count`` columns of ``one`` are not added.  ``hint`` is for the join with the other keys:
    ``shuffle_hash`` where ``rows`` are too large to be sorted.
    """
    added = [c for c in one.columns if c not in (*keys, count)]
    frequent = one.where(F.col(count) > most).select(*keys, F.struct(*added).alias("_frequent"))
    # 0, but not as a constant, which would be taken out of the join's keys
    nought = F.pmod(F.col(count).cast("int"), F.lit(1)).alias("_deal")
    others = one.where(F.col(count) <= most).select(*keys, nought, F.struct(*added).alias("_other"))
    others = others.hint(hint) if hint else others
    x = rows.join(F.broadcast(frequent), keys, "left")
    deal = F.when(F.col("_frequent").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(65_536)).cast("int"))
    x = x.withColumn("_deal", deal).join(others, [*keys, "_deal"], "left")
    return x.select(*rows.columns, *[F.coalesce(F.col(f"_frequent.{c}"), F.col(f"_other.{c}")).alias(c) for c in added])


#: Neighbours from which a node counts as frequent, and the most of such nodes (which are broadcast).
HUB, HUBS = 1_000, 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, label)``.

    Alternating large-star and small-star rounds; every round is a
    constant number of aggregates and joins over at most as many rows as there
    are edges.  A node with very many neighbours is a broadcast row of the joins
    (:func:`join_one`), so its edges are never gathered in one place.
    ``label`` is the smallest node of the component.  Nodes without an
    edge to another node are not returned; null ends and loops are ignored.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = written(e, "edges")
    before = _content(e)
    for _ in range(max_rounds if before[0] else 0):
        hub = max(HUB, 2 * before[0] // HUBS)
        # large star: every larger neighbour of u is tied to the least node around u
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_one(both.where("v > u"), least, ["u"], "n", hub, "v")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            join_one(large, low, ["u"], "n", hub, "v")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, e = e, written(small, "edges")
        after = _content(e)
        forget(old)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def lower_az(column):
    """Lower-case A-Z only; ASCII texts take the fast path of ``lower``."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, LOWER)
    )
