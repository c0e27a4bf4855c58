"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, ``-ln(u) / quality``, from a hash of
its id, so a rerun draws the same.  Within a source, documents stand in order
of their keys.  A source whose target is above its size gives complete epochs
first; the rest of its target is filled by the documents at the front, whose
sizes are summed up to the budget.

The running sum is never taken over a whole source in one task: quantiles of
a source's actual keys cut it into buckets, whose sums find the one
where the budget ends; that is cut again until it is small, and only then sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangentia.llm.common import HUBS, join_one, written

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
#: Sources that are put in order by one task, and documents of a source from which its plan is broadcast to them.
ORDERED, HOT = 100_000, 100_000
#: Documents up to which the bucket where a budget ends is sorted, and the buckets of one cut.
BUCKET_DOCS, CUTS = 2_000, 64
SPACE = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def quality_of(text: Column) -> Column:
    """Quality weight, 0.05 to 1: the share of letters (all of non-ASCII counts) among a text's non-space characters."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    others = F.length(F.regexp_replace(text, SPACE, ""))
    return F.coalesce(F.greatest(F.round(letters / F.greatest(others, F.lit(1)), 6), F.lit(0.05)), F.lit(0.05))


def _in_order(rows: DataFrame, n: int, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """The ``n`` ``rows`` with their rank ``k`` from 1 in ``order``, and under the keys of ``sums`` the sums of columns over all rows before.

    Ranges of the order are put in order each by a task; only their counts and sums come together.
    """
    parts = max(1, -(-n // ORDERED))
    rows = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    each = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{j}") for j, c in enumerate(sums.values())])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = each.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in each.columns[1:]])
    rows = rows.join(F.broadcast(ahead), "_part")
    own = Window.partitionBy("_part").orderBy(*order)
    within = own.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *[c for c in rows.columns if c not in ("_part", *each.columns)],
        (F.row_number().over(own) + F.col("_n")).alias("k"),
        *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_s{j}")).alias(name) for j, (name, c) in enumerate(sums.items())],
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, docs, target)`` from ``(source, source_size, docs)``, one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of
    all sizes; a target stops at ``cap`` times its source's size and the excess
    goes to the others by weight until none is above.  In closed form: with
    sources in order of cap / weight, the first that the even share of what is
    left doesn't overfill ends the capped ones.
    """
    sizes = written(sizes, "sources")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    by_name = [F.col("source").asc_nulls_last()]
    t = _in_order(sizes, n, by_name, {}).withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("k") - 1, F.lit(len(weights))).cast("int")))
    t = t.drop("k").withColumn("most", cap * F.col("source_size")).withColumn("r", F.col("most") / F.col("w"))
    t = _in_order(t, n, [F.col("r").asc(), *by_name], {"full": "most", "gone": "w"})
    t = written(t, "shares")
    all_weights = t.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    share = (F.lit(total) - F.col("full")) / (F.lit(all_weights) - F.col("gone"))
    level = t.select(share.alias("share"), "r", "k").where("share <= r").agg(F.min_by("share", "k")).first()[0]
    return t.select("source", "source_size", "docs", F.least(F.col("most").cast("double"), F.lit(level).cast("double") * F.col("w")).alias("target"))


#: A source as a key of joins, null apart from every name.
def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _planned(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` whose source has a row in ``plan`` (name, docs, ...), with its columns; those of a large source stay where they are dealt by key."""
    held = [c for c in plan.columns if c not in ("name", "docs")]
    out = join_one(rows.withColumn("name", _name(F.col("source"))), plan.select("name", "docs", F.struct(*held).alias("_plan")), ["name"], "docs", most, "key")
    return out.where("_plan is not null").select(*rows.columns, "name", "_plan.*")


def _edges(docs: DataFrame, plan: DataFrame, bucket_docs: int, most: int) -> DataFrame:
    """``plan`` with the range (low, high] of keys in which each source's budget ends, and the size ``before`` it.

    A source stays as it is once its range holds no more than ``bucket_docs`` documents or can't be cut
    further (equal keys); ``high`` is null where the budget takes the whole source.
    """
    edges = plan.select(
        "*", F.lit(-1.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"),
        (F.col("docs") > bucket_docs).alias("open"), F.col("docs").alias("left"),
    )
    own = edges.columns
    while edges.where("open").limit(1).count():
        live = edges.where("open").select("name", "docs", "budget", "before", "low", "high")
        cuts = _planned(docs, live, most).where("key > low and key <= high").groupBy("name").agg(
            F.percentile_approx("key", [k / CUTS for k in range(1, CUTS)], 4096).alias("cuts")
        )
        placed = _planned(docs, live.join(cuts, "name"), most).where("key > low and key <= high")
        placed = placed.withColumn("k", F.size(F.filter("cuts", lambda x: x < F.col("key"))))
        sums = placed.groupBy("name", "budget", "before", "k").agg(
            F.sum("size").alias("s"), F.count("*").alias("n"), F.max("key").alias("top")
        )
        # at most CUTS rows of a source
        upto = Window.partitionBy("name").orderBy("k")
        z = F.col("before") + F.sum("s").over(upto)
        sums = sums.select("name", "budget", "k", "s", "n", "top", z.alias("z"), F.coalesce(F.lag("top").over(upto), F.lit(-1.0)).alias("under"))
        ends = sums.where("z > budget").groupBy("name").agg(
            F.min(F.struct("k", "top", "under", (F.col("z") - F.col("s")).alias("before"), "n")).alias("e")
        )
        went = F.col("open") & F.col("e").isNotNull()
        edges = edges.join(ends, "name", "left").select(
            *plan.columns,
            F.when(went, F.greatest("low", "e.under")).otherwise(F.col("low")).alias("low"),
            F.when(went, F.col("e.top")).when(~F.col("open"), F.col("high")).alias("high"),
            F.when(went, F.col("e.before")).otherwise(F.col("before")).alias("before"),
            (went & (F.col("e.n") > bucket_docs) & (F.col("e.n") < F.col("left"))).alias("open"),
            F.when(went, F.col("e.n")).otherwise(F.col("left")).alias("left"),
        )
        edges = written(edges.select(*own), "edges")
    return edges


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``documents``.

    ``taken`` is the number of words the mix takes from the document, repeats
    counted: its size for each complete epoch of its source, once more if it is
    in the fractional part.  The document where the budget ends is cut there, so
    a source meets its target to the word.  A null text has size 0; null sources
    are one source; rows that repeat an id and text are taken one after the other.
    """
    base = _drawn(documents, seed, id_col, text_col, source_col, [])
    return _taken(written(base, "sizes"), None, weights, cap, bucket_docs)


def take(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """The rows of ``documents`` of which :func:`mix` takes words, with all their columns and ``taken`` (which replaces one so named).

    Texts don't move but for those in the ranges where the budgets end.
    """
    own = [c for c in documents.columns if c.lower() != "taken"]
    base = written(_drawn(documents, seed, id_col, text_col, source_col, []), "sizes")
    rows = _drawn(documents, seed, id_col, text_col, source_col, own)
    out = _taken(base, rows, weights, cap, bucket_docs).where("taken > 0")
    return out.select(*[F.col(f"_own.`{c}`").alias(c) for c in own], "taken")


def _drawn(documents: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, own: list[str]) -> DataFrame:
    """``(doc_id, source, size, key, tie)``, and the columns ``own`` as a struct ``_own`` if there are any."""
    text = F.col(text_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), ident)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = F.struct(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size_of(text).alias("size"),
        (-F.log(u) / quality_of(text)).alias("key"),
        F.md5(F.coalesce(text, F.lit(""))).alias("tie"),
    )
    kept = [F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own")] if own else []
    # out of a generator, below which no filter is pushed: that would draw anew for each use
    return documents.select(*kept, F.inline(F.array(drawn)))


def _taken(base: DataFrame, rows: DataFrame | None, weights: tuple[int, ...], cap: int, bucket_docs: int) -> DataFrame:
    """``rows`` (``base`` if there are none) with what the mix takes, the budgets' ends being found in ``base``."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = written(targets(sizes, weights, cap), "targets")
    plan = plan.select(
        _name(F.col("source")).alias("name"),
        "source_size",
        "docs",
        "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).alias("epochs"),
    ).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    most = max(HOT, (plan.agg(F.sum("docs")).first()[0] or 0) // HUBS)
    ends = _edges(base, plan, bucket_docs, most).drop("open", "left")
    rows = base if rows is None else rows
    docs = _planned(rows, ends, most).drop("name")
    within = (F.col("key") > F.col("low")) & (F.col("key") <= F.coalesce("high", F.lit(-1.0)))
    # below the range, or in a source that is taken as a whole
    under = F.col("high").isNull() | (F.col("key") <= F.col("low"))
    whole = docs.where(~within).withColumn("once", F.when(under, F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = docs.where(within).withColumn("z", F.col("before") + F.sum("size").over(inside))
    room = F.col("budget") - (F.col("z") - F.col("size"))
    edge = edge.withColumn("once", F.greatest(F.least(F.col("size"), room), F.lit(0))).drop("z")
    return whole.unionByName(edge).select(
        *[c for c in rows.columns if c == "_own"],
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("once")).cast("long").alias("taken"),
    )
