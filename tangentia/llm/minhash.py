"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation of the shingle hashes gives two values, the least and the
greatest, so a signature of ``2 * permutations`` values takes half the hash
evaluations that plain min hashing needs; both are unbiased for the Jaccard
similarity and, being nearly independent, lower its variance.  Bands of
``rows`` values put documents into buckets.

Nothing depends on how many copies a text has:

* documents of equal sets become one *class* (its smallest id stands for it);
* the classes of a bucket are tied to the smallest class in it, which gives
  families of candidates without listing pairs;
* each family is compared inside one group while it fits in a block; a larger one
  is cut into blocks, and every pair of them is a group of its own, as long as a
  class thereby goes to no more groups than it has buckets;
* of families so large that this would send more, first every class meets the
  smallest class of each of its buckets, in groups of a block; then the buckets whose
  classes are still in different components are compared bucket by bucket, in blocks;
* a group prefilters by signature, confirms on the full sets, skips pairs that
  are already connected, and returns a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.common import HUBS, components, join_one, written
from tangentia.llm.shingles import WordHashes, jaccard_counts, mix, shingle_set

PERMUTATIONS, WIDTH = 176, 5
#: Most probability with which a pair at the threshold may share no band.
MISSED = 1e-6
#: Rows of equal sets above which their class is broadcast to them instead of meeting them by its key.
COPIES = 100_000
#: Classes in a bucket above which the bucket is broadcast to them instead of meeting them by its key.
SEATED = 100_000
#: Members and shingles of a block; a family within one block is one group.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 2_000_000
#: Standard deviations of the signature's estimate below the threshold at which a pair is not confirmed on its sets.
SLACK = 5.0

_rng = np.random.Generator(np.random.PCG64(20_240_817))
_FLIP = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-max signatures, one row of ``2 * PERMUTATIONS`` values for each non-empty set."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            v = (flat ^ _FLIP[k]) * _TIMES[k]
            out[:, 2 * k] = np.minimum.reduceat(v, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def missed(percent: int, rows: int) -> float:
    """Probability that a pair at the threshold shares no band of ``rows`` values."""
    return (1 - (percent / 100) ** rows) ** (2 * PERMUTATIONS // rows)


def rows_for(percent: int) -> int:
    """The longest bands that miss a pair at the threshold seldom enough: 8 values at 85, 6 at 80."""
    return next((r for r in range(16, 1, -1) if missed(percent, r) <= MISSED), 1)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """64-bit bucket keys, one for each band of ``rows`` values."""
    bands = sig.shape[1] // rows
    out = np.empty((len(sig), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(sig), np.uint64(b + 1), dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
            out[:, b] = acc
    return out


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _chunks(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _sketch(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text binary, t) -> (doc_id, t, n_shingles, h1, h2, bands of ``rows`` values)."""
    hashes = WordHashes()
    for batch in batches:
        for a, z in _chunks(batch):
            ids = batch.column("doc_id").slice(a, z - a)
            texts = batch.column("text").slice(a, z - a).to_pylist()
            sets = [shingle_set(hashes.of((t or b"").lower().split()), WIDTH) for t in texts]
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[k] for k in some]), rows).view(np.int64)
            per = keys.shape[1]
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            offsets[1:][some] = per
            h = [_signed(xxhash.xxh3_128_digest(s.tobytes())) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    batch.column("t").slice(a, z - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x[0] for x in h], pa.int64()),
                    pa.array([x[1] for x in h], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys.ravel())),
                ],
                ["doc_id", "t", "n_shingles", "h1", "h2", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, family, h1, h2, text binary) -> (class, family, sig binary, set binary) of the rows that have the class's set."""
    hashes = WordHashes()
    for batch in batches:
        for a, z in _chunks(batch):
            part = batch.slice(a, z - a).to_pydict()
            sets = [shingle_set(hashes.of((t or b"").lower().split()), WIDTH) for t in part["text"]]
            keep = [
                k
                for k, s in enumerate(sets)
                if len(s) and _signed(xxhash.xxh3_128_digest(s.tobytes())) == (part["h1"][k], part["h2"][k])
            ]
            sig = (signatures([sets[k] for k in keep]) >> np.uint64(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part["class"][k] for k in keep], pa.int64()),
                    pa.array([part["family"][k] for k in keep], pa.int64()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.array([sets[k].tobytes() for k in keep], pa.binary()),
                ],
                ["class", "family", "sig", "members"],
            )


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def link_group(ids: list[int], sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (class, smallest class of its component in this group).

    Pairs run from the most to the least similar estimate, and those already
    connected are skipped; the rest are confirmed on the full sets by the exact
    test ``100 * intersection >= percent * union``.
    """
    n = len(ids)
    order = sorted(range(n), key=lambda k: ids[k])
    ids, sets, sig = [ids[k] for k in order], [sets[k] for k in order], sig[order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    t, values = percent / 100, sig.shape[1]
    least = t - SLACK * (t * (1 - t) / values) ** 0.5
    forest = _Forest(n)
    estimates, lefts, rights = [], [], []
    for i in range(n - 1):
        agree = (sig[i + 1 :] == sig[i]).mean(axis=1)
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        near = np.flatnonzero((agree >= least) & (100 * small >= percent * large))
        estimates.append(agree[near])
        lefts.append(np.full(len(near), i))
        rights.append(near + i + 1)
    if n > 1:
        est, left, right = (np.concatenate(x) for x in (estimates, lefts, rights))
        for k in np.argsort(-est, kind="stable"):
            i, j = int(left[k]), int(right[k])
            if forest.find(i) != forest.find(j):
                inter, union = jaccard_counts(sets[i], sets[j])
                if 100 * inter >= percent * union:
                    forest.join(i, j)
    return [(ids[k], ids[forest.find(k)]) for k in range(n) if forest.find(k) != k]


def _linker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group: one group at a time is held."""

        def out(group) -> pa.RecordBatch:
            ids = list(group)
            sig = np.frombuffer(b"".join(group[k][0] for k in ids), dtype=np.uint8).reshape(len(ids), -1)
            found = link_group(ids, sig, [np.frombuffer(group[k][1], dtype=np.uint64) for k in ids], percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

        at, group = None, {}
        for batch in batches:
            part = batch.to_pydict()
            for key, name, sig, members in zip(
                zip(part["group"], part["i"], part["j"], strict=True), part["class"], part["sig"], part["members"], strict=True
            ):
                if key != at:
                    if len(group) > 1:
                        yield out(group)
                    at, group = key, {}
                group[name] = (sig, members)
        if len(group) > 1:
            yield out(group)

    return run


def _linked(groups: DataFrame, percent: int, tag: str) -> DataFrame:
    """Links ``(a, b)`` of ``groups`` (group, i, j, class, sig, members), each compared in one place, as a written table."""
    found = (
        groups.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_linker(percent), "a long, b long")
    )
    return written(found, tag)


def _block_pairs(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """``rows`` (group, class, ...) with ``i`` and ``j``: every class of a group with the pairs of its block and each block.

    ``crowd`` (group, docs, blocks) has the sizes; rows of other groups are left out.  The pair of a block with itself comes with every other pair.
    """
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")
    rows = join_one(rows, crowd, ["group"], "docs", COPIES, "class").where("blocks is not null")
    x = rows.select("*", own, other).where("own <> x or blocks = 1")
    rest = [c for c in rows.columns if c not in ("group", "blocks")]
    return x.select("group", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), *rest)


def _judged(docs: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """``(doc_id, t, n_shingles, component_id, kept)`` of ``docs`` (doc_id, text binary, t), ``t`` being any long of the row."""
    sketch = written(
        docs.mapInArrow(
            partial(_sketch, rows_for(percent)), "doc_id long, t long, n_shingles long, h1 long, h2 long, bands array<long>"
        ),
        "sketch",
    )
    classes = (
        sketch.where("doc_id is not null and n_shingles > 0")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    )
    classes = written(classes, "classes")
    # a class goes by its smallest id, or where an id has several texts, by its fingerprint
    shared = classes.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select("rep", F.lit(True).alias("shared"))
    several = shared.limit(1).count() > 0
    if several:
        name = F.when(F.col("shared"), F.xxhash64("h1", "h2")).otherwise(F.col("rep"))
        classes = written(classes.join(shared, "rep", "left").withColumn("class", name).drop("shared"), "classes")
    else:
        classes = classes.withColumn("class", F.col("rep"))
    seats = classes.select("class", F.explode("bands").alias("bucket"))
    crowded = seats.groupBy("bucket").agg(F.min("class").alias("b"), F.max("class").alias("top"), F.count("*").alias("seated")).where("b < top").drop("top")
    # the seats of a bucket of very many classes are dealt by class
    seats = join_one(seats, crowded, ["bucket"], "seated", SEATED, "class", "shuffle_hash").where("b is not null")
    ties = seats.where("class <> b").select(F.col("class").alias("a"), "b")
    families = components(ties).select(F.col("node").alias("class"), F.col("label").alias("family"))
    families = written(families.join(classes.select("class", "rep", "h1", "h2", "n"), "class"), "families")

    # the texts move once, at any size, unsorted
    sets = written(
        docs.select("doc_id", "text")
        .join(families.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id")
        .select("class", "family", "h1", "h2", "text")
        .mapInArrow(_full_sets, "class long, family long, sig binary, members binary"),
        "sets",
    )
    crowd = families.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    crowd = written(crowd.select("family", "docs", blocks.alias("blocks")), "crowd")
    if crowd.where("blocks > 1").limit(1).count():
        # families of which a class goes to fewer groups by its buckets than by its family's blocks
        cut = families.select("class", "n", "family").join(crowd.where("blocks > 1"), "family")
        seats = written(seats.join(cut.select("class", "n", "family"), "class"), "seats")
        sent = seats.groupBy("family").agg(F.count("*").alias("sent"))
        vast = crowd.join(sent, "family").where(F.col("docs") * F.col("blocks") > F.col("sent")).select("family")
        vast = written(vast, "vast")
    else:
        vast = crowd.where("blocks > 1").select("family")
    whole = crowd.join(vast, "family", "left_anti").select(F.col("family").alias("group"), "docs", "blocks")
    # most sets move once, to where their family is compared
    found = _linked(_block_pairs(sets.withColumnRenamed("family", "group"), whole), percent, "links")
    if vast.limit(1).count():
        seats = seats.join(vast, "family", "left_semi")
        stars = seats.where("class <> b").groupBy("class", "b").agg(F.first("n").alias("n"))
        arms = stars.groupBy("b").agg(
            F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
        )
        arm = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("i")
        members = stars.select("class", "b").join(arms, "b").select(F.col("b").alias("group"), arm, F.lit(0).alias("j"), "class")
        centres = arms.select(
            F.col("b").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.col("b").alias("class")
        )
        own = sets.select("class", "sig", "members")
        first = _linked(members.unionByName(centres).join(own, "class"), percent, "links")
        so_far = components(first).select(F.col("node").alias("class"), "label")
        open_ = seats.join(so_far, "class", "left").withColumn("label", F.coalesce("label", "class"))
        of = open_.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("docs"), F.sum("n").alias("shingles")
        )
        of = of.where("low < high").select(F.col("bucket").alias("group"), "docs", blocks.alias("blocks"))
        rest = _block_pairs(seats.select(F.col("bucket").alias("group"), "class"), of)
        found = found.unionAll(first).unionAll(_linked(rest.join(own, "class"), percent, "links"))
    linked = components(found).select(F.col("node").alias("class"), "label")
    named = classes.select("h1", "h2", "class", "rep", "copies").join(linked, "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    copies = max(COPIES, (classes.agg(F.sum("copies")).first()[0] or 0) // HUBS)
    if several:  # labels needn't be ids
        ids = named.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("k"))
        named = join_one(named, ids, ["label"], "k", copies, "class")
    else:
        named = named.withColumn("component", F.col("label"))
    named = named.select("h1", "h2", "component", "copies")
    # texts without words meet no class; a key of their own spreads them
    left = sketch.select(
        "doc_id",
        "t",
        "n_shingles",
        F.coalesce("h1", F.xxhash64("doc_id")).alias("h1"),
        F.coalesce("h2", F.lit(0)).alias("h2"),
        F.col("h1").isNotNull().alias("has"),
    )
    has = F.col("has") & F.col("doc_id").isNotNull()
    return join_one(left, named, ["h1", "h2"], "copies", copies, "doc_id").select(
        "doc_id",
        "t",
        "n_shingles",
        F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("component") == F.col("doc_id")).otherwise(F.lit(True)).alias("kept"),
    )


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``documents``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| on their sets
    of distinct 5-word shingles; ``component_id`` is the smallest id reachable
    over links and ``kept`` marks the document that carries it.

    Null or empty texts have ``n_shingles`` 0 and are linked with nothing.  A
    row with a null id is linked with nothing either: its component is null and
    it is kept.  Rows that repeat an id with the same text all get the same
    result; an id with different texts is judged for each text.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("t")
    )
    return _judged(docs, percent, block_docs, block_shingles).drop("t")


def keep_distinct(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``documents`` that stand for their near duplicates, with its own columns only.

    An id with different texts is judged for each; rows with a null id or no text stay,
    and so do all rows that repeat the id and text of one that stays.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("t")
    )
    found = _judged(docs, percent, BLOCK_DOCS, BLOCK_SHINGLES)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")).distinct()
    same = (documents[id_col].cast("long") == gone["_gone"]) & (F.xxhash64(documents[text_col]) == gone["_t"])
    return documents.join(gone.hint("shuffle_hash"), same, "left_anti")
