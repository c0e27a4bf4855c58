"""Benchmark decontamination over a distributed positional inverted index, in SQL operations only.

The benchmark's texts are cut into windows of ten words.  For every window its
rarest terms are chosen by their counts over all documents; only the postings
(document, position) of those terms are stored.  Shifted by the terms' offsets
in a window, the lists of its two rarest terms are intersected; what is left is
confirmed against the whole window in the document.

Rarity costs one scan, postings a second, confirmation a third, in which texts stay where they are; no document is
compared with an item that doesn't share its two rarest words at the right
distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.llm.common import HUBS, join_one, lower_az, written

#: What separates words once A-Z is lower-cased: all of ASCII but 0-9 and a-z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Most characters of a benchmark whose terms and windows are broadcast; a larger one is joined by shuffles.
BROADCAST_CHARS = 4_000_000
#: Most candidate places, or documents with a window, that are broadcast to the texts; more meet them by a shuffle.
FEW = 1_000_000
#: On the way of shuffles: occurrences of a term above which it is broadcast, and the parts that its postings are dealt to.
OFTEN, PARTS = 1_000_000, 16


def tokens(text: Column) -> Column:
    """Words of a text by position; null gives none."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BREAK), "")


def _print_of(words: Column) -> list[Column]:
    """96 bits that stand for a sequence of words."""
    return [F.xxhash64(words).alias("w1"), F.hash(words).alias("w2")]


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``(item_id, len, terms)``: the windows of every item; one of all its words if it has fewer than ``width``."""
    t = benchmark.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col)).alias("t"))
    n = F.size("t")
    starts = F.when(n >= width, F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))).when(n > 0, F.array(F.lit(1)))
    t = t.select("item_id", "t", F.explode(starts).alias("s"))
    terms = F.slice("t", F.col("s"), F.lit(width))
    return t.select("item_id", terms.alias("terms")).select("item_id", F.size("terms").alias("len"), "terms").distinct()


class Index:
    """Positional inverted index of ``documents`` over the terms that a benchmark's phrases need."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, small: bool):
        #: ``key`` stands for a document's id and text: rows that repeat both share their results
        self.docs = documents.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
            F.col(text_col).alias("text"),
        )
        self.small = small

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def counts(self, terms: DataFrame) -> DataFrame:
        """``(term, n)``: occurrences of the given terms in all documents."""
        every, wanted = self.docs.select(F.explode(tokens(F.col("text"))).alias("term")), terms.select("term").distinct()
        if self.small:
            return every.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n"))
        # words are counted where they are before any is moved
        return every.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term")

    def postings(self, terms: DataFrame, counts: DataFrame) -> DataFrame:
        """``(term, key, pos)`` of the given terms, as a written table; ``counts`` (term, n) tells which are frequent."""
        every = self.docs.select("key", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
        wanted = terms.select("term").distinct()
        if self.small:
            return written(every.join(F.broadcast(wanted), "term").distinct(), "postings")
        wanted = wanted.join(counts.select("term", "n"), "term").withColumn("wanted", F.lit(True))
        most = max(OFTEN, (counts.agg(F.sum("n")).first()[0] or 0) // HUBS)
        found = join_one(every, wanted, ["term"], "n", most, "key").where("wanted")
        return written(found.select("term", "key", "pos").distinct(), "postings")

    def meet(self, postings: DataFrame, side: DataFrame) -> DataFrame:
        """Postings with the rows of ``side`` of their term; a frequent term's are dealt to several tasks."""
        if self.small:
            return postings.join(F.broadcast(side), "term")
        dealt = postings.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
        every = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        return dealt.join(every, ["term", "_part"]).drop("_part")


def _is_small(benchmark: DataFrame, text_col: str) -> bool:
    size = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    return size <= BROADCAST_CHARS


def phrase_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> tuple[Index, DataFrame, DataFrame]:
    """The index, the written windows ``(w1, w2, len, item_id, terms)`` and the candidates ``(key, start, w1, w2, len)``.

    A candidate has the window's two rarest terms at the right places; whoever
    reads the document's words confirms the rest.
    """
    index = Index(documents, id_col, text_col, _is_small(benchmark, item_text_col))
    items = windows_of(benchmark, item_col, item_text_col, width)
    items = written(items.select(*_print_of(F.col("terms")), "len", "item_id", "terms"), "windows")
    windows = items.groupBy("w1", "w2", "len").agg(F.first("terms").alias("terms"))
    by_term = windows.select("w1", "w2", "len", F.posexplode("terms").alias("off", "term"))
    rarity = written(index.counts(by_term), "rarity")
    # the first place of each term in the window, rarest terms first; a term that no document has rules its window out
    places = by_term.groupBy("w1", "w2", "len", "term").agg(F.min("off").alias("off")).join(
        index._side(rarity), "term", "left"
    )
    rarest = (
        places.groupBy("w1", "w2", "len")
        .agg(
            F.slice(
                F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))), 1, 2
            ).alias("r")
        )
        .where(F.col("r")[0]["n"] > 0)
    )
    rarest = written(rarest, "rarest")
    first = rarest.select("w1", "w2", "len", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["off"].alias("off"))
    second = rarest.where(F.size("r") > 1).select(
        "w1", "w2", "len", F.col("r")[1]["term"].alias("term"), F.col("r")[1]["off"].alias("off")
    )
    postings = index.postings(first.unionAll(second), rarity)

    def shifted(side: DataFrame) -> DataFrame:
        found = index.meet(postings, side)
        return found.select("key", (F.col("pos") - F.col("off")).alias("start"), "w1", "w2", "len")

    alone = rarest.where(F.size("r") == 1).select("w1", "w2")
    both = shifted(first.join(alone, ["w1", "w2"], "left_anti")).join(
        shifted(second), ["key", "start", "w1", "w2", "len"]
    )
    single = shifted(first.join(alone, ["w1", "w2"], "left_semi"))
    return index, items, both.unionAll(single).where("start >= 0")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``documents``.

    A word is hit if it lies in an occurrence of a benchmark window;
    ``n_items`` counts the items with an occurring window and ``items_sha256``
    is the digest of their ids.  Null texts have no words; null item ids
    count as no item but their windows still hit; rows that repeat an id and
    text get equal results, an id with different texts is judged for each.
    """
    return _judged(documents, benchmark, id_col, text_col, item_col, item_text_col, width).drop("key")


def _few(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table as one side of a join with all texts: broadcast if it is small, so that they stay where they are."""
    n = rows.agg(F.count("*") if size is None else F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if n <= FEW else rows.hint("shuffle_hash")


def _judged(
    documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW
) -> DataFrame:
    """What :func:`decontaminate` returns, with the ``key`` of each row's id and text."""
    index, items, candidates = phrase_hits(documents, benchmark, id_col, text_col, item_col, item_text_col, width)
    per_doc = written(candidates.groupBy("key").agg(F.collect_set(F.struct("start", "len", "w1", "w2")).alias("found")), "candidates")
    words = F.col("words")

    def holds(c: Column) -> Column:
        part = F.slice(words, c["start"] + 1, c["len"])
        return (F.xxhash64(part) == c["w1"]) & (F.hash(part) == c["w2"])

    # the texts don't move unless very many are candidates
    docs = index.docs.join(_few(per_doc, F.size("found")), "key", "left")
    docs = docs.select("doc_id", "key", tokens(F.col("text")).alias("words"), "found")
    docs = docs.select("doc_id", "key", F.size("words").alias("n_words"), F.filter("found", holds).alias("hits"))
    spans = F.sort_array(F.transform("hits", lambda c: F.struct(c["start"].alias("a"), (c["start"] + c["len"]).alias("z"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("z")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["z"] - F.greatest(s["a"], acc["z"]), F.lit(0))).alias("n"),
            F.greatest(acc["z"], s["z"]).alias("z"),
        ),
        lambda acc: acc["n"],
    )
    docs = written(
        docs.select(
            "doc_id",
            "key",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda c: F.struct(c["w1"].alias("w1"), c["w2"].alias("w2")))).alias("hits"),
        ),
        "hits",
    )
    named = items.where("item_id is not null").select("w1", "w2", "item_id")
    occurring = (
        docs.where("n_hit > 0")
        .select("key", F.explode("hits").alias("h"))
        .select("key", "h.w1", "h.w2")
        .distinct()
        .join(index._side(named), ["w1", "w2"])
        .groupBy("key")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )
    out = docs.join(occurring, "key", "left")
    listed = F.coalesce(F.array_join(F.sort_array("items"), ","), F.lit(""))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def proximity_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    slop: int = 20,
    terms: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, pos)``: where an item's rarest terms meet in any order.

    ``pos`` is a place of the item's rarest term with each of its next rarest
    (``terms`` of them together, fewer if the item has fewer) within ``slop``
    words.  Terms that no document has don't count: an altered copy of an item, in
    which a word was changed, is found by the others.
    """
    index = Index(documents, id_col, text_col, _is_small(benchmark, item_text_col))
    every = benchmark.select(
        F.col(item_col).alias("item_id"), F.explode(F.array_distinct(tokens(F.col(item_text_col)))).alias("term")
    )
    rarity = written(index.counts(every), "rarity")
    ranked = every.join(index._side(rarity), "term").groupBy("item_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct("n", "term"))), 1, terms).alias("r")
    )
    ranked = written(ranked.select("item_id", F.posexplode("r").alias("rank", "x"), F.size("r").alias("of")), "ranked")
    ranked = ranked.select("item_id", "rank", "of", F.col("x.term").alias("term"))
    placed = index.meet(index.postings(ranked, rarity), ranked).select("key", "item_id", "rank", "of", "pos")
    cell = (F.col("pos") / (slop + 1)).cast("long")
    heads = placed.where("rank = 0").select(
        "key", "item_id", "of", F.col("pos").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    )
    rest = placed.where("rank > 0").select("key", "item_id", "rank", "pos", cell.alias("cell"))
    met = (
        heads.join(rest, ["key", "item_id", "cell"])
        .where(F.abs(F.col("at") - F.col("pos")) <= slop)
        .groupBy("key", "item_id", "at", "of")
        .agg(F.count_distinct("rank").alias("met"))
        .where("met = of - 1")
        .select("key", "item_id", "at")
    )
    lone = placed.where("of = 1").select("key", "item_id", F.col("pos").alias("at"))
    found = met.unionAll(lone)
    return index.docs.select("doc_id", "key").join(found, "key").select("doc_id", "item_id", F.col("at").alias("pos"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` without a benchmark window, with its own columns only.

    Each row is judged by its own text: clean rows stay, whatever other rows of their id, or other rows with a null id, hold.
    """
    hits = _judged(documents.select(id_col, text_col), benchmark, id_col, text_col)
    bad = written(hits.where("contaminated").select(F.col("key").alias("_bad")).distinct(), "contaminated")
    return documents.join(_few(bad), F.xxhash64(documents[id_col], documents[text_col]) == bad["_bad"], "left_anti")
