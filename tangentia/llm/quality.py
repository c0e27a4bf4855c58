"""Quality rules by distribution divergence, in built-in expressions only.

Each text is reduced to two histograms: the classes of its characters
and the most common words.  Both are compared with references for
each language by the Jensen-Shannon distance (base 2, so 0 to 1), and the
nearest language counts.  A text far from every language is rejected, but only
if it is long enough for its histogram to be steady, only if some reference
is of its script, and only if the language it is labelled with, if any, has a reference: what is
measured against other languages alone has no verdict.

The references are learnt from the labelled rows of the corpus itself, all of
them: the documents' median shares of the character classes, which junk in less than
half of a language's rows doesn't move far, and counts of short words.  So what is prose is what the corpus calls a language, in any script;
source code is rejected where no rows are labelled as such.

All measures are computed inside the row: no join, no Python.  Learning the
references is one pass of histograms and one of word counts, of which a row for each language
comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tangentia.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"

#: Classes of the characters of words.
CHAR_CLASSES = ("lower", "upper", "digit", "wide", "punct", "symbol", "other")
WIDE = CHAR_CLASSES.index("wide")
#: Words of a language's reference, and the most characters of such a word (it has no A-Z, digit or mark).
COMMON_WORDS, COMMON_LENGTH, COMMON_WORD = 8, 5, r"^[^\x00-\x60\x7B-\x7F]+$"
#: Labelled rows that a language needs for a reference, whatever their share; and the most references, those of most rows.
#: Texts of languages without one have no verdict.
LEAST_ROWS, MOST_REFERENCES = 10, 256
#: Steps in which documents' shares are read for their median.
SHARE_STEPS = 1_000
#: A reference is of a text's script if their shares of non-ASCII characters differ by no more.
SCRIPT_GAP = 0.5
#: Least characters in words, and words, from which the two rules apply.
LEAST_CHARS, LEAST_WORDS = 400, 100
#: A text is rejected if its character distance is above the first, or its character and word distances both above the others.
MOST_CHARS_JS, BOTH_CHARS_JS, BOTH_WORDS_JS = 0.24, 0.20, 0.20
LEAST_BASE_WORDS, MOST_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Reference:
    """A language's shares of the character classes, and of its common words, most common first; the label of its rows, if it has one."""

    chars: tuple[float, ...]
    words: tuple[tuple[str, float], ...]
    lang: str | None = None


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance between an array column of shares and a fixed distribution."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(x: Column, y: Column) -> Column:
        return (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2

    terms = F.zip_with(p, F.array(*[F.lit(float(v)) for v in q]), both)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _removed(text: str, kind: str) -> Column:
    return F.regexp_replace(text, kind, "")


def _left_over(words: str, common: list[str]) -> Column:
    """Sizes of an array of common words as each of them is taken away in turn."""
    steps = F.aggregate(
        F.array(*[F.lit(w) for w in common]).cast("array<string>"),
        F.struct(F.col(words).alias("rest"), F.array().cast("array<int>").alias("sizes")),
        lambda acc, w: F.struct(
            F.array_remove(acc["rest"], w).alias("rest"), F.array_append(acc["sizes"], F.size(acc["rest"])).alias("sizes")
        ),
        lambda acc: F.array_append(acc["sizes"], F.size(acc["rest"])),
    )
    return steps


def capital(word: str) -> str:
    """The word at the beginning of a sentence; words beginning with a letter outside ASCII stay."""
    return word[0].upper() + word[1:] if "a" <= word[0] <= "z" else word


def _classed(df: DataFrame, chars: str, steps: list[str], out: str) -> DataFrame:
    """``df`` with an array ``out`` of the counts of the character classes of column ``chars``, class after class taken away."""
    kinds = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", r"[.,;:!?'\"()\-]+", "[#*$%&|<>]+")
    every = [chars, *steps]
    for before, after, kind in zip(every, steps, kinds, strict=False):
        df = df.select("*", _removed(before, kind).alias(after))
    sizes = [F.length(a) - F.length(b) for a, b in zip(every, steps, strict=False)]
    return df.withColumn(out, F.array(*sizes, F.length(steps[-1]))).drop(*steps)


def learn(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """References of the languages that ``documents`` has ``LEAST_ROWS`` labelled rows of, by name of the language.

    Of more than ``MOST_REFERENCES`` languages, those of most rows (of equals the first by name) have one.

    Rows with a null text or language, and texts without words, tell nothing.
    """
    rows = documents.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    steps = [f"c{k}" for k in range(1, 7)]
    chars = _classed(rows.select("lang", _removed("text", SPACE).alias("c")), "c", steps, "classes")
    chars = chars.where(F.length("c") > 0).groupBy("lang").agg(
        F.count("*").alias("rows"), *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY floor({SHARE_STEPS} * (classes[{k}] / length(c))))").alias(f"n{k}") for k in range(len(CHAR_CLASSES))]
    )
    words = rows.select("lang", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    short = F.length("word") <= COMMON_LENGTH
    counts = written(words.groupBy("lang", F.when(short, F.col("word")).alias("word")).agg(F.count("*").alias("n")), "words")
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = counts.where(F.col("word").rlike(COMMON_WORD)).withColumn("k", F.row_number().over(best)).where(F.col("k") <= COMMON_WORDS)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("n_words"))
    every = chars.where(F.col("rows") >= LEAST_ROWS).orderBy(F.col("rows").desc(), "lang").limit(MOST_REFERENCES).collect()
    mine = F.col("lang").isin([r["lang"] for r in every])
    texts = {r["lang"]: r for r in sums.where(mine).join(listed.where(mine), "lang", "left").collect()} if every else {}
    out = []
    for r in sorted(every, key=lambda r: r["lang"].encode()):
        n = [r[f"n{k}"] + 0.5 for k in range(len(CHAR_CLASSES))]
        t = texts[r["lang"]]
        common = tuple((x["word"], x["n"] / t["n_words"]) for x in t["top"] or ())
        out.append(Reference(tuple(x / sum(n) for x in n), common, r["lang"]))
    return out


def _rest(reference: Reference) -> float:
    """Share of all other words."""
    return max(1.0 - sum(p for _, p in reference.words), 0.0)


def measure(
    documents: DataFrame,
    references: list[Reference],
    text_col: str = "text",
    out: str = "quality",
    carry: list[str] | None = None,
    lang_col: str | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``documents`` (all by default) with a struct ``out`` of measures and verdicts.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    chars_js, words_js (double, null for a text without words, where no
    reference is of its script, and where ``lang_col`` names a language without a reference: such a text isn't judged by
    other languages), base_failed,
    kept (boolean).  A null text counts as an empty one: no words, all counts
    0, base_failed.
    """
    named = [r.lang for r in references if r.lang is not None]
    judged = F.lit(True) if lang_col is None else F.col(lang_col).isNull() | F.col(lang_col).cast("string").isin(named)
    names = ("_c", "_w", "_ln", "_c1", "_c2", "_c3", "_c4", "_c5", "_c6", "_h", "_s", "_p", "_common", "_classes", "_length")
    c, w, ln, c1, c2, c3, c4, c5, c6, h, s, p, common, classes, length = _fresh(documents, *names)
    repeated, chars_js, words_js, failed, count, lines, distinct_lines, counts, known_lang = _fresh(
        documents, "_repeated", "_chars_js", "_words_js", "_failed", "_n", "_lines", "_distinct_lines", "_counts", "_judged"
    )
    keep = [F.col(f"`{x}`") for x in (documents.columns if carry is None else carry)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    vocabulary = sorted({v for r in references for v, _ in r.words}, key=lambda v: (-max(dict(r.words).get(v, 0) for r in references), v))
    known = [v for x in vocabulary for v in (x, capital(x))]
    n = F.size(w)

    # every step uses columns of the one before more than once, so none is computed twice
    df = documents.select(
        *keep,
        judged.alias(known_lang),
        F.array_remove(F.split(text, SPACE), "").alias(w),
        _removed(text, SPACE).alias(c),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(ln),
    )
    df = _classed(df, c, [c1, c2, c3, c4, c5, c6], classes)
    nothing = F.array().cast("array<bigint>")
    df = df.select(
        *keep,
        known_lang,
        F.length(c).alias(length),
        n.alias(count),
        F.size(ln).alias(lines),
        F.size(F.array_distinct(ln)).alias(distinct_lines),
        classes,
        # fingerprints of the 3-word windows, by position
        F.when(
            n >= 3,
            F.transform(
                F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
            ),
        )
        .otherwise(nothing)
        .alias(h),
        F.transform(F.filter(w, lambda x: x.isin(known)) if known else F.array().cast("array<string>"), F.lower).alias(common),
    )
    df = df.withColumn(counts, _left_over(common, vocabulary)).drop(common)
    n = F.col(count)
    # windows in order of fingerprint, for the texts that repeat one; equal neighbours are repeats
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn(
        s,
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    ).drop(h)
    again = F.filter(
        s,
        lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn(p, F.sort_array(F.transform(again, lambda x: x["i"]))).drop(s)
    gaps = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(x - F.get(p, k - 1), F.lit(3))))

    def word_shares(reference: Reference) -> Column:
        at = [vocabulary.index(v) for v, _ in reference.words]
        own = [F.get(counts, F.lit(k)) - F.get(counts, F.lit(k + 1)) for k in at]
        return F.transform(F.array(*own, sum((-x for x in own), n)), lambda x: x / n)

    wide = F.get(classes, F.lit(WIDE)) / F.col(length)

    def nearest(distances: list[Column]) -> Column:
        """Of the references of the text's script."""
        fit = [F.when(F.abs(wide - r.chars[WIDE]) <= SCRIPT_GAP, d) for r, d in zip(references, distances, strict=True)]
        return F.when((n > 0) & F.col(known_lang), F.round(F.least(*fit) if len(fit) > 1 else fit[0], 6)) if fit else F.lit(None).cast("double")

    df = df.select(
        *keep,
        count,
        length,
        lines,
        distinct_lines,
        classes,
        F.aggregate(gaps, F.lit(0), lambda a, x: a + x).alias(repeated),
        nearest([js_distance(F.transform(classes, lambda x: x / F.col(length)), list(r.chars)) for r in references]).alias(chars_js),
        nearest([js_distance(word_shares(r), [*(p for _, p in r.words), _rest(r)]) for r in references]).alias(words_js),
    )
    df = df.withColumn(failed, (n < LEAST_BASE_WORDS) | (100 * F.col(repeated) > MOST_REPEAT_PERCENT * n))
    chars, words = F.coalesce(chars_js, F.lit(0.0)), F.coalesce(words_js, F.lit(0.0))
    far = (F.col(length) >= LEAST_CHARS) & (
        (chars > MOST_CHARS_JS) | ((n >= LEAST_WORDS) & (chars > BOTH_CHARS_JS) & (words > BOTH_WORDS_JS))
    )
    # the verdict comes out of a generator, below which no filter on it can be pushed: that would compute all above anew for each use
    return df.select(
        *keep,
        F.explode(F.array(F.struct(
            n.cast("long").alias("n_words"),
            F.col(length).cast("long").alias("word_chars"),
            F.get(classes, F.lit(5)).cast("long").alias("n_symbols"),
            (F.col(lines) - F.col(distinct_lines)).cast("long").alias("n_dup_lines"),
            F.col(repeated).cast("long").alias("n_repeat_words"),
            F.col(chars_js).alias("chars_js"),
            F.col(words_js).alias("words_js"),
            F.col(failed).alias("base_failed"),
            (~F.col(failed) & ~far).alias("kept"),
        ))).alias(out),
    )


def quality_rules(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    references: list[Reference] | None = None,
) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id`` and the fields of :func:`measure`.

    References are learnt from ``documents`` unless given.  Rows that repeat an
    id, and rows with a null id, are each judged on their own.  Given references judge
    by the labels too where they are named; of unnamed ones, all do.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_label(documents, references, lang_col))
    references = learn(documents, text_col, lang_col) if references is None else references
    return measure(docs, references, carry=["doc_id"], lang_col="lang" if "lang" in docs.columns else None).select("doc_id", "quality.*")


def _label(documents: DataFrame, references: list[Reference] | None, lang_col: str) -> list[Column]:
    """The label by which texts are judged: none where the references have no names, or the documents no labels."""
    unnamed = references is not None and all(r.lang is None for r in references)
    return [] if unnamed or lang_col not in documents.columns else [F.col(lang_col).alias("lang")]


def keep_good(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", references: list[Reference] | None = None
) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with its own columns only."""
    by = lang_col if _label(documents, references, lang_col) else None
    references = learn(documents, text_col, lang_col) if references is None else references
    (q,) = _fresh(documents, "quality")
    return measure(documents, references, text_col, q, lang_col=by).where(F.col(f"{q}.kept")).drop(q)
