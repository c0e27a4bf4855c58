"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation in numpy.

Tokens are words and an end.  A token's probability is that of its class after
the classes of the two tokens before it, times that of the word in its class
after the class of the token before it:

* the most frequent words and the end are classes of their own; all other words
  fall into classes by their endings;
* the class model is log-bilinear: the context vector is the sum of one vector
  for each place, a class scores by its product with it plus a bias.  It is
  trained on the class trigrams of *all* training texts, counted by the
  cluster, against noise drawn from the class unigrams;
* inside a class, each of the ``INNER`` most frequent words has a vector of its own
  and scores by its product with the context's vector plus a bias, trained on the
  (class before, word) counts of all training texts against noise from the
  class's own words;
* batched matrix products then give the normalised log-probability of
  every class after every context, and of every such word in its class, tables that
  scoring looks up;
* these words share what their counts give them of the class together; the share of a rarer
  word comes from the counts of all training words with 0.1 added, one unseen
  word to a class.

Words beyond a fixed number of frequent ones are not known to every task: their
counts are joined by a shuffle, so no table that grows with the corpus is
broadcast or brought to the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.common import HUBS, join_one, written

#: Words known to every task, and the longest of them in bytes; occurrences of any other word from which its count is broadcast to them.
HEAD, HEAD_BYTES, OFTEN = 200_000, 64, 100_000
#: Classes: the end (0), ``OWN`` frequent words, and endings.
CLASSES, OWN, DIM = 128, 87, 48
ENDINGS = CLASSES - 1 - OWN
ADDED = 0.1
NOISE, STEPS, RATE, SEED = 10, 160, 0.05, 11
#: Words with vectors of their own inside their class, their least count, the size of these, and the steps of their training.
INNER, INNER_LEAST, INNER_DIM, INNER_STEPS = 16_384, 5, 16, 80
#: Weight of the pull of vectors to 0, in tokens.
PULL = 10.0
#: Bins of a word's hash, by which words of equal count are told apart at the end of the frequent ones.
BINS = 4_096
#: Distinct words a task counts before it hands them on.
COUNTED = 200_000


def ending_class(word: bytes) -> int:
    """Class of a word that isn't one of the frequent: by its last two bytes."""
    return 1 + OWN + zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Model:
    place2: np.ndarray  # vectors of the class two tokens back
    place1: np.ndarray  # vectors of the class just before
    out: np.ndarray
    bias: np.ndarray

    def log10_table(self) -> np.ndarray:
        """``[c2, c1, c]``: log10 of the normalised probability of class c after c2, c1."""
        table = np.empty((CLASSES,) * 3, dtype=np.float32)
        for c2 in range(CLASSES):
            scores = (self.place2[c2] + self.place1) @ self.out.T + self.bias
            scores -= scores.max(axis=1, keepdims=True)
            table[c2] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)
        return table


def train_nce(cells: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> Model:
    """Fit on trigram counts; ``cells`` are codes ``(c2 * CLASSES + c1) * CLASSES + c``.

    Every observed trigram is to be told from noise classes that its context is
    shown with (``NOISE`` for each token, drawn anew every few steps, as Poisson
    counts of unigram draws); gradients run over all contexts at once.
    """
    rng = np.random.default_rng(SEED)
    total = counts.sum()
    if not total:
        zero = np.zeros((CLASSES, DIM), dtype=np.float32)
        return Model(zero, zero, zero, np.zeros(CLASSES, dtype=np.float32))
    contexts, row = np.unique(cells // CLASSES, return_inverse=True)
    seen = np.zeros((len(contexts), CLASSES), dtype=np.float32)
    np.add.at(seen, (row, cells % CLASSES), (counts / total).astype(np.float32))
    unigram = np.maximum(seen.sum(axis=0), 1e-9)
    unigram /= unigram.sum()
    weight = seen.sum(axis=1, keepdims=True)
    c2, c1 = contexts // CLASSES, contexts % CLASSES
    p = {
        "place2": rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32),
        "place1": rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32),
        "out": rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32),
        "bias": np.log(unigram).astype(np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    prior = np.log(NOISE * unigram).astype(np.float32)
    noise = None
    for step in range(1, steps + 1):
        if noise is None or step % 4 == 1:
            mean = NOISE * weight * total * unigram
            noise = (rng.poisson(mean) / total).astype(np.float32)
        h = p["place2"][c2] + p["place1"][c1]
        margin = h @ p["out"].T + p["bias"] - prior
        true = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g = (noise * true - seen * (1 - true)).astype(np.float32)
        gh = g @ p["out"]
        grad = {"out": g.T @ h, "bias": g.sum(axis=0)}
        for name, c in (("place2", c2), ("place1", c1)):
            grad[name] = np.zeros((CLASSES, DIM), dtype=np.float32)
            np.add.at(grad[name], c, gh)
        for name in ("place2", "place1", "out"):
            grad[name] = grad[name] + PULL / total * p[name]
        rate = RATE * (1 - (step - 1) / steps)
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            m, s = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            p[k] = (p[k] - rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return Model(**p)


@dataclass
class Inside:
    """Words of a class after the class before: ``before`` has a vector for each class, ``out`` and ``bias`` one for each word."""

    before: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def log10_table(self, classes: np.ndarray) -> np.ndarray:
        """``[c1, w]``: log10 of the probability of word w among the words of its class (``classes[w]``), normalised."""
        scores = self.before @ self.out.T + self.bias
        for c in np.unique(classes):
            of = np.flatnonzero(classes == c)
            part = scores[:, of] - scores[:, of].max(axis=1, keepdims=True)
            scores[:, of] = (part - np.log(np.exp(part).sum(axis=1, keepdims=True))) / np.log(10)
        return scores.astype(np.float32)


def train_inside(counts: np.ndarray, classes: np.ndarray, steps: int = INNER_STEPS) -> Inside:
    """Fit on ``counts[c1, w]`` of words w of ``classes`` by noise-contrastive estimation.

    Noise are draws from the words of the same class in proportion to their counts,
    ``NOISE`` for each token seen, in expectation.
    """
    rng = np.random.default_rng(SEED)
    words = counts.shape[1]
    total = counts.sum(axis=0) + ADDED
    of_class = np.zeros(CLASSES)
    np.add.at(of_class, classes, total)
    noise = (total / of_class[classes]).astype(np.float32)  # of the words of a class
    seen_class = np.zeros((CLASSES, CLASSES))
    np.add.at(seen_class.T, classes, counts.T)
    scale = max(1.0, float(counts.sum()))
    expected = (NOISE * seen_class[:, classes] / scale).astype(np.float32) * noise
    seen = (counts / scale).astype(np.float32)
    p = {
        "before": rng.normal(0, 0.05, (CLASSES, INNER_DIM)).astype(np.float32),
        "out": rng.normal(0, 0.05, (words, INNER_DIM)).astype(np.float32),
        "bias": np.log(noise),
    }
    prior = np.log(NOISE * noise)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    # a vector moves little where its cells are few: gradients are those of the mean log-likelihood, with a small pull to 0
    pull = PULL / scale
    for step in range(1, steps + 1):
        margin = p["before"] @ p["out"].T + p["bias"] - prior
        true = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g = expected * true - seen * (1 - true)
        grad = {"before": g @ p["out"] + pull * p["before"], "out": g.T @ p["before"] + pull * p["out"], "bias": g.sum(axis=0)}
        rate = RATE * (1 - (step - 1) / steps)
        for k, v in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            m, q = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            p[k] = (p[k] - rate * m / (np.sqrt(q) + 1e-8)).astype(np.float32)
    return Inside(**p)


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that no more than some hundred texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"]
        )

    for batch in _texts(batches):
        for text in batch.column("text").to_pylist():
            counts.update(_words(text))
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


class _Ids(dict):
    """Place of a word among the frequent ones; of any other, ``len + class``."""

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head)), strict=True))
        self.n = len(head)

    def __missing__(self, word: bytes) -> int:
        return self.n + ending_class(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def head_classes(head: list[bytes]) -> np.ndarray:
    """Class for every id: of the frequent words, then the classes themselves."""
    own = [k + 1 if k < OWN else ending_class(w) for k, w in enumerate(head)]
    return np.array([*own, *range(CLASSES)], dtype=np.int64)


def _codes(classes: np.ndarray) -> np.ndarray:
    """Trigram codes of a text's classes and its end; before a text stand two ends."""
    c = np.concatenate(([0, 0], classes, [0]))
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def _cells(shared, inner: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of class trigrams, and after them (from ``CLASSES ** 3`` on) of (class before, inner word)."""
        head = shared.value
        ids, classes = _Ids(head), head_classes(head)
        total = np.zeros(CLASSES**3, dtype=np.int64)
        pairs = np.zeros(CLASSES * inner, dtype=np.int64)
        for batch in _texts(batches):
            codes, places, held = [], [], 0

            def count(codes=codes, places=places) -> None:
                nonlocal total, pairs
                if codes:
                    total += np.bincount(np.concatenate(codes), minlength=len(total))
                    pairs += np.bincount(np.concatenate(places), minlength=len(pairs))[: len(pairs)]
                    codes.clear()
                    places.clear()

            for text in batch.column("text").to_pylist():
                at = ids.of(_words(text))
                c = classes[at]
                codes.append(_codes(c))
                own = np.flatnonzero((at < inner) & (at >= OWN))
                places.append(np.where(own > 0, c[own - 1], 0) * inner + at[own])
                held += len(codes[-1])
                if held > 2_000_000:
                    count()
                    held = 0
            count()
        for start, counts in ((0, total), (CLASSES**3, pairs)):
            at = np.flatnonzero(counts)
            for a in range(0, len(at), 65_536):
                part = at[a : a + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(part + start), pa.array(counts[part])], ["cell", "n"])

    return run


@dataclass
class Scoring:
    head: list[bytes]
    base: np.ndarray  # base log10 of each frequent word
    share: np.ndarray  # log10 of each frequent word's share of its class; of the inner words, of all inner words' share
    end_base: float
    model: Model
    inside: Inside | None

    @property
    def inner(self) -> int:
        return 0 if self.inside is None else len(self.inside.bias)

    def inner_table(self) -> np.ndarray:
        """``[c1, w]`` of the inner words; words that are classes of their own have log10(1)."""
        if self.inside is None:
            return np.zeros((CLASSES, 0), dtype=np.float32)
        return self.inside.log10_table(head_classes(self.head)[: self.inner])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scoring = shared.value
        ids, classes, table = _Ids(s.head), head_classes(s.head), s.model.log10_table().ravel()
        n, inner, words_table = len(s.head), s.inner, s.inner_table().ravel()
        row = TaskContext.get().partitionId() << 40
        for batch in _texts(batches):
            out = {k: [] for k in ("row", "n_tokens", "known", "base", "score", "rare", "times")}
            for text in batch.column("text").to_pylist():
                words = _words(text)
                at = ids.of(words)
                c = classes[at]
                score = float(table[_codes(c)].astype(np.float64).sum())
                own = np.flatnonzero(at < inner)
                score += float(words_table[np.where(own > 0, c[own - 1], 0) * inner + at[own]].astype(np.float64).sum())
                frequent = at[at < n]
                rare = Counter(words[i] for i in np.flatnonzero(at >= n))
                out["row"].append(row)
                out["n_tokens"].append(len(words) + 1)
                out["known"].append(len(frequent))
                out["base"].append(float(s.base[frequent].sum()) + s.end_base)
                out["score"].append(score + float(s.share[frequent].sum()))
                out["rare"].append(list(rare.keys()))
                out["times"].append(list(rare.values()))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["row"], pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(out["n_tokens"], pa.int64()),
                    pa.array(out["known"], pa.int64()),
                    pa.array(out["base"], pa.float64()),
                    pa.array(out["score"], pa.float64()),
                    pa.array(out["rare"], pa.list_(pa.binary())),
                    pa.array(out["times"], pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"],
            )

    return run


def frequent_words(vocabulary: DataFrame, most: int = 0) -> tuple[list[bytes], np.ndarray]:
    """At most ``most`` (``HEAD``) words of the written table (token, c) with the highest counts, highest first, and these.

    A histogram of the counts finds where to stop, so no task or driver sorts more than is
    kept: first octaves of the count, then the counts of the octave where the
    room ends, then bins of a hash among the words of the last count.
    """
    most = most or HEAD
    words = vocabulary.where(F.octet_length("token") <= HEAD_BYTES)
    octave = F.floor(F.log2("c") * 16)
    bin_ = F.pmod(F.xxhash64("token"), F.lit(BINS))
    taken, chosen = 0, F.lit(False)
    within = F.lit(True)
    for level, downward in ((octave, True), (F.col("c"), True), (bin_, False)):
        rows = words.where(within).groupBy(level.alias("k")).count().collect()
        stop = None
        for k, n in sorted(((r["k"], r["count"]) for r in rows), reverse=downward):
            if taken + n > most:
                stop = k
                break
            taken += n
        if stop is None:
            chosen = chosen | within
            break
        chosen = chosen | (within & ((level > stop) if downward else (level < stop)))
        within = within & (level == stop)
    top = words.where(chosen).select("token", "c").toArrow()
    pairs = sorted(zip(top.column("token").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in pairs], np.array([c for _, c in pairs], dtype=np.float64)


@dataclass
class Fitted:
    scoring: Scoring
    vocabulary: DataFrame  # (token, c), written
    train_tokens: int
    whole: float  # N + ADDED * (V + 1)
    room: np.ndarray  # of each class, what its words' counts and the added come to
    ends: int


def fit(training: DataFrame) -> Fitted:
    """Learn from all rows of ``training`` (text binary)."""
    spark = training.sparkSession
    vocabulary = written(
        training.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "vocabulary"
    )
    ends = training.count()
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = words + ends, distinct + (ends > 0)
    whole = n + ADDED * (v + 1)
    head, counts = frequent_words(vocabulary)

    # sums of the classes by ending, over all words but those that are classes of their own
    sums = {r["class"]: (r["n"], r["v"]) for r in vocabulary.groupBy(_ending()).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    inside = np.zeros((CLASSES, 2))
    for k, pair in sums.items():
        inside[k] = pair
    for w, c in zip(head[:OWN], counts[:OWN], strict=True):
        inside[ending_class(w)] -= (c, 1)
    room = inside[:, 0] + ADDED * (inside[:, 1] + 1)
    classes = head_classes(head)[: len(head)]
    share = np.log10((counts + ADDED) / room[classes]) if len(head) else counts
    share[:OWN] = 0.0
    inner = min(INNER, max(OWN, int((counts >= INNER_LEAST).sum())), len(head))
    together = np.zeros(CLASSES)
    np.add.at(together, classes[OWN:inner], counts[OWN:inner] + ADDED)
    share[OWN:inner] = np.log10(together[classes[OWN:inner]] / room[classes[OWN:inner]])

    known = spark.sparkContext.broadcast(head)
    cells = training.mapInArrow(_cells(known, inner), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, times = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    trigram = cell < CLASSES**3
    model = train_nce(cell[trigram], times[trigram])
    pairs = np.zeros(CLASSES * inner)
    pairs[cell[~trigram] - CLASSES**3] = times[~trigram]
    words_inside = train_inside(pairs.reshape(CLASSES, inner), classes[:inner]) if inner > OWN else None
    end_base = float(np.log10((ends + ADDED) / whole))
    scoring = Scoring(head, np.log10((counts + ADDED) / whole), share, end_base, model, words_inside)
    return Fitted(scoring, vocabulary, n, whole, room, ends)


def _ending():
    """The class of a word that isn't one of the frequent, as a column."""
    return (F.crc32(F.substring("token", -2, 2)) % ENDINGS + 1 + OWN).cast("int").alias("class")


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``documents``.

    Learns from the rows whose crc32 of the id as text isn't 0 modulo ``folds``.
    Null texts count as empty (their end is a token all the same), a null id as
    the id ''.  Rows that repeat an id are scored, and learnt from, each on its own.
    With nothing to learn from, every token's base is log10(1) = 0.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("binary").alias("text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out"),
    )
    fitted = fit(docs.where(~F.col("held_out")).select("text"))
    vocabulary, n, whole, room, ends, ending = fitted.vocabulary, fitted.train_tokens, fitted.whole, fitted.room, fitted.ends, _ending()
    scoring = spark.sparkContext.broadcast(fitted.scoring)
    texts = written(
        docs.mapInArrow(
            _score(scoring),
            "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
            "rare array<binary>, times array<long>",
        ),
        "texts",
    )
    rooms = F.array(*[F.lit(float(x)) for x in room])
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    # long words aren't in the head, however frequent; the rows of such a word are dealt by text
    often = max(OFTEN, n // HUBS)
    rare = (
        join_one(rare, vocabulary.withColumn("_n", F.col("c")), ["token"], "_n", often, "row")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .select(
            "row",
            F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).alias("known"),
            (F.col("times") * F.log10((F.col("c") + ADDED) / whole)).alias("base"),
            (F.col("times") * F.log10((F.col("c") + ADDED) / F.get(rooms, ending))).alias("score"),
        )
        .groupBy("row")
        .agg(*[F.sum(x).alias(f"rare_{x}") for x in ("known", "base", "score")])
    )
    end_known = F.lit(1 if ends else 0)
    return texts.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + end_known + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
