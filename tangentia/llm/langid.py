"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of its words' vectors, and a word's vector the sum of the
embeddings of its hashed character n-grams (with word boundaries) and
of the word itself.  Embeddings and the linear layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows.

As the model is linear after averaging, a word's share of the class scores is a
fixed vector: scoring keeps those vectors for the words it has met (a bounded
number), so a whole text of any length costs one look-up for each word.

A temperature fitted on rows left out of training calibrates the probabilities;
the rejection threshold is a low quantile of the calibrated probability
of the right class there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows the model is fitted on, and their most characters together.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 16_000_000
BUCKETS, DIM, EPOCHS, STEPS, RATE, SEED = 1 << 15, 16, 6, 12_000, 0.5, 7
#: Lengths of the n-grams, in bytes.
GRAMS = (1, 2, 3, 4)
#: Share of a sample's rows that calibrates, and the quantile there that rejection allows to lose.
CALIBRATION, REJECT_QUANTILE = 0.2, 0.002
WORDS_KEPT = 100_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters_of(text: str) -> list[str]:
    """The words of a text: runs of letters and marks, lower-cased."""
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, and the word each belongs to.

    All words are hashed together: a polynomial over the bytes of every n-gram
    that doesn't cross a boundary.
    """
    marked = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(marked)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    ids = [np.fromiter((zlib.crc32(w) for w in marked), dtype=np.int64, count=len(marked)) % BUCKETS]
    owners = [np.arange(len(marked))]
    h = np.full(len(data), 2_166_136_261, dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(data) - n + 1] * np.uint32(16_777_619) ^ data[n - 1 :]
        if n in GRAMS:
            inside = at[: len(h)] + n <= end[: len(h)]
            x = h[inside]
            ids.append(((x ^ (x >> np.uint32(15))) % BUCKETS).astype(np.int64))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # a score for each bucket and label: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class _Rows(dict):
    """Numbers words as they come; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class Scorer:
    """Scores texts with a model, remembering a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = _Rows()
        self.scores = np.zeros((2 * WORDS_KEPT, len(model.labels)))

    def _learn(self) -> None:
        """Class scores of the words met since the last time."""
        new, self.rows.new = self.rows.new, []
        if new:
            ids, owner = subwords(new)
            sums = [np.bincount(owner, self.model.table[ids, k], len(new)) for k in range(self.scores.shape[1])]
            grams = np.bincount(owner, minlength=len(new))
            end = len(self.rows)
            if end > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((end, self.scores.shape[1]))])
            self.scores[end - len(new) : end] = np.stack(sums, axis=1) / grams[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """A label and its calibrated probability for each text; ``und`` and 0 for one without letters."""
        if not self.model.labels:
            return [("und", 0.0)] * len(texts)
        out = []
        for a in range(0, len(texts), 64):
            if len(self.rows) > WORDS_KEPT:
                self.rows = _Rows()
            found = [
                np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
                for words in (letters_of(t) if t else [] for t in texts[a : a + 64])
            ]
            self._learn()
            for at in found:
                if not len(at):
                    out.append(("und", 0.0))
                    continue
                p = _softmax((self.scores[at].mean(axis=0) + self.model.bias) / self.model.temperature)
                best = int(p.argmax())
                out.append((self.model.labels[best], float(p[best])))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str]) -> Model:
    """Fit on labelled texts; rows without letters are passed over."""
    labels = sorted(set(langs))
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for text, lang in zip(texts, langs, strict=True):
        words = Counter(letters_of(text))
        if not words:
            continue
        ids, owner = subwords(list(words))
        counts = np.array(list(words.values()), dtype=np.float64)
        share = counts[owner] / np.bincount(owner)[owner] / counts.sum()
        bucket, inverse = np.unique(ids, return_inverse=True)
        rows.append((bucket, np.bincount(inverse, share).astype(np.float32), labels.index(lang)))
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(labels)), dtype=np.float32)
    bias = np.zeros(len(labels), dtype=np.float32)
    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * CALIBRATION)] if len(rows) >= 20 else order[:0]
    fit = order[len(held) :]
    epochs = max(EPOCHS, -(-STEPS // max(1, len(fit))))  # a small sample is gone through more often
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for k in rng.permutation(fit):
            bucket, share, y = rows[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ emb[bucket]
            err = _softmax(hidden @ out + bias)
            err[y] -= 1
            back = out @ err
            out -= rate * np.outer(hidden, err)
            bias -= rate * 0.1 * err
            emb[bucket] -= rate * 8 * share[:, None] * back[None, :]
    table = emb @ out
    temperature, threshold = 1.0, 0.0
    if len(held):
        logits = np.stack([rows[k][1] @ table[rows[k][0]] + bias for k in held]).astype(np.float64)
        y = np.array([rows[k][2] for k in held])
        losses = [
            (-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean(), t)
            for t in np.geomspace(1, 20, 41)
        ]
        temperature = float(min(losses)[1])
        right = _softmax(logits / temperature)[np.arange(len(y)), y]
        threshold = float(min(0.5, np.quantile(right, REJECT_QUANTILE)))
    return Model(labels, table, bias, temperature, threshold)


def sample_of(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """At most ``rows`` labelled rows (text, lang) of at most ``chars`` characters, about as many for each language as far as there are.

    ``documents`` (id, text, lang).  A hash of id and text gives every row its place, so the choice
    doesn't depend on partitions; the first places of each language are taken.  Both limits hold
    before any text is brought to the driver: first only places and lengths are, of
    about as many rows as are wanted.  Of rows that repeat id and text one is taken.  Texts longer than a
    language's share of the characters are passed over.  Languages beyond the ``rows``
    with the most rows have no place.
    """
    place = F.xxhash64("id", "text")
    labelled = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "text", "lang", F.length("text").alias("size"), place.alias("place")
    )
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    sizes = sorted(sizes.orderBy(F.col("n").desc(), "lang").limit(rows).collect(), key=lambda r: r["lang"])
    if not sizes:
        return pd.DataFrame({"text": [], "lang": []})
    each, most = max(1, rows // len(sizes)), chars // len(sizes)
    spread = F.pmod("place", F.lit(1 << 30)) / float(1 << 30)
    share = {r["lang"]: min(1.0, 1.2 * each / r["n"] + 20 / r["n"], 1.2 * most / max(1.0, r["mean"] * r["n"]) + 20 / r["n"]) for r in sizes}
    shares = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    near = labelled.where((spread < F.element_at(shares, F.col("lang"))) & (F.col("size") <= most))
    places = near.select("lang", "place", "size", spread.alias("s")).distinct().orderBy("s", "place").limit(2 * rows + 40 * len(sizes)).toPandas()
    last: dict = {}
    for lang, part in places.groupby("lang"):
        part = part.sort_values(["s", "place"])
        fits = part[(np.arange(len(part)) < each) & (part["size"].cumsum() <= most)]
        last |= {int(x): lang for x in fits["place"]}
    if not last:
        return pd.DataFrame({"text": [], "lang": []})
    wanted = documents.sparkSession.createDataFrame([(x, lang) for x, lang in last.items()], "place long, lang string")
    picked = near.join(F.broadcast(wanted), ["place", "lang"], "left_semi").groupBy("place", "lang").agg(F.first("text").alias("text"))
    return picked.select("text", "lang").toPandas().sort_values(["lang", "text"], ignore_index=True)


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Train on a bounded sample of the rows with a text and a label."""
    sample = sample_of(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    return train(sample["text"].tolist(), sample["lang"].tolist())


def _scored(batches: Iterator[pa.Array], shared) -> Iterator[tuple[list[tuple[str, float]], Scorer]]:
    """Predictions for each batch; no more than a slice of its texts is unpacked at a time."""
    scorer = shared.value.scorer()
    for batch in batches:
        found: list[tuple[str, float]] = []
        for a in range(0, len(batch), 256):
            found += scorer.predict(batch.slice(a, 256).to_pylist())
        yield found, scorer


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``rejected``, which replace columns so named.

    ``lang_pred`` is ``und`` (score 0, rejected) for a null text and for one
    without a letter; otherwise the likeliest label, rejected if its calibrated
    probability is below the model's threshold.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    df = documents.select(*[F.col(f"`{c}`") for c in own])

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found, scorer in _scored(batches, shared):
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] == "und" or f[1] < scorer.model.threshold for f in found], pa.bool_()),
                ],
                ["lang_pred", "score", "rejected"],
            )

    name = "_langid"
    while name in own:
        name += "_"
    df = df.withColumn(name, score(F.col(text_col)))
    return df.select(
        *[F.col(f"`{c}`") for c in own], F.col(f"{name}.lang_pred"), F.col(f"{name}.score"), F.col(f"{name}.rejected")
    )


def held_out(id_col: str = "doc_id"):
    """True for the rows the evaluation keeps out of training; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row, learning from those not held out."""
    docs = documents.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the model accepts, with its own columns only."""
    docs = documents.withColumn("_held_out", held_out())
    model = fit(docs.where(~F.col("_held_out")).select("doc_id", "text", "lang"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found, scorer in _scored(batches, shared):
            yield pa.array([f[0] != "und" and f[1] >= scorer.model.threshold for f in found], pa.bool_())

    return documents.where(accepted(F.col("text")))


