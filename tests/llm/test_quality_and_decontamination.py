import hashlib
import math
import random
import re
from collections import Counter

import pytest
from helpers import documents, lower_az, prose, space_words
from pyspark.sql import functions as F

from tangentia.llm import decontaminate as dec
from tangentia.llm import quality


def _base(text):
    w = space_words(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
        len(w) < 50 or 100 * len(hit) > 50 * len(w),
    )


TEXTS = [
    "", None, "   \n\t", "one", "a b c a b c", "x\ny\nx\n\n \nx", prose(300, 1), prose(300, 2).upper(), ("spam eggs ham " * 60).strip(),
    " | ".join(prose(200, 3, 4000).split()), "### " * 80, prose(20_000, 4), "É ñ " * 60, "a\x1cb c\x0bd", prose(60, 5) + " " + prose(60, 5),
]


def test_base_measures_by_brute_force(spark):
    docs = documents(spark, list(enumerate(TEXTS))).withColumn("quality", F.lit(1)).withColumn("_w", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(text), i
        assert not (r["base_failed"] and r["kept"])


ENGLISH = "The cat sat on the mat and the dog was in the house of a friend, which is to say that it was there."
RUSSIAN = "Кошка сидела на окне и смотрела как во дворе играют дети, а собака спала под столом и не хотела никуда идти. Что же делать?"
PYTHON = "def add(self, x, y):\n    if x is None or y[0] != 3:\n        return {'a': x[1:], 'b': (y ** 2) % 7}\n    for i in range(len(self._rows)):\n        self.total += self._rows[i] * (x - y) / 2.0\n"


def _written(base, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(base.split()) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def _corpus(spark, rows):
    """Rows (doc_id, text, lang) among fifteen each of labelled English and Russian prose."""
    full = [(i, t, lang, "s", 0) for i, t, lang in rows]
    full += [(1000 + k, _written(ENGLISH, 300, k), "en", "s", 0) for k in range(15)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def test_verdicts_and_filter(spark):
    good = _written(ENGLISH, 400, 0)
    marked = " ".join(w + "###" for w in good.split())
    rows = [(1, good, "en"), (2, marked, "en"), (3, good.upper().replace(" ", "!! "), None), (None, good, None), (1, good, "en"), (4, None, "en")]
    docs = _corpus(spark, rows).withColumn("_stop", F.lit(0)).withColumn("quality", F.lit("x"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect() if (r["doc_id"] or 0) < 1000)
    assert ids == [(False, 1), (False, 1), (True, 0)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate explode")
    assert quality.quality_rules(docs.where("doc_id < 0")).count() == 0


def test_other_scripts(spark):
    """A script without a reference has no verdict; with labelled rows of it, its junk is told from its prose."""
    junk = " ".join(w + "$$#" for w in _written(RUSSIAN, 200, 3).split())
    rows = [(1, _written(RUSSIAN, 200, 1), None), (2, junk, None), (3, PYTHON * 8, None)]
    got = {r["doc_id"]: r for r in quality.quality_rules(_corpus(spark, rows)).collect()}
    assert got[1]["kept"] and got[1]["chars_js"] is None and got[1]["words_js"] is None
    assert not got[3]["kept"]
    more = [(2000 + k, _written(RUSSIAN, 200, 50 + k), "ru") for k in range(15)] + [(3000 + k, _written(PYTHON, 300, k), "py") for k in range(15)]
    got = {r["doc_id"]: r for r in quality.quality_rules(_corpus(spark, rows + more)).collect()}
    assert got[1]["kept"] and got[1]["chars_js"] < 0.1 and not got[2]["kept"]
    assert all(got[i]["kept"] for i, _, _ in more) and got[3]["chars_js"] < 0.2


VIETNAMESE = "Tôi đang ngồi ở nhà và đọc một cuốn sách rất hay về những người đã đi qua nhiều nước trên thế giới để tìm việc làm."


@pytest.mark.parametrize("n, others", [(3, 10_000), (9, 200), (12, 13_000)])
def test_a_rare_language_is_never_judged_by_others(spark, n, others):
    rows = [(k, _written(VIETNAMESE, 300, k), "vi") for k in range(n)]
    english = spark.range(others).select(
        (F.col("id") + 1000).alias("doc_id"), F.concat_ws(" ", F.lit(ENGLISH), F.lit(_written(ENGLISH, 150, 7)), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang")
    )
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(english))
    mine = got.where("doc_id < 1000").collect()
    assert len(mine) == n and all(r["kept"] for r in mine)
    assert all((r["chars_js"] is None) == (n < 10) and (r["chars_js"] or 0) < 0.1 for r in mine)
    assert got.where("kept").count() == n + others


def test_given_references_and_tables_without_labels(spark):
    docs = _corpus(spark, [(1, _written(ENGLISH, 300, 0), "xx"), (2, " ".join(w + "$#" for w in _written(ENGLISH, 300, 1).split()), "xx")])
    unnamed = [quality.Reference(r.chars, r.words) for r in quality.learn(docs)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, references=unnamed).collect()}
    assert got[1] and not got[2]
    assert {r["doc_id"] for r in quality.keep_good(docs.drop("lang"), references=quality.learn(docs)).collect()} >= {1, 1000}
    assert 2 in {r["doc_id"] for r in quality.keep_good(docs).collect()}


def test_references_by_brute_force(spark):
    rows = [(k, _written(ENGLISH if k % 2 else RUSSIAN, 30 + k, k), ("en", "ru")[k % 2 == 0]) for k in range(30)] + [(99, None, "en"), (98, "", "en"), (97, "zz", "rare"), (96, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.learn(docs)
    assert len(got) == 2
    for ref, lang in zip(got, ("en", "ru"), strict=True):
        words = [w for _, t, x in rows if x == lang for w in space_words(t)]
        n = Counter(w for w in words if len(w) <= 5 and re.fullmatch(r"[^\x00-\x60\x7B-\x7F]+", w))
        assert [w for w, _ in ref.words] == sorted(n, key=lambda w: (-n[w], w))[:8]
        assert all(abs(p - n[w] / len(words)) < 1e-12 for w, p in ref.words)
        shares = []
        for c in ["".join(space_words(t)) for _, t, x in rows if x == lang]:
            if c:
                kinds = [sum("a" <= x <= "z" for x in c), sum("A" <= x <= "Z" for x in c), sum(x.isdigit() for x in c), sum(x > "\x7f" for x in c), sum(x in ".,;:!?'\"()-" for x in c), sum(x in "#*$%&|<>" for x in c)]
                shares.append([math.floor(1000 * (k / len(c))) for k in (*kinds, len(c) - sum(kinds))])
        medians = [sorted(x)[math.ceil(len(x) / 2) - 1] + 0.5 for x in zip(*shares, strict=True)]
        assert ref.chars == pytest.approx([m / sum(medians) for m in medians])


def test_js_distance_is_a_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.0, 0.0, 1.0],)], "p array<double>")
    d = [r[0] for r in df.select(quality.js_distance(F.col("p"), [0.5, 0.5, 0.0])).collect()]
    assert d == [0.0, 1.0]


def _tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


def _hits(text, items):
    w = _tokens(text)
    hit, found = set(), set()
    for item, t in items:
        v = _tokens(t)
        windows = [v[i : i + 10] for i in range(max(1, len(v) - 9))] if v else []
        for x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    if item is not None:
                        found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_by_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(dec, "BROADCAST_CHARS", -1)
        monkeypatch.setattr(dec, "FEW", -1)
        monkeypatch.setattr(dec, "OFTEN", 3)  # so that frequent terms go their own way
    items = [(1, prose(40, 50)), (2, "Alpha beta"), (10, prose(12, 51)), (11, prose(12, 51)), (3, ""), (4, None), (5, "the the the"), (None, prose(15, 52)), (6, "Ünï code")]
    long = prose(3000, 60)
    rows = [
        (1, long + " " + prose(40, 50)[30:180] + " " + prose(50, 61)), (2, "x alpha, BETA. y alpha beta beta"), (3, prose(12, 51).upper()),
        (4, "the the the the the"), (5, None), (6, ""), (7, prose(400, 62)), (8, prose(15, 52)), (9, "x ünï code y Ünï code"), (1, "alpha beta"),
        (7, prose(400, 62)), (None, "alpha beta"),
    ]
    docs = documents(spark, rows).withColumn("key", F.lit(0)).withColumn("item_id", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dec.decontaminate(docs, bench).collect()), key=repr)
    want = sorted(((i, *_hits(t, items)) for i, t in rows), key=repr)
    assert got == want


def test_decontamination_of_nothing(spark):
    docs = documents(spark, [(1, "a b c")])
    none = spark.createDataFrame([], "item_id long, text string")
    r = dec.decontaminate(docs, none).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (3, 0, False)
    assert dec.decontaminate(docs.where("doc_id < 0"), none).count() == 0
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    kept = dec.keep_clean(documents(spark, [(1, "a b c"), (2, "a c"), (None, "a")]), bench)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("few", [1000, -1])
def test_clean_rows_of_shared_and_null_ids_stay(spark, monkeypatch, few):
    monkeypatch.setattr(dec, "FEW", few)
    rows = [(None, "a c"), (None, "a b"), (None, "d"), (5, "x b y"), (5, "clean"), (6, None), (None, None), (5, "clean")]
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    docs = documents(spark, rows).withColumn("key", F.lit(0)).withColumn("_bad", F.lit(0))
    kept = dec.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((r for r in rows if "b" not in (r[1] or "")), key=repr)


def test_proximity(spark, monkeypatch):
    docs = documents(spark, [(1, "red w w w green w blue"), (2, "red " + "w " * 50 + "green blue"), (3, "blue green red red")])
    items = spark.createDataFrame([(7, "green blue red"), (8, "purple red"), (9, "green")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["pos"]) for r in dec.proximity_matches(docs, items, slop=6).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 7), (3, 7), (1, 9), (2, 9), (3, 9), (1, 8), (2, 8), (3, 8)}
    monkeypatch.setattr(dec, "BROADCAST_CHARS", -1)
    assert {tuple(r) for r in dec.proximity_matches(docs, items, slop=6).collect()} == got
