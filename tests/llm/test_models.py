"""Language model, language identification, licences, pages."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from tangentia.llm import html, html_pages, langid, licences, lm


def _tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("head", [200_000, 50])
def test_language_model_base_by_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, prose(80 + i % 40, i)) for i in range(120)] + [(500, None), (501, ""), (502, "A a É é b\x1cc"), (None, "null id"), (503, prose(8000, 9, 3000)), (7, prose(87, 7))]
    docs = documents(spark, rows).withColumn("token", F.lit(1)).withColumn("row", F.lit("x"))
    got = lm.score_texts(docs).collect()
    assert len(got) == len(rows)
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            train.update(_tokens(t))
    n, v = sum(train.values()), len(train)
    by_id: dict = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    for r in got:
        words = _tokens(by_id[r["doc_id"]][0])
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n
        assert r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(base)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0)
        assert r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 1.02
    assert lm.score_texts(docs.where("doc_id < 0")).count() == 0


def _log10_token(f: lm.Fitted, counts: dict, class_of, c2: int, c1: int, word) -> float:
    """Probability of one token, from the model's parameters alone."""
    s, m = f.scoring, f.scoring.model
    c = 0 if word is None else class_of(word)
    z = [float((m.place2[c2] + m.place1[c1]) @ m.out[k] + m.bias[k]) for k in range(lm.CLASSES)]
    p = math.exp(z[c] - max(z)) / sum(math.exp(x - max(z)) for x in z)
    if word is None or (word in s.head and s.head.index(word) < lm.OWN):
        return math.log10(p)
    inner = s.head[: s.inner]
    room = sum(n for w, n in counts.items() if class_of(w) == c) + 0.1 * (sum(class_of(w) == c for w in counts) + 1)
    if word in inner:
        mates = [k for k, w in enumerate(inner) if k >= lm.OWN and class_of(w) == c]
        e = {k: math.exp(float(s.inside.before[c1] @ s.inside.out[k] + s.inside.bias[k])) for k in mates}
        together = sum(counts[inner[k]] + 0.1 for k in mates)
        return math.log10(p * together / room * e[inner.index(word)] / sum(e.values()))
    return math.log10(p * (counts.get(word, 0) + 0.1) / room)


@pytest.mark.parametrize(("head", "inner"), [(200_000, 16_384), (250, 150), (40, 20)])
def test_language_model_score_by_brute_force(spark, monkeypatch, head, inner):
    """Every score equals the sum over tokens of the saved model, and the probabilities of all words add to 1."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "INNER", inner)
    rows = [(i, prose(90, i, 500)) for i in range(40)] + [(500, None), (501, "Unseen words the of É"), (None, "the w1")]
    docs = documents(spark, rows)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not fold(i) for w in _tokens(t) if w is not None)
    train = spark.createDataFrame([(t.encode() if t else None,) for i, t in rows if not fold(i)], "text binary")
    f = lm.fit(train)
    assert f.scoring.head == sorted(f.scoring.head, key=lambda w: (-counts[w], w)) and len(f.scoring.head) <= head
    assert min((counts[w] for w in f.scoring.head), default=1) >= max((c for w, c in counts.items() if w not in f.scoring.head), default=0)
    own = set(f.scoring.head[: lm.OWN])
    class_of = lambda w: 1 + f.scoring.head.index(w) if w in own else lm.ending_class(w)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).collect()}
    for i, t in rows[::6] + rows[-3:]:
        c2 = c1 = 0
        total = 0.0
        for w in _tokens(t):
            total += _log10_token(f, counts, class_of, c2, c1, w)
            c2, c1 = c1, 0 if w is None else class_of(w)
        assert got[i] == pytest.approx(total, rel=1e-4), i
    for c2, c1 in ((0, 0), (3, 100)):
        mass = sum(10 ** _log10_token(f, counts, class_of, c2, c1, w) for w in [*counts, None])
        unseen = sum(10 ** _log10_token(f, counts, class_of, c2, c1, w) for w in (b"\xff" + bytes([k, j]) for k in range(20) for j in range(5)))
        assert 0.9 < mass < 1.0 and unseen > 0


def test_a_long_word_in_every_text(spark, monkeypatch):
    """A rule of 80 dashes is longer than the head's words: its rows are dealt by text, and nothing else is broadcast unasked."""
    rule = "-" * 80
    docs = documents(spark, [(i, f"{prose(30, i)}\n{rule}\n{prose(10, i)} {rule}") for i in range(80)])
    want = sorted(map(tuple, lm.score_texts(docs).collect()))
    monkeypatch.setattr(lm, "OFTEN", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, lm.score_texts(docs.repartition(3)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_words_inside_a_class_follow_the_class_before():
    rng = np.random.default_rng(1)
    classes = np.full(40, 90)
    counts = np.zeros((lm.CLASSES, 40))
    for c1 in (5, 6):  # after 5 the first half, after 6 the second
        counts[c1] = rng.poisson(200, 40) * (np.arange(40) // 20 == c1 - 5)
    table = 10.0 ** lm.train_inside(counts, classes).log10_table(classes)
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    assert table[5, :20].sum() > 0.95 and table[6, 20:].sum() > 0.95 and 0.2 < table[7, :20].sum() < 0.8


def test_frequent_words_are_the_most_frequent(spark):
    rng = np.random.default_rng(2)
    for top in (3, 5000):
        counts = {f"w{k}": int(c) for k, c in enumerate(rng.integers(1, top, 3000))}
        vocabulary = spark.createDataFrame([(w.encode(), c) for w, c in counts.items()], "token binary, c long")
        for most in (1, 500, 2900, 4000):
            head, c = lm.frequent_words(vocabulary, most)
            assert len(head) <= most and len(set(head)) == len(head)
            assert len(head) >= min(most, 3000) - (3 if most > 1 else 1)
            rest = max((n for w, n in counts.items() if w.encode() not in set(head)), default=0)
            assert all(n >= rest for n in c)


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, lm.CLASSES**3, 3000))
    model = lm.train_nce(cells, rng.integers(1, 50, len(cells)), steps=20)
    np.testing.assert_allclose((10.0 ** model.log10_table().astype(float)).sum(axis=2), 1, atol=1e-4)


def test_noise_contrastive_training_finds_the_distribution():
    """Trigrams that depend on the class before alone are learnt to within a few hundredths."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(4), 4)
    cells, counts = [], []
    for a in range(4):
        for b in range(4):
            for c in range(4):
                cells.append((a * lm.CLASSES + b) * lm.CLASSES + c)
                counts.append(int(20_000 * p[b, c]))
    table = 10.0 ** lm.train_nce(np.array(cells), np.array(counts), steps=400).log10_table().astype(float)
    for b in range(4):
        np.testing.assert_allclose(table[1, b, :4], p[b], atol=0.06)


def _language(lang, n, seed):
    words = {"en": "the of and that with house water under light", "fr": "le de et que avec maison eau sous être", "de": "der und die mit haus wasser unter über licht"}[lang].split()
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


def test_language_identification(spark):
    rows = [(i, _language(lang, 30, i), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 !? 45", "de"), (903, _language("fr", 20_000, 1), None), (None, _language("de", 30, 2), None), (6, _language("en", 30, 3), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x"))
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    found = {r["doc_id"]: r for r in got.collect()}
    for i, text, lang in rows:
        r = found[i]
        if i in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0
        else:
            assert r["lang_pred"] == (lang or ("fr" if i == 903 else "de")) and 0 <= r["score"] <= 1
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    blank = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}
    assert langid.identify(docs.where("doc_id < 0")).count() == 0


def test_sample_is_bounded_and_fixed(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    one = langid.sample_of(docs, rows=200)
    assert 150 < len(one) <= 200 and set(one["lang"].value_counts()) <= set(range(70, 101))
    assert one.equals(langid.sample_of(docs.repartition(7), rows=200))
    assert langid.sample_of(docs, chars=500)["text"].str.len().sum() <= 500
    # a text that repeats in very many rows, and texts that are too long by themselves
    more = [(7, "again", "en")] * 5000 + [(5000 + i, "again", "en") for i in range(5000)] + [(20_000 + i, "x" * 5000, "fr") for i in range(50)]
    two = langid.sample_of(spark.createDataFrame(more, docs.schema).unionAll(docs), rows=200, chars=4000)
    assert len(two) <= 200 and two["text"].str.len().sum() <= 4000 and set(two["lang"]) == {"en", "fr"}


def test_predictions_by_brute_force():
    """The score of a text from the model's table by the definition: n-grams hashed one by one, words averaged, softmax."""
    texts = [_language(lang, 25, i) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    model = langid.train(texts, ["en", "fr", "de"] * 30)

    def buckets(word):
        b = f"<{word}>".encode()
        out = [zlib.crc32(b) % langid.BUCKETS]
        for n in range(1, 5):
            for at in range(len(b) - n + 1):
                h = 2_166_136_261
                for x in b[at : at + n]:
                    h = (h * 16_777_619 & 0xFFFFFFFF) ^ x
                out.append((h ^ (h >> 15)) % langid.BUCKETS)
        return out

    given = [*texts[:12], "Élan vital, straße 12 x", "a", "", None, "12 34", texts[0] * 40]
    for text, (label, score) in zip(given, model.scorer().predict(given), strict=True):
        words = langid.letters_of(text or "")
        if not words:
            assert (label, score) == ("und", 0.0)
            continue
        z = np.mean([np.mean([model.table[b] for b in buckets(w)], axis=0) for w in words], axis=0) + model.bias
        e = np.exp(z / model.temperature - (z / model.temperature).max())
        assert label == model.labels[int(e.argmax())] and score == pytest.approx(float(e.max() / e.sum()), rel=1e-4)


def test_held_out_rows_of_the_tables(spark):
    """Accuracy on rows whose labels weren't seen."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("needs the shared tables")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98 * n


def test_rejection_of_unsure_texts():
    texts = [_language(lang, 20, i) for i, lang in enumerate(["en", "fr"] * 50)]
    model = langid.train(texts, ["en", "fr"] * 50)
    sure = model.scorer().predict([texts[0]])[0][1]
    unsure = model.scorer().predict(["zzz qqq"])[0][1]
    assert unsure < sure


NOTICES = {
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "LGPL": "Distributed under the GNU Lesser General Public License, version 3", "CC-BY-SA": "under CC BY-SA 4.0", "MPL-2.0": "Available under the Mozilla Public License 2.0",
}


def test_licences(spark):
    rows = [(k, prose(60, k) + "\n" + text + "\n" + prose(30, k + 50)) for k, text in enumerate(NOTICES.values())]
    rows += [(50 + k, prose(200, k) + " " + text + " " + prose(200, k + 9)) for k, text in enumerate(NOTICES.values())]
    rows += [(100, None), (101, ""), (102, prose(300, 7)), (103, "You must accept the license terms.\nCopyright 2020 by the software authors."), (104, NOTICES["MIT"] + "\n\n" + NOTICES["GPL"]), (105, prose(30_000, 1))]
    got = {r["doc_id"]: r["families"] for r in licences.scan_licences(documents(spark, rows).withColumn("families", F.lit(0))).collect()}
    for k, family in enumerate(NOTICES):
        assert got[k] == family and got[50 + k] == family
    assert [got[i] for i in (100, 101, 102, 103, 105)] == [""] * 5
    assert got[104] == "GPL,MIT"
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            assert family in licences.scan(t, licences.default_model())[0], t
    assert licences.scan_licences(documents(spark, rows).where("doc_id < 0")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h1>My site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div class="cookie-banner">We use cookies to improve this site. <button>OK</button></div>
<div id="content"><h1>A &amp; B</h1><p>First  paragraph,
with <b>bold</b> and a <a href="/y">link</a> in it.<p>Second one is here &lt;now&gt;. It goes on for a while, as text does.
<div class="ad">Buy our things now.</div>
<ul><li>An item of the list<li>Another item of it</ul><p>The last paragraph closes the story, with words enough to be one.</p></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One thing</a><li><a href=/2>Other thing</a></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thank you for it.</p></div></section>
<form class="search"><label>Search</label><input name=q><p>Type and press enter.</p></form>
<script>var a = "</p><p>no";</script><footer>&copy; 2024 My site &middot; all rights</footer></body></html>"""
TEXT = """A & B
First paragraph, with bold and a link in it.
Second one is here <now>. It goes on for a while, as text does.
An item of the list
Another item of it
The last paragraph closes the story, with words enough to be one."""


def test_main_text():
    model = html.default_model()
    assert html.main_text(PAGE, model) == TEXT
    assert html.main_text(None, model) == html.main_text("", model) == html.main_text("<p>", model) == ""
    assert html.main_text("<article><p>" + "word " * 100_000 + "</article>", model).count("word") == 100_000
    html.main_text("<" * 2000 + "<p <a <!-- " * 50, model)


RECIPE = """<!doctype html><html lang=de><head><title>Brot</title></head><body class="home blog">
<div id="topbar"><a href="/">Backstube</a> <a href="/shop">Laden</a> <a href="/kontakt">Kontakt</a></div>
<article class="post"><h1>Brot backen</h1><p>Am Abend vorher wird der Teig angesetzt, damit er in Ruhe gehen kann.</p>
<figure><img src="brot.jpg"><figcaption>Ein Laib nach dem Backen. Foto: A. Muster</figcaption></figure>
<h2>So geht es</h2><ol><li>Mehl und Wasser mischen.</li><li>Den Teig zwei Stunden ruhen lassen.</li><li>Bei 230 Grad backen.</li></ol>
<div class="newsletter">Melden Sie sich an!</div>
<dl><dt>Krume</dt><dd>Das Innere des Brotes, weich und feucht.</dd><dt>Kruste</dt><dd>Die harte Rinde.</dd></dl>
<p>Nach einer Stunde ist es fertig und darf auf einem Rost ausk&uuml;hlen.</p></article>
<div class="cookie-notice"><p>Wir verwenden Cookies, um Ihnen das beste Erlebnis zu bieten.</p></div>
<footer><p>Impressum | Datenschutz</p></footer></body></html>"""
ARTICLE = """Brot backen
Am Abend vorher wird der Teig angesetzt, damit er in Ruhe gehen kann.
Ein Laib nach dem Backen. Foto: A. Muster
So geht es
Mehl und Wasser mischen.
Den Teig zwei Stunden ruhen lassen.
Bei 230 Grad backen.
Krume
Das Innere des Brotes, weich und feucht.
Kruste
Die harte Rinde.
Nach einer Stunde ist es fertig und darf auf einem Rost ausk\u00fchlen."""
BARE = """<html><body><table width=100%><tr><td bgcolor=#eee><a href=a>Home</a><br><a href=b>Archive</a></td><td>
<h2>Notes on the harbour</h2><p>The harbour was built by hand, stone by stone, over eleven long years.<p>Ships still call there twice a week in summer.
</td></tr></table><p align=center><font size=1>Copyright 1999 &copy; The Harbour Pages</font></body></html>"""


def test_pages_that_no_rule_laid_out():
    """Lists, captions and definitions are kept, a notice inside the article is not."""
    model = html.default_model()
    assert html.main_text(RECIPE, model) == ARTICLE
    bare = html.main_text(BARE, model)
    assert "stone by stone" in bare and "twice a week" in bare and "Archive" not in bare and "Copyright" not in bare


#: Written by hand, never for training: page and its main text.
BY_HAND = {
    "text in the body": (
        "<html><head><title>x</title></head><body>The harbour was built by hand over eleven years.<br><br>Ships still call there twice a week.</body></html>",
        "The harbour was built by hand over eleven years. Ships still call there twice a week.",
    ),
    "names that say nothing": (
        '<html><body><div class="a1"><a href="/">Home</a> <a href="/x">About us</a></div><div class="b7"><div class="c2"><h1>Harbour news</h1><p>Ships call twice a week.</p></div></div></body></html>',
        "Harbour news\nShips call twice a week.",
    ),
    "details": (
        "<html><body><main><h1>Questions</h1><details><summary>How do I pay?</summary><p>By card or in cash at the counter.</p></details><details><summary>When are you open?</summary><p>From nine to five on all days.</p></details></main></body></html>",
        "Questions\nHow do I pay?\nBy card or in cash at the counter.\nWhen are you open?\nFrom nine to five on all days.",
    ),
    "readers in divisions without names": (
        "<html><body><article><h1>Harbour</h1><p>The harbour was built by hand, stone by stone, over eleven long years.</p><p>Ships still call there twice a week in summer.</p></article><div><div>Bob wrote: I liked this a lot, thank you.</div><div>Anna wrote: My grandfather worked there for years.</div></div><footer>x</footer></body></html>",
        "Harbour\nThe harbour was built by hand, stone by stone, over eleven long years.\nShips still call there twice a week in summer.",
    ),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_written_by_hand(name):
    page, text = BY_HAND[name]
    assert html.main_text(page, html.default_model()) == text


def test_a_list_of_links_that_is_the_page():
    page = "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><main><h1>Resources</h1><ul><li><a href=/1>The old harbour and its builders</a></li><li><a href=/2>Stone by stone, a history</a></li><li><a href=/3>Ships of the summer</a></li></ul></main></body></html>"
    found = html.main_text(page, html.default_model())
    assert "The old harbour and its builders" in found and "Blog" not in found


def test_broken_pages_are_read_in_linear_time():
    model = html.default_model()
    for page in ("<" * 300_000, "<a " * 100_000, '<a "' * 100_000, "<b>" * 20_000 + "x", "<div>" * 20_000 + "x", "<!-- " * 100_000, "<p><li>" * 20_000):
        html.main_text(page, model)
    stray = '<article><h1>Title here</h1><p class=x" id=y>Some words are here, and more of them too.</p></article>'
    assert html.main_text(stray, model) == "Title here\nSome words are here, and more of them too."
    bare = "<body><p>A paragraph in the body, with nothing around it.</p><p>And another one that goes on for longer.</p><div class=footer>x</div>"
    assert html.main_text(bare, model).count("\n") == 1


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all labellings of small trees."""
    import itertools

    rng = np.random.default_rng(0)
    parents = [-1, 0, 0, 1, 1, 2]
    unary, edges = list(rng.normal(0, 2, 6)), [list(rng.normal(0, 2, 4)) for _ in range(6)]
    odds = html.sum_product(unary, parents, edges)[0]
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        s = sum(u for u, b in zip(unary, y, strict=True) if b) + sum(edges[i][2 * y[parents[i]] + y[i]] for i in range(1, 6))
        weight[y] = math.exp(s)
    for i in range(6):
        on, off = sum(w for y, w in weight.items() if y[i]), sum(w for y, w in weight.items() if not y[i])
        assert odds[i] == pytest.approx(math.log(on / off), abs=1e-9)


def test_pages_held_out():
    model, right, total = html.default_model(), 0, 0
    for page in html_pages.pages(html_pages.PAGES + 100)[html_pages.PAGES :]:
        nodes = html_pages.labelled(html.parse(page))
        for node, p in zip(nodes, html.marginals(nodes, model), strict=True):
            if node.tag == "#":
                right, total = right + ((p > 0.5) == node.label), total + 1
    assert right / total > 0.98


def test_extraction_over_rows(spark):
    rows = [(1, "http://x", PAGE), (2, None, None), (None, "u", ""), (1, "http://x", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = sorted(map(tuple, html.extract(df).collect()), key=repr)
    assert got == sorted([(1, "http://x", TEXT, len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (1, "http://x", TEXT, len(TEXT))], key=repr)
    assert html.extract(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("start", ["</head><body>", "<body>", "", "<meta charset=utf-8><link rel=x href=/y/><script src='a.js'/><body>", "<template><p>no</template><body>"])
def test_optional_head_end_loses_nothing(start):
    assert "</head><body>" in PAGE
    page = PAGE.replace("</head><body>", start)
    assert html.main_text(page, html.default_model()) == TEXT
    assert [n.text for n in html.parse("<head><title>T</title>Words <p>More")[1:] if n.tag == "#"] == ["Words", "More"]


def test_self_closed_dropped_elements_swallow_nothing():
    def runs(page):
        return [n.text for n in html.parse(page) if n.tag == "#"]

    for empty in ("<svg/>", '<svg class="i" />', "<canvas/>", "<iframe src='x'/>", '<script src="x"/>', "<object hidden/>"):
        assert runs(f"<div>{empty}<p>One</p></div><p>Two</p>") == ["One", "Two"], empty
        assert html.main_text(PAGE.replace("<body>", f"<body>{empty}"), html.default_model()) == TEXT, empty
    assert runs("<svg><title/><text>no</text></svg><p>One</p>") == ["One"]
    assert runs("<script src=x/>var no</script><object data=/x/>no</object><script/>no</script><p>One</p>") == ["One"]


@pytest.mark.parametrize(
    "line, families",
    [
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-3.0-only", ["GPL"]),
        ("/* SPDX-License-Identifier: (MIT OR LGPL-2.1-or-later) */", ["LGPL", "MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL"]),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC-BY-SA"]),
        ("SPDX-License-Identifier: Beerware", []),
        ("License: MIT", ["MIT"]),
        ('license = "Apache-2.0"', ["Apache-2.0"]),
        ("License: GPL v2 or later", ["GPL"]),
        ("Licence: LGPL-2.1+", ["LGPL"]),
        ("License: BSD 3-Clause", ["BSD"]),
        ("License: see the file COPYING", []),
        ("It may be used under LGPL v2.1 in all countries.", ["LGPL"]),
        ("Released under the GPLv3.", ["GPL"]),
        ('The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability.', ["MIT"]),
        ("This software is provided by the regents and contributors ``as is'' and any express or implied warranties, including, but not limited to, the implied warranties of merchantability are disclaimed.", ["BSD"]),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that this permission notice appear in all copies.", ["ISC"]),
        ("This code is available under the zlib license.", ["Zlib"]),
        ("Use is subject to the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("All of it is released under the Eclipse Public License v2.0", ["EPL"]),
        ("You may use it under the European Union Public Licence (EUPL) v1.2", ["EUPL"]),
        ("It is distributed under the Artistic License 2.0, like Perl.", ["Artistic"]),
        ("This project is MIT licensed.", ["MIT"]),
    ],
)
def test_licence_wordings_that_are_no_templates(line, families):
    model = licences.default_model()
    assert licences.scan(line, model)[0] == families
    assert licences.scan(f"{prose(60, 3)}\n{line}\n{prose(40, 4)}", model)[0] == families


def _pieces_by_brute_force(words, model):
    """The definition, every name at every place and every template in turn."""
    spots = []
    for family, names in licences.NAMES.items():
        for name in names:
            n = licences.words_of(name)
            spots += [(i, i + len(n), family) for i in range(len(words)) if words[i : i + len(n)] == n]
    spots = [x for x in spots if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in spots)]
    out = []
    for a, z, family in sorted(spots):
        piece = words[max(0, a - 8) : z + 8]
        pairs = set(zip(piece, piece[1:]))
        named = [set(zip(t, t[1:])) for t in map(licences.words_of, licences.TEMPLATES.get(family, ())) if any(f == family for f, _, _ in licences.named(t))]
        if any(len(pairs & t) >= 0.5 * min(len(pairs), len(t)) for t in named):
            out.append((family, piece))
    if len(words) >= 5:
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        found = []
        for family, runs in model.bodies:
            at = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in runs]
            common = len({tuple(words[i : i + 5]) for i in at})
            if at and common >= 0.5 * min(len(own), len(runs)):
                found.append((common / len(own | runs), family, at[0], at[-1] + 5))
        for share, family, a, z in found:
            if family and not any(s > share and b < z and a < e for s, _, b, e in found):
                out.append((family, words[a:z]))
    return out


def test_pieces_by_brute_force():
    import random

    model, rng = licences.default_model(), random.Random(4)
    texts = [t for ts in licences.TEMPLATES.values() for t in ts] + licences.RELATIVES + list(NOTICES.values())
    bag = [w for t in texts for w in licences.words_of(t)]
    several = 0
    for k in range(1200):
        words = prose(rng.randint(0, 30), k).split() + licences.words_of(rng.choice(texts)) + rng.choices(bag, k=rng.choice((0, 0, 9)))
        if k % 3 == 0:
            words = [w for w in words if rng.random() > 0.1]
        got = list(licences.pieces(words, model))
        several += bool(got)
        assert sorted(got) == sorted(_pieces_by_brute_force(words, model)), words
    assert several > 600


OTHERS = {
    "CDDL": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License. You can obtain a copy of the license at http://www.opensolaris.org/os/licensing.',
    "Elastic": "Licensed under the Elastic License 2.0; you may not use this file except in compliance with the Elastic License 2.0.",
    "SSPL": "This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc.",
    "HPND": licences.RELATIVES[1],
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "0BSD": licences.RELATIVES[0],
    "CC BY-NC-SA": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "X11": "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "OSL": "Licensed under the Open Software License version 3.0",
    "MS-PL": "This code is licensed under the Microsoft Public License.",
    "GFDL": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
}


@pytest.mark.parametrize("name", OTHERS)
def test_licences_that_are_no_family(name):
    model = licences.default_model()
    for text in (OTHERS[name], f"{prose(50, 3)} {OTHERS[name]} {prose(50, 4)}", OTHERS[name].upper()):
        assert licences.scan(text, model)[0] == [], text


def test_families_left_out_are_seldom_taken_for_others():
    """The licence texts of each family by a model that has never seen it."""
    wrong = total = 0
    for family in licences.TEMPLATES:
        model = licences.train(600, templates={f: t for f, t in licences.TEMPLATES.items() if f != family})
        for text in licences.TEMPLATES[family]:
            total += 1
            wrong += bool(licences.scan(text, model)[0])
    assert total > 60 and wrong <= 2
