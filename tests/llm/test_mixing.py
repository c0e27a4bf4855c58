import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from tangentia.llm import mixing


def _water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(5 + i * 7 % 90, i), ("hot", "hot", "small", "B", "a", "é")[i % 6]) for i in range(300)]
    rows = [r for r in rows if r[2] != "small" or r[0] < 10]
    return rows + [(900, None, "hot"), (901, "", "empty"), (902, prose(30, 1), None), (None, prose(20, 2), "a"), (903, prose(4000, 3), "B"), (5, prose(9, 5), "hot"), (5, prose(9, 5), "hot")]


@pytest.mark.parametrize("bucket", [2000, 3])
def test_targets_and_takings(spark, corpus, bucket):
    docs = documents(spark, corpus).withColumn("size", F.lit("clash")).repartition(6)
    got = mixing.mix(docs, bucket_docs=bucket).toPandas()
    assert len(got) == len(corpus)
    sizes: dict = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = _water(sizes)
    for source, part in got.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert part["source_size"].iloc[0] == sizes[source]
        assert part["target"].iloc[0] == pytest.approx(want[source])
        assert abs(part["taken"].sum() - want[source]) <= 0.5
        whole = int(want[source] // sizes[source]) if sizes[source] else 0
        assert (part["taken"] >= whole * part["size"]).all() and (part["taken"] <= (whole + 1) * part["size"]).all()
        assert ((part["taken"] != whole * part["size"]) & (part["taken"] != (whole + 1) * part["size"])).sum() <= 1
    assert (got["taken"] <= 3 * got["size"]).all()
    assert got["target"].groupby(got["source"].fillna("\0")).first().sum() == pytest.approx(sum(sizes.values()))


def test_reruns_and_buckets_agree(spark, corpus):
    docs = documents(spark, corpus)

    def run(df, **options):
        return sorted(map(tuple, mixing.mix(df, **options).select("doc_id", "source", "size", "taken").collect()), key=repr)

    one = run(docs)
    assert one == run(docs.repartition(7)) == run(docs, bucket_docs=5)
    assert one != run(docs, seed="another")


def test_a_hot_source_and_many_ranges_of_sources(spark, corpus, monkeypatch):
    """Nothing is broadcast unasked, every source but the small ones counts as hot, and a task orders two sources at most."""
    corpus = corpus + [(2000 + k, prose(4, k), f"one{k}") for k in range(25)]
    want = sorted(map(tuple, mixing.mix(documents(spark, corpus)).collect()), key=repr)
    monkeypatch.setattr(mixing, "HOT", 5)
    monkeypatch.setattr(mixing, "ORDERED", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.mix(documents(spark, corpus).repartition(5), bucket_docs=20)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_better_documents_come_first(spark):
    """Over many draws, documents of more letters are taken more often."""
    rows = [(i, ("word " * 10 if i % 2 else "12345 w ").strip() * 1, "a") for i in range(400)] + [(1000 + i, "more words here", "b") for i in range(400)]
    got = mixing.mix(documents(spark, rows), weights=(1, 3)).where("source = 'a'").toPandas()
    share = got.assign(good=got.doc_id % 2 == 1).groupby("good").apply(lambda g: (g.taken > 0).mean(), include_groups=False)
    assert share[True] > share[False]


def test_ranges_of_low_weights_and_equal_keys_are_cut(spark):
    """Documents of weight 0.05 only, of mixed weights, and of one id: what is sorted in one place stays small where keys differ."""
    rows = [(i, "1234 5 678 9", "low") for i in range(3000)] + [(10_000 + i, "abc 5" if i % 3 else "1 2 3 4 5", "mixed") for i in range(3000)]
    rows += [(None, f"w{i}", "one") for i in range(500)]
    docs = documents(spark, rows)
    base = docs.select(F.col("source"), mixing.size_of(F.col("text")).alias("size"), (-F.log(F.rand(3)) / mixing.quality_of(F.col("text"))).alias("key"))
    base = base.withColumn("key", F.when(F.col("source") == "one", F.lit(1.0)).otherwise(F.col("key"))).cache()
    plan = base.groupBy(mixing._name(F.col("source")).alias("name")).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = plan.withColumn("budget", (F.col("source_size") * 0.6).cast("long"))
    for bucket in (200, 20):
        got = {r["name"][1:]: r for r in mixing._edges(base, plan, bucket, 1000 if bucket == 20 else 10_000).collect()}
        keys = {s: [(r["key"], r["size"]) for r in base.where(F.col("source") == s).collect()] for s in got}
        for s, r in got.items():
            inside = [x for x in keys[s] if r["low"] < x[0] <= r["high"]]
            before = sum(x[1] for x in keys[s] if x[0] <= r["low"])
            assert before == r["before"] <= r["budget"] < before + sum(x[1] for x in inside)
            assert len(inside) <= (bucket if s != "one" else 500)
    one = mixing.mix(docs, bucket_docs=50).toPandas()
    assert abs(one.groupby("source").taken.sum() - one.groupby("source").target.first()).max() <= 0.5


def test_rows_of_the_mix_carry_their_texts(spark, corpus):
    docs = documents(spark, corpus).withColumn("taken", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("_x y", F.lit(1)).repartition(4)
    for bucket in (2000, 3):
        got = mixing.take(docs, bucket_docs=bucket)
        assert got.columns == [c for c in docs.columns if c != "taken"] + ["taken"]
        texts = {(r["doc_id"], r["source"], r["text"]) for r in docs.collect()}
        assert {(r["doc_id"], r["source"], r["text"]) for r in got.collect()} <= texts
        want = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.count("*").alias("n"))
        have = got.groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.count("*").alias("n"))
        assert sorted(map(tuple, have.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert mixing.take(docs.where("doc_id < 0")).count() == 0


def test_nothing(spark):
    assert mixing.mix(documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0
    r = mixing.mix(documents(spark, [(1, None)])).first()
    assert (r["size"], r["target"], r["taken"]) == (0, 0.0, 0)
