"""Operators on embeddings against brute force over small tables with nulls, ties, repeats and padded vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from tangentia.llm import codes, negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v_ string, rank int, score string, _block int, d double, code string"


def rows_of(n, seed=1, width=8, levels=5):
    """Coarse components, so that scores tie; nulls, non-finite ones, short vectors, repeated and null ids among them."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        v = [rng.randrange(-levels, levels + 1) / 16 for _ in range(width)]
        out.append([k * 10, v, rng.randrange(3)])
    out[3][1], out[4][1][2], out[5][1][0], out[6][1][1] = None, None, math.nan, -math.inf
    out[7][1], out[8][1] = out[7][1][:5], []
    out[9][2] = out[11][2] = out[13][2] = None
    out[12][0] = None
    out += [list(out[20]), [out[21][0], out[22][1], 1], [1, list(out[20][1]), 2], [2, [0.25] * width, -3]]
    return [(i, v, y, "x", 1, "s", 0, 0.5, "c") for i, v, y in out]


def taking_part(rows, scale):
    return [
        (i, [math.floor(scale * x) for x in v], y)
        for i, v, y, *_ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k, scale=1024):
    known = [r for r in taking_part(rows, scale) if r[0] is not None]
    out = []
    for i, v, _ in known:
        if i % 100 == 0:
            best = sorted((-dot(v, w), j) for j, w, _ in known if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, positives, negatives_, scale=256):
    known = [r for r in taking_part(rows, scale) if r[0] is not None and r[2] is not None]
    out = []
    for i, v, y in known:
        if i % 100 == 0:
            scored = sorted((-dot(v, w), j, z) for j, w, z in known if j != i)
            for p, j, _ in [x for x in scored if x[2] == y][:positives]:
                inside = [(s, m) for s, m, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p][:negatives_]
                out += [(i, j, r, m, -p, -s) for r, (s, m) in enumerate(inside, 1)]
    return sorted(out)


def brute_codes(rows, parts, entries, rounds, scale=256):
    known = sorted(taking_part(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for *_, v, _ in known), default=1) // parts) * parts
    size = width // parts
    x = [[(v + [0] * (width - len(v)))[s * size : (s + 1) * size] for s in range(parts)] for _, v, _ in known]
    books = [[x[k][s] for k in range(min(entries, len(x)))] for s in range(parts)]

    def gap(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b))

    def assigned():
        return [[min(range(len(books[s])), key=lambda e: (gap(v[s], books[s][e]), e)) for s in range(parts)] for v in x]

    for _ in range(rounds):
        a = assigned()
        for s in range(parts):
            for e in range(len(books[s])):
                own = [v[s] for v, c in zip(x, a) if c[s] == e]
                if own:
                    books[s][e] = [sum(c) // len(own) for c in zip(*own)]
    a = assigned()
    errors = [sum(gap(v[s], books[s][c[s]]) for s in range(parts)) for v, c in zip(x, a)]
    sums = {}
    for (_, _, y), e in zip(known, errors):
        sums[y] = sums.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{c:02x}" for c in k), e, sums[y]) for (i, _, y), k, e in zip(known, a, errors)]
    return sorted(out, key=str), digest


@pytest.fixture(params=[1 << 20, 24])
def block(request, monkeypatch):
    """All queries in one block, or a few in each of several."""
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", request.param)


def test_search_is_exact(spark, block):
    rows = rows_of(120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = topk.search(df.where("vec_id % 100 = 0"), df, k=4)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 4)


def test_fewer_rows_than_asked_and_queries_of_another_table(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (5, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, topk.search(df.where("vec_id = 0"), df, k=10, scale=2).collect()))
    assert found == [(0, 1, 5, 4), (0, 2, 100, 0)]
    other = spark.createDataFrame([(7, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in topk.search(other, df, k=2, scale=2).orderBy("rank").collect()] == [(1, 100, 2), (2, 5, -2)]


def test_mined_negatives_are_exact(spark, block):
    rows = rows_of(150, seed=4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = negatives.mine(df.where("vec_id % 100 = 0"), df, positives=3, negatives=4)
    expected = brute_negatives(rows, 3, 4)
    assert len(expected) > 20
    assert sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("width, entries", [(8, 6), (7, 64)])
def test_codes_are_those_of_brute_force(spark, width, entries):
    rows = rows_of(90, seed=2, width=width, levels=40)
    found = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(4), parts=4, entries=entries)
    expected, digest = brute_codes(rows, 4, entries, 2)
    out = codes.with_label_errors(found.rows).select("vec_id", "code", "error", "label_error")
    assert sorted(map(tuple, out.collect()), key=str) == expected
    assert found.digest == digest


def test_label_errors_with_every_label_frequent_or_none(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 3 or None, "c", 10 + k) for k in range(30)], "vec_id long, label int, code string, error long")
    sums = {y: sum(10 + k for k in range(30) if (k % 3 or None) == y) for y in (None, 1, 2)}
    for often in (1, 1000):
        monkeypatch.setattr(codes, "OFTEN", often)
        found = codes.with_label_errors(df)
        assert sorted(map(tuple, found.select("vec_id", "label_error").collect())) == [(k, sums[k % 3 or None]) for k in range(30)]
    assert codes.with_label_errors(df.withColumn("error", df.error * 0 + (1 << 62))).first()["label_error"] == (1 << 63) - 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(0, None, 1)], "vec_id long, embedding array<float>, label int")
    for x in (df, nulls):
        assert topk.search(x, x).collect() == []
        assert negatives.mine(x, x).collect() == []
        found = codes.compress(x)
        assert codes.with_label_errors(found.rows).collect() == []
        assert found.digest == hashlib.sha256(b"").hexdigest()


def test_elimination_skips_what_the_bound_rules_out():
    """Two far clusters: the other cluster's rows aren't evaluated, and the result is that of all pairs."""
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(2000, 16)) * 20)
    c[1000:, 0] += 4000
    c[:1000, 1] += 4000
    pivots = c[::100]
    ids = np.arange(2000)
    q = c[[5, 1005]]
    best = topk.Best(2, 10)
    seen = topk.search_block(best, np.arange(2), (ids[[5, 1005]], q, topk.distances(q, pivots)), (ids, c, topk.distances(c, pivots)))
    assert seen < 2100
    scores = (q @ c.T).astype(np.int64)
    scores[[0, 1], [5, 1005]] = vectors.LOW
    for k in range(2):
        assert best.ids[k].tolist() == sorted(ids.tolist(), key=lambda i: (-scores[k, i], i))[:10]


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    for size in (1, 3000, 2**27):
        x = np.floor(rng.normal(size=(300, 8)) * size)
        d = topk.distances(x, x[:20])
        assert (topk.bounds(d, d) >= vectors.products(x, x)).all()


def test_cells_hold_the_nearest_entry_and_measure_few():
    rng = np.random.default_rng(2)
    entries = rng.integers(-300, 300, size=(64, 4))
    x = rng.integers(-400, 400, size=(500, 4))
    cells = codes.Cells.of(entries)
    d = ((x[:, None] - entries) ** 2).sum(2)
    lower, upper = cells.bounds(x)
    assert (lower <= d).all() and (d <= upper).all()
    entry, least, measured = cells.nearest(x)
    assert entry.tolist() == d.argmin(1).tolist() and least.tolist() == d.min(1).tolist()
    assert measured < 0.2 * d.size


def test_products_are_exact_beyond_53_bits_and_integers_saturate():
    a = np.array([[2.0**28, 3.0], [1.0, -(2.0**28)]])
    b = np.array([[2.0**28 - 1, 5.0]])
    assert vectors.products(a, b).tolist() == [[2**28 * (2**28 - 1) + 15], [2**28 - 1 - 5 * 2**28]]
    import pyarrow as pa

    taken, x = vectors.matrix(pa.array([[1e300, -1e300], [0.5, None], [1.0]]), 1024, 2)
    assert taken.tolist() == [True, False, True]
    assert x.tolist() == [[math.isqrt(2**59), -math.isqrt(2**59)], [1024, 0]]
