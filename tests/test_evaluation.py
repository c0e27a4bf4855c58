import itertools
import math
import time

import numpy as np
import pytest

from tangentia.operators import evaluation as ev


@pytest.fixture()
def noisy(spark):
    rng = np.random.default_rng(0)
    gt = rng.integers(0, 3, 600)
    c = (gt + 1) % 3
    flip = rng.random(600) < 0.05
    c[flip] = rng.integers(0, 3, flip.sum())
    gt[:20] = -1
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(c, gt, strict=True)], "c int, gt int")


def test_permuted_segmentation(spark, noisy):
    assert ev.evaluate(noisy)["oa"] > 0.85
    assert ev.evaluate(noisy)["miou"] > 0.85
    same = spark.createDataFrame([(k, k) for k in range(3)] * 4, "c int, gt int")
    assert ev.evaluate(same) == {"miou": 1.0, "oa": 1.0, "ari": 1.0, "ami": pytest.approx(1.0)}
    assert [r["k"] for r in ev.classes(noisy).collect()] == [0, 1, 2]


def test_scores_against_definitions(noisy):
    rows = [(r["c"], r["gt"]) for r in noisy.collect()]
    labelled = [x for x in rows if x[1] >= 0]
    assert ev.overall_accuracy(noisy).first()["oa"] == pytest.approx(np.mean([a == b for a, b in labelled]))
    for r in ev.iou_by_class(noisy).collect():
        k = r["k"]
        assert r["n_inter"] == sum(a == b == k for a, b in labelled)
        assert r["n_union"] == sum(k in x for x in labelled)


def test_rand_index_by_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 3, 40), rng.integers(0, 2, 40), strict=True)]
    same = [(x[0] == y[0], x[1] == y[1]) for x, y in itertools.combinations(rows, 2)]
    n = len(same)
    i, a, b = sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same)
    want = (i - a * b / n) / ((a + b) / 2 - a * b / n)
    df = spark.createDataFrame(rows, "c int, gt int")
    assert ev.adjusted_rand(df).first()["ari"] == pytest.approx(want)
    assert abs(ev.adjusted_mutual_information(df)) < 0.2


def _expected(x, y, n):
    """By the definition, every overlap."""
    lg = math.lgamma
    total = 0.0
    for k in range(max(1, x + y - n), min(x, y) + 1):
        p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
        total += k / n * math.log(n * k / (x * y)) * math.exp(p)
    return total


def test_chance_term_of_mutual_information():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 1000, 30_000):
        for _ in range(25):
            x, y = (int(v) for v in rng.integers(1, n + 1, 2))
            assert ev._expected_term(x, y, n) == pytest.approx(_expected(x, y, n), rel=1e-7, abs=1e-10), (x, y, n)
    began = time.time()
    assert abs(ev._expected_term(4 * 10**10, 3 * 10**10, 10**11)) < 1e-9
    assert time.time() - began < 5


def test_assignment_is_best():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (2, 4), (4, 5), (1, 1)):
        gain = rng.integers(0, 20, (n, m)).astype(float)
        got = sum(gain[i, j] for i, j in enumerate(ev.best_assignment(gain)))
        assert got == max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    with pytest.raises(ValueError):
        ev.best_assignment(np.zeros((3, 2)))


def test_fewer_clusters_than_classes_and_negatives(spark):
    df = spark.createDataFrame([(0, 2), (0, 2), (1, 0), (1, 3), (-1, 1), (1, -3), (None, 2)], "c int, gt int")
    named = ev.assign(df)
    assert [r["c"] for r in named.collect()][:2] == [2, 2]
    assert ev.assign(df, normalize=True).count() == 7
    only = spark.createDataFrame([(5, -1)], "c int, gt int")
    assert ev.iou_by_class(only).first()["iou"] is None
    assert ev.mean_iou(only).first()["miou"] is None
    outcomes = ev.true_false_map(spark.createDataFrame([(0, 0), (0, 1), (1, 0), (0, -1), (1, 1)], "c int, gt int"), 0)
    assert [r["outcome"] for r in outcomes.collect()] == [3, 2, 1, 0, 0]
