"""Brute-force versions and fixtures shared by these tests."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}w{k}" for k in range(vocabulary)]
    common = "the of and to in a is that".split()
    return " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(n))


def documents(spark, rows, lang="en"):
    """Rows (doc_id, text[, source]) as documents with an extra column of a clashing kind."""
    full = [(r[0], r[1], lang, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def lower_az(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None) -> frozenset:
    w = space_words(lower_az(text))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, percent: int = 85) -> dict:
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
