"""Spaced seeds: no alignment that the thresholds accept is missed."""

import math
import random

import numpy as np
import pytest

import brute as B
from assetloom.llm import decontaminate


def most_without_seed(masks, n):
    """The most equal tokens of n that hold no mask, over all patterns: a walk over the last tokens."""
    span = max(m[-1] for m in masks) + 1
    ends = [sum(1 << (m[-1] - k) for k in m) for m in masks]
    best = {0: 0}
    for _ in range(n):
        after = {}
        for bits, ones in best.items():
            for b in (0, 1):
                now = (bits << 1 | b) & ((1 << span) - 1)
                if not any(now & e == e for e in ends):
                    after[now] = max(after.get(now, 0), ones + b)
        best = after
    return max(best.values())


@pytest.mark.parametrize("n", range(8, 21))
def test_every_pattern_holds_a_seed(n):
    patterns = np.arange(1 << n)
    able = patterns[np.bitwise_count(patterns) >= 0.7 * n]
    found = np.zeros(len(able), bool)
    for m in decontaminate.masks_for(n):
        for at in range(n - m[-1]):
            mask = sum(1 << (at + k) for k in m)
            found |= (able & mask) == mask
    assert found.all()


def test_longer_items_and_windows():
    for n in [*range(1, 300), 1000, 5000]:
        masks = decontaminate.masks_for(n)
        assert most_without_seed(masks, n) < math.ceil(0.7 * n)
        if n > 20:
            assert most_without_seed(masks, 20) < 16
    for share in (0.5, 0.6, 0.8, 0.9, 1.0):
        assert all(most_without_seed(decontaminate.masks_for(n, share), n) < math.ceil(share * n) for n in range(1, 100))


def test_pairs_at_the_threshold(spark):
    rnd = random.Random(3)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (8, 9, 10, 12, 14, 16, 20, 25, 40)]
    texts = []
    for n, t in items:
        for _ in range(60):
            lost = set(rnd.sample(range(n), n - math.ceil(0.7 * n)))
            texts.append(" ".join(["a", *["zz" if k in lost else w for k, w in enumerate(t.split())], "b"]))
    want = {(d, n) for d, t in enumerate(texts) for n, b in items if B.holds(t, b)}
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) == len(texts)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench).collect()} == want


def test_short_items_match_whole(spark):
    bench = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 8)], "item_id long, text string")
    texts = [f"a {t}, b" for n in range(1, 8) for t in (" ".join(f"i{n}w{k}" for k in range(n)), " ".join(f"i{n}w{k}" for k in range(n - 1)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench, short_items=True).collect()}
    assert got == {(2 * n - 2, n) for n in range(1, 8)}
