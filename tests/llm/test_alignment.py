"""Token alignment against plain sets of ends, and the corpus counts against a plain recount."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.common import load
from assetloom.llm import alignment as A, queries as Q


def plain(text, pair):
    """(n_a, n_b, groups, linked id pairs) by sets of ends."""
    if not text:
        return 0, 0, "", []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    joined = ["".join(map(chr, b"".join(own[x] for x in ids))) for own, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
    if joined != ["".join(map(chr, (" " + text).encode()))] * 2:
        return 0, 0, "", []
    ends = []
    for own, ids in ((pair.bytes_a, a), (pair.bytes_b, b)):
        at, out = 0, []
        for x in ids:
            at += len(own[x])
            out.append(at)
        ends.append(out)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, links, before = [], [], 0
    for c in cuts:
        inside = [[x for x, e in zip(ids, own) if before < e <= c] for ids, own in ((a, ends[0]), (b, ends[1]))]
        groups.append("|".join(",".join(map(str, x)) for x in inside))
        links.append((inside[0][-1], inside[1][-1]))
        before = c
    return len(a), len(b), ";".join(groups), links


TEXTS = [
    None, "", " ", "x", "Hello, world", "a▁b is not given back", "<|endoftext|> and </s> <s> <0x0A> are plain", "tab\tand\r\nbreaks\n\n  blanks   ", "日本語 テキスト 𝒳𝒴 émigré ﬁ",
    "antidisestablishmentarianism " * 40, "\x00\x01\x02", "1234567890 " * 30, "é" * 3000, "z" * 5000, "ünïcödé " * 200, "Ａｆｕｌｌ",
]


@pytest.fixture(scope="module")
def pair():
    return A.tokenizer_pair(A.A_FILE, A.B_FILE)


def test_texts(pair):
    rnd = random.Random(1)
    noise = ["".join(chr(rnd.choice([32, 10, 97, 98, 233, 8364, 0x4E00, 0x1D400]) + rnd.randint(0, 20)) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    texts = [t or "" for t in TEXTS + noise]
    for text, (n_a, n_b, n, groups, pairs, times) in zip(texts, A.align_chunk(texts, pair)):
        a, b, expected, links = plain(text, pair)
        assert (n_a, n_b, groups, n) == (a, b, expected, len(links)), text
        counted = Counter(x * len(pair.bytes_b) + y for x, y in links)
        assert dict(zip(map(int, pairs), map(int, times))) == dict(counted)


def test_shared_ends_far_from_the_middle():
    """Intervals whose only common ends lie beyond the probes, and long ones without any."""
    rnd = np.random.default_rng(2)
    for _ in range(200):
        n = int(rnd.integers(2, 400))
        a = np.unique(np.append(rnd.integers(1, 1000, n) * 2, 4000))
        b = np.unique(np.concatenate([rnd.integers(1, 1000, n) * 2 + 1, rnd.choice(a, int(rnd.integers(0, 4))), [4000]]))
        i, j = A.shared_ends(a, b, np.array([0]), np.array([len(a) - 1]), np.array([0]), np.array([len(b) - 1]))
        both = np.intersect1d(a, b)
        assert (a[i] == both).all() and (b[j] == both).all()


def recount(rows, pair):
    """What op12 returns, from plain alignments of (id, text) rows."""
    aligned = [(k, *plain(t, pair)) for k, t in rows]
    total = Counter(x for row in aligned for x in row[4])
    highest = Counter()
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(k, a, b, len(x), len(x), sum(total[p] == highest[p[1]] for p in x), sum(total[p] for p in x), digest(g)) for k, a, b, g, x in aligned]


def test_query(spark, sf_dir, pair):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, Q.op12_token_alignment(spark, sf_dir).collect())) == sorted(recount(rows, pair))


@pytest.mark.parametrize("bound", [0, 40, 10**6])
def test_frequent_and_rare_pairs(spark, pair, bound):
    """Any bound of the broadcast gives the same sums; odd rows and clashing columns."""
    rows = [*enumerate(TEXTS), (None, "Hello, world"), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("x", "pair", "pairs", "times", "n", "p", "groups", "total")})
    found = A.score_links(A.align_documents(df), len(pair.bytes_b), broadcast_pairs=bound)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in found.collect()]
    assert sorted(got, key=str) == sorted(recount(rows, pair), key=str)
    assert A.score_links(A.align_documents(df.where("false")), len(pair.bytes_b)).count() == 0
