"""Substring dedup against a plain restatement; no passage loses its last copy."""

import random

import pytest
from pyspark.sql import functions as F

import brute as B
from assetloom.common import load
from assetloom.llm import chunk_dedup


def phrase(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def check(spark, rows, min_words=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.th: r.text for r in docs.select("text", F.xxhash64("text").alias("th")).collect()}
    spans = chunk_dedup.repeated_spans(docs, min_words=min_words)
    got = {(r.doc_id, hashes[r.th], r.start, r.n_bytes, r.keeper, r.cut) for r in spans.collect()}
    assert got == B.spans(rows, chunk_dedup.GEAR, min_words)
    left = [(r.doc_id, r.text) for r in chunk_dedup.drop_spans(docs, spans).collect()]
    assert len(left) == len(rows)
    known = b"\0".join(t.encode() for _, t in left if t)
    for _, t in rows:
        for a, b in B.chunks(t or "", chunk_dedup.GEAR):
            assert t.encode()[a:b] in known
    return left


def test_runs_of_several_keepers(spark):
    rnd = random.Random(1)
    p, q = phrase(rnd, 60), phrase(rnd, 60)
    left = dict(check(spark, [(1, p), (2, p + " " + q), (3, q), (4, p + " " + q)]))
    assert left[1] == p and q[60:-60] in left[2] and p[60:-60] not in left[2] and len(left[3]) < 120 and len(left[4]) < 120


@pytest.mark.parametrize("seed", range(4))
def test_every_chunk_survives(spark, seed):
    rnd = random.Random(seed)
    parts = [phrase(rnd, rnd.randint(5, 50)) for _ in range(8)] + ["äöü " * 20]
    rows = [(rnd.randrange(12), " ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))) for _ in range(25)]
    check(spark, [*rows, rows[0], (None, parts[0]), (3, None), (4, "")], min_words=rnd.choice([3, 24]))


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(spark, rows)


def test_chunks_of_wide_characters():
    """Chunks are as the restatement has them and none is empty, wherever a cut falls in the last character."""
    rnd = random.Random(2)
    for n in range(1, 400):
        text = "".join(rnd.choice("abcé日𝒳 ") for _ in range(n % 97)) + "𝒳"
        ends = chunk_dedup.boundaries(text.encode(), 12, 32, 128)
        assert list(zip([0, *ends], ends)) == B.chunks(text, chunk_dedup.GEAR) and all(a < b for a, b in zip([0, *ends], ends))
        for a, b in zip([0, *ends], ends):
            text.encode()[a:b].decode()
