"""Language identification against a plain out-of-place classifier."""

import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import xxhash

from assetloom.common import load
from assetloom.llm import langid
from assetloom.llm.hashing import mix64


def grams(text):
    """Counts of the n-grams of a text; word edges are "\\0"."""
    kind = lambda ch: unicodedata.category(ch)[0]
    text = text.lower()
    if not any(kind(ch) == "L" for ch in text):
        return Counter()
    words = "".join(ch if kind(ch) in "LM" else "\0" for ch in text).split("\0")
    line = "\0" + "".join(w + "\0" for w in words if w)
    out = Counter(ch for ch in line if ch != "\0")
    out.update(line[k : k + 2] for k in range(len(line) - 1))
    out.update(line[k : k + 3] for k in range(len(line) - 2) if line[k + 1] != "\0")
    return out


def number(gram):
    """An n-gram as the operator's 64-bit key, which breaks ties."""
    code = 0
    for ch in gram:
        code = code << 21 | ord(ch)
    return (code | 1 << 63 if len(gram) == 2 else code) & (1 << 64) - 1


def classify(docs, profile_size, doc_grams):
    """{id: (lang, score)}; docs: (id, text, lang)."""
    counts = {}
    for i, t, lang in docs:
        if t and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(grams(t))
    signed = lambda g: struct.unpack("<q", struct.pack("<Q", g))[0]
    tie = lambda g: (signed(xxhash.xxh64_intdigest(struct.pack("<Q", number(g)), 42)), signed(number(g)))
    profiles = {lang: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], *tie(g)))[:profile_size])} for lang, c in counts.items()}
    out = {}
    for i, t, _ in docs:
        own = grams(t or "")
        top = sorted(own, key=lambda g: (-own[g], int(mix64(np.array([number(g)], np.uint64))[0])))[:doc_grams]
        if not top or not profiles:
            out[i] = ("und", 0.0)
            continue
        cost = {lang: sum(abs(p[g] - k) if g in p else profile_size for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        out[i] = (best, max(0.0, 1 - cost[best] / (len(top) * profile_size)))
    return out


def check(df, **sizes):
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(df, **sizes).collect()}
    want = classify(rows, sizes.get("profile_size", 400), sizes.get("doc_grams", 300))
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-12, i
    return got


def test_documents(spark, sf_dir):
    check(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def test_scripts_marks_and_no_letters(spark):
    texts = ["उपलब्ध है यह", "นี่คือ ข้อความ", "\U000f0001️ 123", "́̂ 12", "日本語 テキスト", "Ωμέγα alpha", "", None, "\U00031350\U00031351"]
    df = spark.createDataFrame([(k, t * 3 if t else t, "abc"[k % 3]) for k, t in enumerate(texts * 4)], "doc_id long, text string, lang string")
    got = check(df, profile_size=20, doc_grams=15)
    assert {got[k][0] for k in (2, 3, 6, 7)} == {"und"} and got[0][0] != "und" and got[8][0] != "und"


def test_many_labels(spark):
    """Every label is learnt, however many there are."""
    name = lambda k: "".join(chr(0x4E00 + (k * 7 + j) % 3000) for j in range(6))
    df = spark.createDataFrame([(1000 * j + k, name(k), f"l{k:03}") for k in range(320) for j in range(4)], "doc_id long, text string, lang string")
    answer = lambda **o: {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(df, **o).collect()}
    whole = answer()
    assert answer(block_labels=90) == whole  # four blocks, one after the other
    got = {i: lang for i, (lang, _) in whole.items()}
    assert sum(got[1000 * j + k] == f"l{k:03}" for k in range(320) for j in range(4)) >= 1270


def test_ties_between_blocks(spark):
    """Languages of equal profiles: the first by name, in whatever block."""
    df = spark.createDataFrame([(k, "one two three four", "dbca"[k % 4]) for k in range(40)] + [(99, None, None), (98, "12", "a")], "doc_id long, text string, lang string")
    seen = []
    for size in (1, 3, 4):
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(df, block_labels=size).collect()}
        assert len(got) == 42 and got[99] == got[98] == ("und", 0.0) and {got[k][0] for k in range(40)} == {"a"}
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]
