"""Language identification by rank-order profiles (operator 4).

A profile is the ``profile_size`` most frequent character n-grams of a language, in order. A document's own most
frequent n-grams are ranked likewise, and its distance to a language is the sum of how far each of them is out of
place, with the profile's length for those it lacks. The nearest language wins, the first by name on a tie; the score
is 1 minus the distance over the largest possible.

Profiles are learnt on a bounded sample: of each label about ``sample_docs`` rows, by a hash of the id. Every label gets
one. They are ``profile_size`` n-grams each and held ``block_labels`` at a time, in the order of their names. As a rule one
block holds all, and every whole text is judged beside its table, without a shuffle. Of more labels, the n-grams of each text
are written once, and every further block is a pass over those, which keeps the nearest label so far.

n-grams are of 1 to 3 letters of the lower-cased text; combining marks belong to words like letters, other characters
separate words, and word edges count as one letter. Defined cases: null texts and texts without a letter (Unicode
category L) get ``und`` and score 0, as does every text if no labelled row is left to learn from; null labels and null
ids are not learnt from; repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import discard, materialize
from assetloom.llm.hashing import mix64
from assetloom.operators.positions import with_position

UND = "und"
#: Code points looked at at once, and the most labels whose counts are broadcast.
PIECE, FEW_LABELS = 1 << 20, 100_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Of every code point: 2 for a letter, 1 for a combining mark, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of a text, their counts); none of a text without a letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = character_classes()[code]
    if not (kind == 2).any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.where(kind > 0, code, 0)
    keep = np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0))) if len(c) else np.empty(0, bool)
    c = np.concatenate(([0], c[keep], [0])).astype(np.uint64)
    parts = []
    for at in range(0, len(c), PIECE):
        own = c[at : at + PIECE + 2]
        first, grams = own[:PIECE], []
        k = len(first)
        grams.append(first[first != 0])
        a, b = own[:-1][:k], own[1:][:k]
        grams.append(((a << np.uint64(21)) | b)[(a != 0) | (b != 0)] | np.uint64(1 << 63))
        a, b, d = own[:-2][:k], own[1:-1][:k], own[2:][:k]
        grams.append(((a << np.uint64(42)) | (b << np.uint64(21)) | d)[b != 0])
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    every, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return every, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent grams in order; equal counts by a hash of the gram, which favours no alphabet."""
    if len(grams) > 4 * k:
        low = np.partition(counts, len(counts) - k)[len(counts) - k]
        grams, counts = grams[counts >= low], counts[counts >= low]
    return grams[np.lexsort((mix64(grams), -counts))[:k]]


def _count_sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            found = [gram_counts(t) for t in own["text"]]
            every, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in found]), len(every)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": every.view(np.int64), "n": n})


def learn_profiles(labelled: DataFrame, sample_docs: int, profile_size: int) -> DataFrame:
    """(lang, rank, gram): the n-grams of every language, the most frequent first. labelled: (id, text, lang), no nulls."""
    shares = labelled.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share"))
    shares = materialize(shares, "lang-shares")
    chosen = F.shiftrightunsigned(F.xxhash64("id"), 11) < F.least("share", F.lit(1.0)) * float(1 << 53)
    sample = labelled.join(F.broadcast(shares) if shares.count() <= FEW_LABELS else shares, "lang").where(chosen).select(F.lower("text").alias("text"), "lang")
    counts = sample.mapInPandas(_count_sample, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("gram"), "gram"))
    return materialize(counts.withColumn("rank", rank).where(F.col("rank") <= profile_size).select("lang", "rank", "gram"), "lang-profiles")


def profile_blocks(profiles: DataFrame, block_labels: int) -> Iterator[dict[str, list[int]]]:
    """language -> its n-grams, for ``block_labels`` languages at a time, in order of their names."""
    langs = profiles.where("rank = 1").select("lang")
    n = langs.count()
    if n > block_labels:
        profiles = profiles.join(with_position(langs, ["lang"], "at"), "lang")
    for first in range(0, max(n, 1), block_labels):
        own = profiles.where(F.col("at").between(first + 1, first + block_labels)) if n > block_labels else profiles
        out: dict[str, list[int]] = {}
        for r in own.select("lang", "rank", "gram").orderBy("lang", "rank").collect():
            out.setdefault(r["lang"], []).append(r["gram"])
        yield out


class Profiles:
    """The profiles as one list of (language, place) for each known n-gram."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        gram = np.array([g for lang in self.langs for g in profiles[lang]], np.int64).view(np.uint64)
        lang = np.repeat(np.arange(len(self.langs), dtype=np.int32), [len(profiles[x]) for x in self.langs])
        place = np.concatenate([np.arange(len(profiles[x]), dtype=np.int32) for x in self.langs]) if self.langs else np.empty(0, np.int32)
        order = np.argsort(gram, kind="stable")
        self.gram, self.lang, self.place = gram[order], lang[order], place[order]

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Of a document's n-grams in order to every language. An n-gram that the profile lacks costs its whole length."""
        low, high = np.searchsorted(self.gram, top, "left"), np.searchsorted(self.gram, top, "right")
        n = high - low
        at, rank = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(top)), n)
        saved = self.size - np.abs(self.place[at] - rank)
        return len(top) * self.size - np.bincount(self.lang[at], saved, len(self.langs)).astype(np.int64)


def _top(text: str | None, doc_grams: int) -> np.ndarray:
    grams, counts = gram_counts(text) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return most_frequent(grams, counts, doc_grams) if len(grams) else grams


def top_grams(text: Column, doc_grams: int) -> Column:
    """A text's most frequent n-grams in order, as longs."""

    @F.pandas_udf("array<long>")
    def tops(texts: pd.Series) -> pd.Series:
        return pd.Series([_top(t, doc_grams).view(np.int64) for t in texts])

    return tops(F.lower(text))


def nearest(c: Column, profiles_b, doc_grams: int, is_text: bool) -> Column:
    """struct(lang, cost, n): the nearest language of a text, or of its n-grams in order, its distance and the number of
    n-grams. No language where there are none."""

    @F.pandas_udf("struct<lang:string,cost:long,n:int>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(*profiles_b.value)
        for values in batches:
            out = []
            for x in values:
                top = _top(x, doc_grams) if is_text else np.asarray(x, np.int64).view(np.uint64)
                if not len(top) or not known.langs:
                    out.append((None, 0, len(top)))
                    continue
                cost = known.distances(top)
                best = int(cost.argmin())
                out.append((known.langs[best], int(cost[best]), len(top)))
            yield pd.DataFrame(out, columns=["lang", "cost", "n"])

    return judge(F.lower(c) if is_text else c)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2000, profile_size: int = 400, doc_grams: int = 300, folds: int = 5, fold: int = 0, block_labels: int = 1000) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score. Learns from rows with a label that aren't held out."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out = held_out(F.col("id"), folds, fold)
    profiles = learn_profiles(d.where(~out & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample_docs, profile_size)
    blocks = profile_blocks(profiles, block_labels)
    first, second = sc.broadcast((next(blocks), profile_size)), next(blocks, None)
    if second is None:
        judged = d.select("id", out.alias("held_out"), nearest(F.col("text"), first, doc_grams, True).alias("j"))
    else:
        tops = materialize(d.select("id", out.alias("held_out"), top_grams(F.col("text"), doc_grams).alias("top")), "lang-tops")
        judged = materialize(tops.withColumn("j", nearest(F.col("top"), first, doc_grams, False)), "lang-judged")
        for block in chain([second], blocks):
            other = nearest(F.col("top"), sc.broadcast((block, profile_size)), doc_grams, False)
            # On a tie the label of the earlier block stays, as names ascend.
            closer = F.when(F.col("other.cost") < F.col("j.cost"), F.col("other")).otherwise(F.col("j"))
            last, judged = judged, materialize(judged.withColumn("other", other).select("id", "held_out", "top", closer.alias("j")), "lang-judged")
            discard(last)
    share = F.greatest(F.lit(0.0), 1 - F.col("j.cost") / (F.col("j.n") * F.lit(profile_size)))
    score = F.when(F.col("j.lang").isNull(), 0.0).otherwise(share)
    return judged.select(F.col("id").alias(id_col), "held_out", F.coalesce("j.lang", F.lit(UND)).alias("lang_pred"), score.alias("score"))
