"""Substring dedup by content-defined chunking (operator 3).

A gear hash rolls over the bytes of a text; a chunk ends where the hash of the last 16 bytes falls under a threshold,
so boundaries depend on nearby content only and an insertion moves them no further than its own chunk. Chunks have ``min_bytes`` at least and
``max_bytes`` at most. Chunks of all documents are grouped by a digest of 128 bits. A chunk whose digest
occurs in several documents repeats; runs of neighbouring repeated chunks with ``min_words`` words or more are reported
as spans, one for each keeper in a row. A chunk's keeper is the smallest id that holds it. A span is to be cut if its
keeper is another document and it lies in a stretch of ``min_words`` words or more that others keep. The keeper's own
chunks are never cut, so every chunk of the corpus stays in at least one document.

A passage loses up to one chunk at each end to boundaries outside of it. With the defaults (chunks of about 32 bytes,
five words) ``min_words`` = 24 finds nearly every passage of over 50 words, and is twice the longest boilerplate line.

Defined cases: null and empty texts have no chunks; repeats inside one document only don't count, as they are no
duplicates between documents (and a text that repeats a word would lose itself); ids are whole numbers, others an
error; rows with one id count as one document, whose texts are told apart by their hash and have spans of their own;
repeated rows have the spans of one; rows with a null id are left out; an empty table gives an empty result; other
columns pass through ``drop_spans``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import split_possible
from assetloom.llm.distinct import distinct_rows
from assetloom.llm.hashing import _table, utf8
from assetloom.llm.rows import field, integer_id, packed, unpacked

#: One 16-bit value for each byte.
GEAR = (_table(256, 77) >> np.uint64(48)).astype(np.uint16)
#: Bytes hashed at once; the hash needs 15 bytes before a piece, so pieces give the same boundaries as whole texts.
PIECE = 4 << 20
#: How many digests count as common at most.
MOST_COMMON = 10_000


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[b] << age over the last 16 bytes, by doubling the window four times."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        older = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += older
    return h


def boundaries(text: bytes, min_bytes: int, avg_bytes: int, max_bytes: int) -> list[int]:
    """Ends of the chunks of a text, in order; the last one is its length. None is inside a character, for which a chunk
    may have up to three bytes more."""
    limit = np.uint16(65536 // max(1, avg_bytes - min_bytes))
    ends: list[int] = []
    last, n = 0, len(text)

    def least(last: int) -> int:
        """Without a cut in reach: the first place of the smallest hash there. It also follows from content, so that
        texts that repeat a short period are cut alike."""
        first = last + min_bytes - 1
        raw = np.frombuffer(text, np.uint8)[max(0, first - 15) : last + max_bytes]
        return first + 1 + int(np.argmin(gear_hash(raw)[min(15, first) :]))

    for at in range(0, n, PIECE):
        start = max(0, at - 15)
        raw = np.frombuffer(text, np.uint8, min(n, at + PIECE) - start, start)
        cuts = np.flatnonzero(gear_hash(raw)[at - start :] < limit) + at + 1
        for c in cuts.tolist():
            while c - last > max_bytes:
                last = least(last)
                ends.append(last)
            if c - last >= min_bytes:
                last = c
                ends.append(c)
    while n - last > max_bytes:
        last = least(last)
        ends.append(last)
    if n > last:
        ends.append(n)
    # Two ends in the last character become one.
    return ends if text.isascii() else list(dict.fromkeys(_character_end(text, e) for e in ends))


def _character_end(text: bytes, end: int) -> int:
    """``end``, or the end of the character that it lies in."""
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end += 1
    return end


def _chunks(min_bytes: int, avg_bytes: int, max_bytes: int):
    digest = xxhash.xxh3_128_digest

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, digests = [], []

            def flush() -> pd.DataFrame:
                out = pd.DataFrame({c: np.concatenate([r[k] for r in rows]) for k, c in enumerate(("id", "th", "start", "n_bytes", "n_words"))})
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rows.clear()
                digests.clear()
                return out.assign(d1=both[:, 0], d2=both[:, 1])

            for doc, th, text in zip(pdf["id"], pdf["th"], utf8(pdf["text"])):
                if not text:
                    continue
                ends = boundaries(text, min_bytes, avg_bytes, max_bytes)
                starts = [0, *ends[:-1]]
                digests += [digest(text[a:b]) for a, b in zip(starts, ends)]
                raw = np.frombuffer(text, np.uint8)
                gap = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
                first = ~gap
                first[1:] &= gap[:-1]
                sizes, words = np.diff(ends, prepend=0).astype(np.int32), np.add.reduceat(first, starts, dtype=np.int32)
                rows.append((np.full(len(ends), doc, np.int64), np.full(len(ends), th, np.int64), np.array(starts, np.int32), sizes, words))
                if len(digests) > 200_000:
                    yield flush()
            if rows:
                yield flush()

    return of


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 12, avg_bytes: int = 32, max_bytes: int = 128) -> DataFrame:
    """(id, th, start, n_bytes, n_words, d1, d2): every chunk of every distinct id and text; th is the hash of the text."""
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(integer_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    texts = distinct_rows(rows, "id").select("id", F.xxhash64("text").alias("th"), "text")
    return texts.mapInPandas(_chunks(min_bytes, avg_bytes, max_bytes), "id long, th long, start int, n_bytes int, n_words int, d1 long, d2 long")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(id, th, start, n_bytes, n_words, keeper) of the chunks that several documents hold."""
    digest = ["d1", "d2"]
    counts = chunks.groupBy(*digest).agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"))
    seen = materialize(counts.where("keeper < last").select(*digest, "keeper", "copies"), "chunks-seen")
    # A digest may stand for a third of all chunks. Digests above a 10,000th of them are 10,000 at most, so they are
    # broadcast and their chunks stay where they are; the others are joined by shuffle.
    is_common = F.col("copies") * MOST_COMMON > chunks.count()
    common = F.broadcast(seen.where(is_common).select(*digest, "keeper"))
    rare = seen.where(~is_common).select(*digest, "keeper")
    return chunks.join(common, digest).unionByName(chunks.join(common.drop("keeper"), digest, "left_anti").join(rare, digest)).drop(*digest)


def spans_of(again: DataFrame, min_words: int) -> DataFrame:
    """(id, th, start, n_bytes, n_words, n_chunks, keeper, cut) from the repeated chunks. Windows hold one text each."""
    order, end = W.partitionBy("id", "th").orderBy("start"), F.col("start") + F.col("n_bytes")
    again = again.withColumn("theirs", F.col("keeper") < F.col("id"))
    again = again.withColumn("gap", F.coalesce(F.lag(end).over(order) != F.col("start"), F.lit(True)))
    turn = F.col("gap") | (F.lag("theirs").over(order) != F.col("theirs"))
    other = F.col("gap") | (F.lag("keeper").over(order) != F.col("keeper"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    marked = again.withColumns({"turn": turn, "other": other})
    number = lambda c: F.count_if(c).over(upto)
    numbered = marked.withColumns({"run": number(F.col("gap")), "stretch": number(F.col("turn")), "piece": number(F.col("other"))})
    sums = [F.min("start").alias("start"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_chunks")]
    pieces = numbered.groupBy("id", "th", "run", "stretch", "piece", "keeper", "theirs").agg(*sums)
    words = lambda part: F.sum("n_words").over(W.partitionBy("id", "th", part))
    spans = pieces.withColumns({"run_words": words("run"), "cut": F.col("theirs") & (words("stretch") >= min_words)})
    return spans.where(F.col("run_words") >= min_words).select("id", "th", "start", "n_bytes", "n_words", "n_chunks", "keeper", "cut")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, **chunking: int) -> DataFrame:
    """(id, th, start, n_bytes, n_words, n_chunks, keeper, cut): byte spans of the text with the hash th that also occur in
    other documents. ``keeper`` is the smallest id that holds them; ``cut`` says whether ``drop_spans`` removes them."""
    chunks = materialize(chunk_table(docs, id_col, text_col, **chunking), "chunks")
    return spans_of(repeated_chunks(chunks), min_words).withColumnRenamed("id", id_col)


def drop_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans that are to be cut removed from their texts, other columns unchanged."""

    @F.pandas_udf("string")
    def without(text: pd.Series, holes: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, holes):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            raw, kept, at = t.encode("utf-8", "surrogatepass"), [], 0
            for h in sorted(own, key=lambda h: h["start"]):
                kept.append(raw[at : h["start"]])
                at = max(at, h["start"] + h["n_bytes"])
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    holes = spans.where("cut").groupBy(F.col(id_col).alias("id"), "th").agg(F.collect_list(F.struct("start", "n_bytes")).alias("holes"))
    holes = materialize(holes.withColumn("key", F.xxhash64("id", "th")), "holes")
    rows = packed(docs, id=integer_id(docs, id_col), th=F.xxhash64(text_col))
    # Only rows that may have holes are moved.
    asked, stay = split_possible(rows.withColumn("key", F.xxhash64("id", "th")), "key", holes)
    asked = asked.join(holes.drop("key"), ["id", "th"], "left")
    asked = asked.withColumn("row", F.col("row").withField(f"`{text_col}`", without(field(text_col), F.col("holes"))))
    return unpacked(stay).unionByName(unpacked(asked))
