"""Benchmark decontamination by spaced seeds (operator 2).

A seed is a mask over ``span`` consecutive tokens that looks at some positions and ignores the others, so a replaced
token spoils only the seeds that look at it. The masks of an item are chosen by its length so that every alignment the
rules below accept holds a seed without a replaced token: none is missed. Seeds of all benchmark items are hashed once;
every document's seeds are joined with them by hash inside the task that holds its text. Each hit fixes an alignment of
item and document, along which the tokens are compared one by one, all alignments of a document together. A document
holds an item if at least ``min_share`` of the item's tokens agree along an alignment, or if some window of ``window``
aligned tokens agrees to ``window_share``. The second rule catches parts of items; short runs of common words meet neither.

The benchmark is a stated query set. It is read in blocks of at most ``block_tokens`` tokens: the driver builds the index
of one block and broadcasts it. Of several blocks each pass is run before the next begins, so that one block is all
that is held at once; a pass writes what it has found, and no texts. A block's index takes 16 bytes for each token and mask.

Tokens are runs of letters, marks and digits (Unicode) of the lower-cased text. Defined cases: null and empty texts hold
nothing; items of fewer than ``min_tokens`` tokens are skipped, or with ``short_items`` held by texts that hold all their
tokens in a row; items with a null id are skipped, other item ids are whole numbers; repeated documents and items are
each reported; empty tables give empty results; document ids may be null and of any type; other columns pass through
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import without_keys
from assetloom.llm.hashing import mix64, utf8, word_hashes
from assetloom.llm.rows import field, integer_id, packed, unpacked

#: Families of masks, (weight, span): all masks that look at ``weight`` of ``span`` tokens in a row. Best first.
FAMILIES = ((6, 6), (5, 5), (4, 4), (4, 5), (4, 6), (3, 3), (3, 4), (3, 5), (2, 2), (2, 3), (2, 4), (1, 1))
CELLS = 1 << 22
#: Tokens compared at once.
COMPARED = 1 << 20
HIT = "array<struct<item_id:long,start:int,matched:int,tokens:int,similarity:double>>"


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's seed at every position where it fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(len(mask) * 64 + mask[-1]), np.uint64)
        for k in mask:
            total = (total + tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
    return mix64(total)


def masks_for(n: int, min_share: float = 0.7, window: int = 20, window_share: float = 0.8) -> list[tuple[int, ...]]:
    """The masks for an item of n tokens: of the first family that has a seed in each accepted alignment. Tokens in a row
    without a seed of (weight, span) agree at weight - 1 places of each ``span`` at most; that must not be enough."""
    asked = [(n, math.ceil(min_share * n)), *([(window, math.ceil(window_share * window))] if n > window else [])]
    for weight, span in FAMILIES:
        if span <= n and all((weight - 1) * (k // span) + min(k % span, weight - 1) < need for k, need in asked):
            return [(0, *m) for m in combinations(range(1, span), weight - 1)]
    return [(0,)]


def token_text(text: Column) -> Column:
    """The lower-cased text with blanks for characters beyond ASCII that are no letter, mark or digit; the word hashes
    separate at the others themselves."""
    lower = F.lower(text)
    return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.regexp_replace(lower, r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " "))


class SeedIndex:
    """Sorted seed hashes of one block of items, with a bitmap of fixed size before them."""

    def __init__(self, ids: list, texts: list, min_tokens: int, min_share: float, window: int, window_share: float, short_items: bool):
        words, at = word_hashes(utf8(texts), alnum=True)
        keep = [k for k in range(len(ids)) if at[k + 1] - at[k] >= (1 if short_items else min_tokens) and ids[k] is not None]
        items = [words[at[k] : at[k + 1]] for k in keep]
        self.window, self.window_need = window, window_share * window
        self.ids, self.size = np.array([ids[k] for k in keep], np.int64), np.array([len(t) for t in items], np.int64)
        self.flat = np.concatenate(items) if items else np.empty(0, np.uint64)
        self.first = np.cumsum(self.size) - self.size
        # Short items must agree whole.
        self.share = np.where(self.size >= min_tokens, min_share, 1.0)
        masks = [masks_for(n, share, window, window_share) for n, share in zip(self.size.tolist(), self.share.tolist())]
        self.masks = sorted({m for own in masks for m in own})
        self.by_mask = []
        for m in self.masks:
            own = [(seeds(t, m), k) for k, t in enumerate(items) if m in masks[k]]
            h = np.concatenate([x for x, _ in own])
            item = np.concatenate([np.full(len(x), k, np.int32) for x, k in own])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in own])
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(CELLS, bool)
            bitmap[h & np.uint64(CELLS - 1)] = True
            self.by_mask.append((h[order], item[order], place[order], np.packbits(bitmap)))

    @classmethod
    def restored(cls, state: dict) -> SeedIndex:
        """From the plain arrays that a broadcast carries."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def alignments(self, tokens: np.ndarray, bitmaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(items, document positions of their first tokens) of all seed hits, each alignment once."""
        found = []
        for m, (h, item, place, _), bitmap in zip(self.masks, self.by_mask, bitmaps):
            own = seeds(tokens, m)
            near = np.flatnonzero(bitmap[own & np.uint64(CELLS - 1)])
            low, high = np.searchsorted(h, own[near], "left"), np.searchsorted(h, own[near], "right")
            n = high - low
            if n.any():
                k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.unique((item[k].astype(np.int64) << 32) | (np.repeat(near, n) - place[k] + (1 << 31))))
        every = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return every >> 32, (every & 0xFFFFFFFF) - (1 << 31)

    def compare(self, tokens: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matched tokens, whether that is enough) along each alignment."""
        n = self.size[item]
        row = np.repeat(np.arange(len(item)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = start[row] + within
        same = (at >= 0) & (at < len(tokens))
        same[same] = tokens[at[same]] == self.flat[self.first[item[row[same]]] + within[same]]
        run = np.concatenate(([0], np.cumsum(same)))
        end = np.cumsum(n)
        matched = run[end] - run[end - n]
        enough = matched >= self.share[item] * n
        wide = np.flatnonzero((within + self.window <= n[row]) & (n[row] > self.window))
        enough[row[wide[run[wide + self.window] - run[wide] >= self.window_need]]] = True
        return matched, enough

    def held_by(self, tokens: np.ndarray, bitmaps: list[np.ndarray]) -> list[dict]:
        """The items that a text holds, each along its best alignment: most tokens, then first."""
        item, start = self.alignments(tokens, bitmaps)
        best: dict[int, tuple[int, int]] = {}
        cuts = np.searchsorted(np.cumsum(self.size[item]), np.arange(0, int(self.size[item].sum()) + 1, COMPARED))
        for a, b in zip(cuts, [*cuts[1:], len(item)]):
            matched, enough = self.compare(tokens, item[a:b], start[a:b])
            for k, m, s in zip(item[a:b][enough].tolist(), matched[enough].tolist(), start[a:b][enough].tolist()):
                best[k] = max(best.get(k, (0, 0)), (m, -s))
        return [{"item_id": int(self.ids[k]), "start": -s, "matched": m, "tokens": int(self.size[k]), "similarity": m / int(self.size[k])} for k, (m, s) in sorted(best.items())]


def hits_column(text: Column, block_b) -> Column:
    """All items of one block that a text holds; the best alignment of each."""

    @F.pandas_udf(HIT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = SeedIndex.restored(block_b.value)
        bitmaps = [np.unpackbits(x[3]).astype(bool) for x in index.by_mask]
        for texts in batches:
            words, at = word_hashes(utf8(texts), alnum=True)
            yield pd.Series([index.held_by(words[a:b], bitmaps) for a, b in zip(at, at[1:])])

    return find(token_text(text))


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_tokens: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, block by block; they come to the driver a partition at a time."""
    ids, texts, size = [], [], 0
    for row in bench.select(integer_id(bench, item_col), token_text(F.col(text_col))).toLocalIterator():
        n = len(row[1].split()) if row[1] else 0
        if ids and size + n > block_tokens:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield ids, texts


def _passes(bench: DataFrame, item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = 8, min_share: float = 0.7, window: int = 20, window_share: float = 0.8, block_tokens: int = 250_000, short_items: bool = False) -> Iterator[tuple[object, bool]]:
    """(broadcast index, whether it is the only one) of every block that has items."""
    sc, before, several = bench.sparkSession.sparkContext, None, False
    for ids, texts in _blocks(bench, item_col, item_text_col, block_tokens):
        index = SeedIndex(ids, texts, min_tokens, min_share, window, window_share, short_items)
        if not len(index.ids):
            continue
        if before is not None:
            several = True
            yield sc.broadcast(before), False
        before = vars(index)
    if before is not None:
        yield sc.broadcast(before), not several


def contaminated_pairs(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, start, matched, tokens, similarity): one row per document and item it holds. options: of the items
    (item_col, item_text_col), the rules and the blocks, as in the signature of ``_passes``."""
    parts = []
    for block, only in _passes(bench, **options):
        pairs = docs.select(F.col(id_col), F.explode(hits_column(F.col(text_col), block)).alias("h")).select(id_col, "h.*")
        parts.append(pairs if only else materialize(pairs, "leaks"))
        if not only:
            block.unpersist()
    nothing = docs.where("false").select(F.col(id_col), F.explode(F.array().cast(HIT)).alias("h")).select(id_col, "h.*")
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged. Whether one goes depends on its text alone: of several
    blocks each pass writes only hashes of the texts that hold an item, and the rows that may have one are looked up at last."""
    gone = []
    for block, only in _passes(bench, **options):
        hits = hits_column(field(text_col), block)
        if only:
            return unpacked(packed(docs).withColumn("hits", hits).where(F.size("hits") == 0))
        found = packed(docs).withColumn("hits", hits).where(F.size("hits") > 0).select(_text_key(field(text_col)).alias("key"))
        gone.append(materialize(found.distinct(), "leaks"))
        block.unpersist()
    if not gone:
        return docs
    return unpacked(without_keys(packed(docs, key=_text_key(F.col(text_col))), "key", reduce(DataFrame.unionByName, gone)))


def _text_key(text: Column) -> Column:
    """128 bits of a text; null for null."""
    return F.when(text.isNotNull(), F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit(1), text)))
