"""Alignment of two tokenizers over the same texts (operator 12).

A text is encoded by a byte-level BPE (A, of the text behind one blank) and a piece model (B, which puts the blank itself).
Byte offsets at which tokens of both end cut the text into groups. They are found by divide and conquer: of an interval
of tokens between two shared ends, a common end near the middle is located by bisecting B's ends for A's, and the halves
are searched the same way; an interval without a common end inside is a group. All intervals of one depth, over all
texts of a chunk, are bisected together as arrays. Those in which the first probes beside the middle miss are searched whole.

Two tokens that end together are linked. Counts of linked id pairs over the corpus come from pairs that were counted inside
each text first. Scoring a text needs the counts of its pairs: the most frequent pairs, up to ``broadcast_pairs`` of them, are
broadcast, and rarer ones, if there are more, are joined by shuffle, so that no key of that join is hot.

Vocabulary files are read in the tasks, from a path that every executor has. Defined cases: texts that are null or empty,
or that either tokenizer does not give back byte for byte behind the blank, have no tokens; special tokens' strings are plain
text; repeated rows count and are returned each; an empty table gives an empty result; ids may be null and of any type; other
columns are not read, whatever their names."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts that are encoded at once; places beside the middle that are probed for all intervals at once.
CHUNK, PROBES = 1 << 20, 8
ALIGNED = "struct<n_a:long,n_b:long,n_groups:long,groups:string,pairs:array<long>,times:array<int>>"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes that print as themselves, the others as characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranked_encoding(a_file: str):
    """An encoder of the same vocabulary that takes ids for ranks and needs a quarter of the time; None where the file's
    ids don't follow its merges, or where it splits texts in another way."""
    import tiktoken

    with open(a_file, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    usual = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not usual or model.get("ignore_merges") or any(model["vocab"].get(t) != 256 + k for k, t in enumerate(made)):
        return None
    known = byte_of_char()
    ranks = {bytes(known[c] for c in t): k for t, k in model["vocab"].items() if k < 256 + len(made)}
    return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Both tokenizers, the bytes of each id, and the decimal ids with what may follow them in the groups' notation."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        self.quick = ranked_encoding(a_file)
        known, n_a = byte_of_char(), self.a.get_vocab_size()
        tokens = [self.a.id_to_token(k) or "" for k in range(n_a)]
        self.bytes_a = [bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in tokens]
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.noted = np.array([f"{k}{end}" for k in range(max(n_a, len(self.bytes_b))) for end in ",|;"], object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for texts that are not given back."""
        plain = [self.quick is None or len(t) > CHUNK for t in texts]
        slow = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain) if p], add_special_tokens=False))
        a = [next(slow).ids if p else self.quick.encode_ordinary(" " + t) for t, p in zip(texts, plain)]
        b = self.b.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            given = (" " + t).encode()
            if not t or b"".join([self.bytes_a[x] for x in a[k]]) != given or b"".join([self.bytes_b[x] for x in b[k]]) != given:
                a[k] = b[k] = []
        return a, b


@lru_cache(maxsize=2)
def tokenizer_pair(a_file: str, b_file: str) -> Pair:
    """Loaded once in a worker."""
    return Pair(a_file, b_file)


def vocabulary_size(b_file: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_file).get_piece_size()


def shared_ends(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all tokens with a[i] == b[j], in order. a, b: ascending ends of the tokens of several texts behind each other;
    first and last: the tokens of each text, whose last ones end together."""
    found_i, found_j = [last_a], [last_b]
    while len(first_a):
        # An interval with one token on a side has no end inside.
        wide = (last_a > first_a) & (last_b > first_b)
        first_a, last_a, first_b, last_b = first_a[wide], last_a[wide], first_b[wide], last_b[wide]
        middle, cut = (first_a + last_a - 1) // 2, np.full(len(first_a), -1)
        open_ = np.arange(len(cut))
        for k in range(PROBES):
            i = middle[open_] + ((k + 1) // 2) * (-1 if k % 2 else 1)
            inside = (i >= first_a[open_]) & (i < last_a[open_])
            at, i = open_[inside], i[inside]
            hit = b[np.searchsorted(b, a[i])] == a[i]
            cut[at[hit]] = i[hit]
            open_ = open_[(cut[open_] < 0) & (last_a[open_] - first_a[open_] > k)]
            if not len(open_):
                break
        for k in open_.tolist():
            i = np.arange(first_a[k], last_a[k])
            i = i[b[np.searchsorted(b, a[i])] == a[i]]
            if len(i):
                cut[k] = i[np.abs(i - middle[k]).argmin()]
        halved = cut >= 0
        i = cut[halved]
        j = np.searchsorted(b, a[i])
        found_i.append(i)
        found_j.append(j)
        # In the order of the texts: neighbouring searches then touch the same memory.
        pairs = lambda left, right: np.stack([left, right], axis=1).ravel()
        first_a, last_a = pairs(first_a[halved], i + 1), pairs(i, last_a[halved])
        first_b, last_b = pairs(first_b[halved], j + 1), pairs(j, last_b[halved])
    return np.sort(np.concatenate(found_i)), np.sort(np.concatenate(found_j))


def notation(ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray, noted: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``; i, j: the last tokens of each group."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    end_a[i], end_b[j] = 1, 2
    group_a = np.searchsorted(i, np.arange(len(ids_a)))
    group_b = np.searchsorted(j, np.arange(len(ids_b)))
    out[np.arange(len(ids_a)) + np.concatenate([[0], j + 1])[group_a]] = noted[ids_a * 3 + end_a]
    out[np.arange(len(ids_b)) + (i + 1)[group_b]] = noted[ids_b * 3 + end_b]
    return "".join(out.tolist())[:-1]


def align_chunk(texts: list[str], pair: Pair) -> list[tuple]:
    """One row of ALIGNED for each text; a pair is A's id * the size of B's vocabulary + B's id."""
    lists_a, lists_b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (lists_a, lists_b))
    ids_a, ids_b = (np.array([x for own in t for x in own], np.int64) for t in (lists_a, lists_b))
    # Ends count on from text to text, so they ascend over the chunk.
    ends_a, ends_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    some = n_a > 0
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    i, j = shared_ends(ends_a, ends_b, (stop_a - n_a)[some], stop_a[some] - 1, (stop_b - n_b)[some], stop_b[some] - 1)
    linked = ids_a[i] * len(pair.bytes_b) + ids_b[j]
    out = []
    for k in range(len(texts)):
        if not some[k]:
            out.append((0, 0, 0, "", [], []))
            continue
        a0, b0 = stop_a[k] - n_a[k], stop_b[k] - n_b[k]
        x, y = np.searchsorted(i, [a0, stop_a[k]])
        pairs, times = np.unique(linked[x:y], return_counts=True)
        groups = notation(ids_a[a0 : stop_a[k]], ids_b[b0 : stop_b[k]], i[x:y] - a0, j[x:y] - b0, pair.noted)
        out.append((int(n_a[k]), int(n_b[k]), int(y - x), groups, pairs, times.astype(np.int32)))
    return out


def aligned_column(text: Column, a_file: str = A_FILE, b_file: str = B_FILE) -> Column:
    """ALIGNED of each text. A text's links are its groups, so ``times`` adds up to n_groups."""

    @F.pandas_udf(ALIGNED)
    def align(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pair, names = tokenizer_pair(a_file, b_file), ["n_a", "n_b", "n_groups", "groups", "pairs", "times"]
        for texts in batches:
            held, size = [], 0
            for t in texts.tolist():
                held.append(t or "")
                size += len(held[-1])
                if size >= CHUNK:
                    yield pd.DataFrame(align_chunk(held, pair), columns=names)
                    held, size = [], 0
            yield pd.DataFrame(align_chunk(held, pair), columns=names)

    return align(text)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, total, best) over (pairs, times): how many links hold each pair, and whether no pair of its B id is in more.
    Texts' own counts are added up before the shuffle; B's ids are bounded by its vocabulary."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    total = materialize(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total")), "pair-totals")
    b_id = (F.col("pair") % b_size).alias("b_id")
    highest = total.groupBy(b_id).agg(F.max("total").alias("highest"))
    return total.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame, bound: int) -> int | None:
    """The least total from which at most ``bound`` pairs are as frequent, a power of two; None if all pairs are few enough."""
    left, steps = bound, counts.groupBy(F.length(F.bin("total")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()
    for bits, n in steps:
        left -= n
        if left < 0:
            return 1 << bits
    return None


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, pairs, times) of every row."""
    return docs.select(F.col(id_col), aligned_column(F.col(text_col), a_file, b_file).alias("x")).select(id_col, "x.*")


def score_links(aligned: DataFrame, b_size: int, broadcast_pairs: int = 500_000) -> DataFrame:
    """``aligned`` (pairs, times, other columns) with n_links, n_best (links whose pair no pair of its B id outnumbers in the
    corpus) and count_sum (of the links' corpus counts) in place of the pairs."""
    rows = materialize(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows, b_size), "pair-counts")
    each = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    least = _frequent(counts, broadcast_pairs)
    if least is None:
        found = each.join(F.broadcast(counts), "pair")
    else:
        marked = each.join(F.broadcast(counts.where(F.col("total") >= least)), "pair", "left")
        rare = marked.where("total IS NULL").select("__row", "pair", "n").join(counts.where(F.col("total") < least), "pair")
        found = marked.where("total IS NOT NULL").unionByName(rare)
    sums = found.groupBy("__row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "__row", "left").drop("__row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")})
