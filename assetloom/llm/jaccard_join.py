"""N-gram Jaccard join by signature trees (operator 9): which documents share at least ``percent`` of their shingles.

1. Each text becomes its set of hashed shingles. Equal sets are one class, represented by its smallest id.
2. Two sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1 of each, in any order that is
   the same for all sets. Shingles of rare words come first in that order, and common shingles last (both estimated on a
   sample of documents; it only affects speed). Representatives with a common shingle there meet in the group of the
   smallest of them, the pivot. Common are shingles that three sampled documents hold; the sample is a 4,096th of the
   corpus at least, so a shingle that over some ten thousand documents hold brings together only documents of which
   nearly every shingle is common.
3. Members without another of like size in their group leave it. The others first meet by their signatures only, dealt
   into blocks of bounded size, the pivot into each. A signature tree holds a bitmap and the size of each set in its leaves, and above them the OR of their bitmaps, their
   size range and their largest count of colliding shingles. The tree is traversed against itself; a pair of nodes is
   dropped when sizes are too far apart or when the bits in common allow too little overlap. In groups of several blocks,
   members that matched none in their own are traversed against the other blocks. A member that no other could match
   leaves the group.
4. The rest are dealt into blocks anew, bounded by documents and by shingles, with their whole texts. The same traversal,
   which also drops pairs of nodes that are linked already, ends in exact comparisons of whole sets.
5. A document linked to the pivot needs no further look: blocks share the pivot. Documents that are not, in groups of
   several blocks, are traversed against every block of their group.
6. Components of all links, by Spark.

Defined cases: null or blank texts have no shingles and form a component of their own; a null id gets a null component
and links nothing; other ids are whole numbers; rows with one id are one document: their texts have sets of their own,
and all are in one component; repeated texts are one class; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import possible_rows, without_keys
from assetloom.llm.distinct import distinct_rows
from assetloom.llm.hashing import shingle_hashes, utf8, word_hashes
from assetloom.llm.rows import integer_id, packed, sample_of, unpacked
from assetloom.operators.components import connected_components

#: Cells of the tables that order shingles: of words, and of common shingles at least and at most (32 MB of bits).
CELLS = 1 << 16
HOT_CELLS = (1 << 22, 1 << 28)
#: Common shingles' cells are sent to the driver by stretches of two to the power of this.
STRETCH = 16
#: The least share of documents that is sampled for the order.
LEAST_SHARE = 1 / 4096
#: Bits of a signature; sets above WIDE_FROM shingles have a second one.
BITS, WIDE_BITS, WIDE_FROM = 2048, 8192, 3000
#: Sets in a leaf of the tree, children of a node above.
LEAF, FAN = 32, 4


def _sample_counts(size: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Word counts by cell (kind 0), and each document's shingles (kind 1)."""
        for pdf in batches:
            w, at = word_hashes(utf8(pdf["text"]))
            words = np.bincount((w & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            used = np.flatnonzero(words)
            yield pd.DataFrame({"kind": 0, "cell": used, "n": words[used]})
            for a, b in zip(at, at[1:]):
                yield pd.DataFrame({"kind": 1, "cell": np.unique(shingle_hashes(w[a:b], size)).view(np.int64), "n": 1})

    return of


def _packed_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells of each stretch as bits, the lowest first in each byte."""
    for pdf in batches:
        out = []
        for own in pdf["cells"]:
            flags = np.zeros(1 << STRETCH, np.uint8)
            flags[own] = 1
            out.append(np.packbits(flags, bitorder="little").tobytes())
        yield pd.DataFrame({"at": pdf["at"], "bits": out})


def shingle_order(texts: DataFrame, size: int, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a word by cell, bits of the common shingles by cell) from about ``sample_docs`` documents, or a 4,096th
    of all if that is more. A shingle is common if three of them hold it."""
    share = max(sample_docs / max(1, texts.count()), LEAST_SHARE)
    counts = texts.where(sample_of(F.col("id"), share)).select("text").mapInPandas(_sample_counts(size), "kind int, cell long, n long")
    counts = materialize(counts.groupBy("kind", "cell").agg(F.sum("n").alias("n")).where("kind = 0 or n >= 3"), "jac-order")
    words, own = np.zeros(CELLS), counts.where("kind = 0").toPandas()
    words[own["cell"].to_numpy()] = own["n"].to_numpy()
    hot = counts.where("kind = 1")
    cells = min(HOT_CELLS[1], max(HOT_CELLS[0], 1 << (64 * hot.count()).bit_length()))
    cell = F.col("cell").bitwiseAND(F.lit(cells - 1))
    # A row of packed bits for every stretch of cells: 4,096 rows of 8 kB at most reach the driver.
    stretch, inside = F.shiftright(cell, STRETCH), cell.bitwiseAND(F.lit((1 << STRETCH) - 1)).cast("int")
    flags = hot.groupBy(stretch.alias("at")).agg(F.collect_set(inside).alias("cells")).mapInPandas(_packed_bits, "at long, bits binary")
    bits = np.zeros((cells >> STRETCH, 1 << STRETCH >> 3), np.uint8)
    for r in flags.toLocalIterator():
        bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    bits = bits.reshape(-1)
    return np.minimum(255, np.log2(words + 1) * 16).astype(np.uint16), bits


def _is_common(shingles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """1 for shingles whose cell is set, else 0."""
    cell = (shingles & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1


def _describe(size: int, percent: int, weight_b, hot_b):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, hot = weight_b.value, hot_b.value
        for pdf in batches:
            words, at = word_hashes(utf8(pdf["text"]))
            cost = weight[words & np.uint64(CELLS - 1)].astype(np.uint64)
            n, d1, d2, prefix, bits, wide = [], [], [], [], [], []
            for a, b in zip(at, at[1:]):
                every = shingle_hashes(words[a:b], size)
                own, first = np.unique(every, return_index=True)
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                n.append(len(own))
                d1.append(digest[0])
                d2.append(digest[1])
                prefix_of = own.view(np.int64)
                k = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                if k < len(own):
                    span = min(size, b - a)
                    total = np.cumsum(np.concatenate(([np.uint64(0)], cost[a:b])))
                    rank = np.minimum((total[span:] - total[:-span])[first], np.uint64(2047)) | (_is_common(own, hot).astype(np.uint64) << np.uint64(11))
                    prefix_of = prefix_of[np.argpartition((rank << np.uint64(52)) | (own >> np.uint64(12)), k - 1)[:k]]
                prefix.append(prefix_of)
                bits.append(signature(own, BITS).tobytes())
                wide.append(signature(own, WIDE_BITS).tobytes() if len(own) >= WIDE_FROM else None)
            yield pd.DataFrame({"id": pdf["id"], "known": pdf["known"], "n": n, "d1": d1, "d2": d2, "prefix": prefix, "bits": bits, "wide": wide})

    return of


def signature(own: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits with each shingle's low bits set."""
    flags = np.zeros(width, np.uint8)
    flags[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


class SignatureTree:
    """Signatures of sets, ordered by size, under nodes with OR-ed bitmaps, size ranges and most colliding shingles."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, wide: list):
        self.n, self.bits, self.wide = n, bits, wide
        self.spare = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        cut = np.arange(0, len(n), LEAF)
        over = lambda bits, low, high, spare, cut: (np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut))
        self.levels = [over(bits, n, n, self.spare, cut)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(over(*self.levels[-1], np.arange(0, len(self.levels[-1][1]), FAN)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray]) -> SignatureTree:
        wide = [signature(s, WIDE_BITS) if len(s) >= WIDE_FROM else None for s in sets]
        return cls(np.array([len(s) for s in sets], np.int64), np.array([signature(s, BITS) for s in sets]).reshape(len(sets), -1), wide)

    def below(self, level: int, node: int) -> slice:
        width = LEAF * FAN**level
        return slice(node * width, (node + 1) * width)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][1])))


def _close(one: SignatureTree, i: int, two: SignatureTree, j: int, percent: int) -> bool:
    """Whether the wide bitmaps of two sets, if both have one, allow enough overlap."""
    a, b = one.wide[i], two.wide[j]
    if a is None or b is None:
        return True
    spare = min(one.n[i] - int(np.bitwise_count(a).sum()), two.n[j] - int(np.bitwise_count(b).sum()))
    return (100 + percent) * (int(np.bitwise_count(a & b).sum()) + spare) >= percent * (one.n[i] + two.n[j])


def dual_traversal(one: SignatureTree, two: SignatureTree, percent: int, settled) -> Iterator[tuple[int, int]]:
    """Pairs of sets, one of each tree, that their signatures allow to reach the threshold. ``settled(a, b)`` tells of
    two slices of sets whether nothing is left to find between them. Pass the same tree twice for a self-join, which
    gives each pair once."""
    same = one is two
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        p, i, q, j = stack.pop()
        bits_x, low_x, high_x, spare_x = (a[i] for a in one.levels[p])
        bits_y, low_y, high_y, spare_y = (a[j] for a in two.levels[q])
        if 100 * high_x < percent * low_y or 100 * high_y < percent * low_x:
            continue
        most = min(high_x, high_y, int(np.bitwise_count(bits_x & bits_y).sum()) + min(spare_x, spare_y))
        x, y = one.below(p, i), two.below(q, j)
        if (100 + percent) * most < percent * (low_x + low_y) or settled(x, y):
            continue
        if p == 0 and q == 0:
            n, m = one.n[x, None], two.n[None, y]
            common = np.bitwise_count(one.bits[x, None] & two.bits[None, y]).sum(axis=2, dtype=np.int64)
            most = np.minimum(np.minimum(n, m), common + np.minimum(one.spare[x, None], two.spare[None, y]))
            able = (100 + percent) * most >= percent * (n + m)
            if same and i == j:
                able = np.triu(able, 1)
            for a, b in np.argwhere(able).tolist():
                yield x.start + a, y.start + b
        elif same and p == q and i == j:
            kids = one.children(p, i)
            stack += [(p - 1, a, q - 1, b) for a in kids for b in kids if a <= b]
        elif p >= q:
            stack += [(p - 1, a, q, j) for a in one.children(p, i)]
        else:
            stack += [(p, i, q - 1, b) for b in two.children(q, j)]


def exact_links(one: SignatureTree, two: SignatureTree, sets_one: list, sets_two: list, roots_one: np.ndarray, roots_two: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components. roots_*: the component of each set, from one numbering, changed in place."""
    links = []

    def joined(x: slice, y: slice) -> bool:
        a, b = roots_one[x], roots_two[y]
        return bool((a == a[0]).all() and (b == a[0]).all())

    for i, j in dual_traversal(one, two, percent, joined):
        old, new = roots_two[j], roots_one[i]
        if old == new or not _close(one, i, two, j, percent):
            continue
        a, b = sets_one[i], sets_two[j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            links.append((i, j))
            roots_one[roots_one == old] = new
            roots_two[roots_two == old] = new
    return links


def _by_block(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole blocks of rows sorted by ``key``, across batch borders."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        keys = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            part = pdf.iloc[a:b]
            if held and (held[-1][key].iloc[0] != part[key].iloc[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _sets_of(texts, size: int) -> list[np.ndarray]:
    words, at = word_hashes(utf8(texts))
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(at, at[1:])]


def _signed(block: pd.DataFrame) -> tuple[pd.DataFrame, SignatureTree]:
    """Rows of a block by size, and their tree."""
    block = block.sort_values("n", kind="stable")
    bits = np.frombuffer(b"".join(block["bits"]), np.uint64).reshape(len(block), -1)
    return block, SignatureTree(block["n"].to_numpy(), bits, [None if w is None else np.frombuffer(w, np.uint64) for w in block["wide"]])


def _screen(percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members that some other of their block could match, by signatures (kind 0). In groups of several blocks also the
        others (kind 1)."""
        for block in _by_block(batches, ["pivot", "block"]):
            block, tree = _signed(block)
            hit = np.zeros(len(block), bool)
            for i, j in dual_traversal(tree, tree, percent, lambda x, y: hit[x].all() and hit[y].all()):
                if not (hit[i] and hit[j]) and _close(tree, i, tree, j, percent):
                    hit[i] = hit[j] = True
            told = hit | (block["n_blocks"].to_numpy() > 1)
            yield pd.DataFrame({"kind": np.where(hit, 0, 1)[told], "id": block["id"][told], "n": block["n"][told], "pivot": block["pivot"][told]})

    return of


def _screen_rest(percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ``rest`` of a group that some member of one of its blocks could match, by signatures."""
        for block in _by_block(batches, ["pivot", "block", "chunk"]):
            if not 0 < block["rest"].sum() < len(block):
                continue
            (base, one), (rest, two) = _signed(block[~block["rest"]]), _signed(block[block["rest"]])
            hit, a, b = np.zeros(len(rest), bool), base["id"].to_numpy(), rest["id"].to_numpy()
            for i, j in dual_traversal(one, two, percent, lambda x, y: hit[y].all()):
                if not hit[j] and a[i] != b[j] and _close(one, i, two, j, percent):
                    hit[j] = True
            yield rest.loc[hit, ["id", "n", "pivot"]]

    return of


def _join_block(size: int, percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _by_block(batches, ["pivot", "block"]):
            sets = _sets_of(block["text"], size)
            order = np.argsort([len(s) for s in sets], kind="stable")
            sets, ids = [sets[k] for k in order], block["id"].to_numpy()[order]
            roots = np.arange(len(sets))
            tree = SignatureTree.of_sets(sets)
            links = exact_links(tree, tree, sets, sets, roots, roots, percent)
            pivot = block["pivot"].iloc[0]
            out = [(0, ids[i], ids[j]) for i, j in links]
            if block["n_blocks"].iloc[0] > 1:
                home = roots[np.flatnonzero(ids == pivot)[:1]]
                out += [(1, pivot, x) for x in ids[~np.isin(roots, home)]]
            yield pd.DataFrame(out, columns=["kind", "u", "v"])

    return of


def _join_rest(size: int, percent: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _by_block(batches, ["pivot", "block", "chunk"]):
            sets = _sets_of(block["text"], size)
            order = np.argsort([len(s) for s in sets], kind="stable")
            rest, ids = block["rest"].to_numpy()[order], block["id"].to_numpy()[order]
            sets = [sets[k] for k in order]
            a, b = np.flatnonzero(~rest), np.flatnonzero(rest)
            one, two = [sets[k] for k in a], [sets[k] for k in b]
            # One document on both sides is one leaf of one component from the start.
            names = {x: k for k, x in enumerate(dict.fromkeys(ids.tolist()))}
            r1, r2 = (np.array([names[x] for x in ids[k].tolist()], np.int64) for k in (a, b))
            links = exact_links(SignatureTree.of_sets(one), SignatureTree.of_sets(two), one, two, r1, r2, percent) if one and two else []
            yield pd.DataFrame([(0, ids[a[i]], ids[b[j]]) for i, j in links], columns=["kind", "u", "v"])

    return of


def _deal(members: DataFrame, blocks: Column) -> tuple[DataFrame, DataFrame]:
    """((pivot, n_blocks), (id, pivot, block, n_blocks)): members dealt over the blocks of their group, the pivot in each."""
    sizes = members.groupBy("pivot").agg(F.ceil(blocks).cast("long").alias("n_blocks"))
    others = members.where("id <> pivot").select("id", "pivot").distinct().join(sizes, "pivot")
    others = others.select("id", "pivot", F.pmod(F.xxhash64("id"), "n_blocks").alias("block"), "n_blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")
    return sizes, others.unionByName(sizes.select(F.col("pivot").alias("id"), "pivot", every, "n_blocks"))


def _against(rest: DataFrame, sizes: DataFrame, placed: DataFrame, chunk_docs: int) -> DataFrame:
    """(id, pivot, block, chunk, rest): the ``rest`` (pivot, id) of each group in chunks, each beside every block of it."""
    chunks = rest.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / chunk_docs).alias("n_chunks"))
    to = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    base = placed.join(chunks, "pivot").select("id", "pivot", "block", to("n_chunks", "chunk"), F.lit(False).alias("rest"))
    left = rest.join(chunks, "pivot").join(sizes, "pivot").select("id", "pivot", to("n_blocks", "block"), F.pmod(F.xxhash64("id"), "n_chunks").alias("chunk"), F.lit(True).alias("rest"))
    return base.unionByName(left)


def _in_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key)


def near_in_size(members: DataFrame, percent: int) -> DataFrame:
    """The members (id, n, pivot) with another of their group that is near enough in size. The windows run over the
    distinct sizes of a group."""
    sizes = members.groupBy("pivot", "n").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("pivot").orderBy("n")
    near = (F.col("c") > 1) | (100 * F.lag("n").over(order) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(order))
    able = sizes.withColumn("near", near).where("near").select("pivot", "n")
    return members.join(able, ["pivot", "n"]).select("id", "n", "pivot")


def screened(members: DataFrame, signatures: DataFrame, percent: int, screen_docs: int) -> DataFrame:
    """The members (id, n, pivot) that some other of their group could match, by signatures (id, n, bits, wide)."""
    sizes, placed = _deal(members, F.count(F.lit(1)) / screen_docs)
    found = _in_blocks(placed.join(signatures, "id"), ["pivot", "block"]).mapInPandas(_screen(percent), "kind int, id long, n long, pivot long")
    found = materialize(found, "jac-screened")
    kept, rest = found.where("kind = 0").select("id", "n", "pivot"), found.where("kind = 1").select("pivot", "id").distinct()
    if not rest.isEmpty():
        late = _in_blocks(_against(rest, sizes, placed, screen_docs).join(signatures, "id"), ["pivot", "block", "chunk"])
        kept = kept.unionByName(late.mapInPandas(_screen_rest(percent), "id long, n long, pivot long"))
    return materialize(kept.groupBy("id", "pivot").agg(F.max("n").alias("n")), "jac-kept")


def exact_pairs(members: DataFrame, texts: DataFrame, shingle: int, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(u, v): links that join the members (id, n, pivot) of each group, from the whole texts (id, text)."""
    # The pivot may have left its group; the smallest that stays takes its place.
    again = members.groupBy("pivot").agg(F.min("id").alias("least"))
    members = members.join(again, "pivot").groupBy("id", F.col("least").alias("pivot")).agg(F.max("n").alias("n"))
    sizes, placed = _deal(members, F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n") / block_shingles))
    sizes, placed = materialize(sizes, "jac-sizes"), materialize(placed, "jac-placed")
    # Members are few of all documents as a rule: only texts that may be theirs are moved.
    own_texts = possible_rows(texts, "id", placed)
    found = _in_blocks(own_texts.join(placed, "id"), ["pivot", "block"]).mapInPandas(_join_block(shingle, percent), "kind int, u long, v long")
    found = materialize(found, "jac-found")
    links, rest = found.where("kind = 0").select("u", "v"), found.where("kind = 1").select(F.col("u").alias("pivot"), F.col("v").alias("id")).distinct()
    if rest.isEmpty():
        return links
    late = _in_blocks(own_texts.join(_against(rest, sizes, placed, block_docs), "id"), ["pivot", "block", "chunk"])
    return materialize(links.unionByName(late.mapInPandas(_join_rest(shingle, percent), "kind int, u long, v long").select("u", "v")), "jac-links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, sample_docs: int = 4_000, block_docs: int = 256, block_shingles: int = 400_000, screen_docs: int = 4096) -> DataFrame:
    """One row per input row: id, n_shingles, representative (smallest id with the same set), component_id."""
    sc, id_ = docs.sparkSession.sparkContext, integer_id(docs, id_col)
    texts = docs.select(F.coalesce(id_, F.lit(0)).alias("id"), id_.isNotNull().alias("known"), F.col(text_col).alias("text"))
    weight, hot = (sc.broadcast(x) for x in shingle_order(texts.where("known"), shingle, sample_docs))
    schema = "id long, known boolean, n long, d1 long, d2 long, prefix array<long>, bits binary, wide binary"
    described = materialize(texts.mapInPandas(_describe(shingle, percent, weight, hot), schema), "jac-sets")
    named, digest = described.where("known and n > 0"), ["d1", "d2"]
    classes = materialize(named.groupBy(*digest).agg(F.min("id").alias("rep")), "jac-classes")

    first = named.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    keys = first.select("id", "n", F.explode("prefix").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    members = materialize(keys.join(shared, "key").select("id", "n", "pivot").distinct(), "jac-members")
    members = materialize(near_in_size(members, percent).groupBy("id", "pivot").agg(F.max("n").alias("n")), "jac-near")
    signatures = possible_rows(named.select("id", "n", "bits", "wide"), "id", members)
    links = exact_pairs(screened(members, signatures, percent, screen_docs), texts.where("known").select("id", "text"), shingle, percent, block_docs, block_shingles)

    # An id with several sets is linked to the class of each.
    several = described.where("known").groupBy("id").agg(F.min(F.struct(*digest)).alias("a"), F.max(F.struct(*digest)).alias("b")).where("a <> b").select("id")
    several = materialize(several, "jac-several")
    same_id = named.join(several, "id", "left_semi").join(classes, digest).select("id", "rep").distinct()
    component = connected_components(links.union(same_id))
    # Empty sets equal nothing: each gets a digest of its own.
    own = lambda c, alone: F.when(F.col("n") > 0, F.col(c)).otherwise(alone).alias(c)
    keyed = described.select(F.when(F.col("known"), F.col("id")).alias("id"), "n", own("d1", F.xxhash64("id")), own("d2", F.col("id")))
    reps = classes.unionByName(several.select(F.xxhash64("id").alias("d1"), F.col("id").alias("d2"), F.col("id").alias("rep")))
    per_class = reps.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, "rep", F.coalesce("component", "rep").alias("component"))
    out = keyed.join(per_class, digest, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("representative"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest id; columns unchanged. Here a document is an id and a text: equal
    rows are reduced to one, texts under one id or a null id take part like others. Null ids are largest, equal ids go
    by the hash of the text. Documents are told apart by a hash of 64 bits; only those that go are moved."""
    rows = distinct_rows(docs, id_col, text_col)
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col))
    found = jaccard_join(rows.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **options).select("key", "component_id")
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    grouped = materialize(found.join(several, "component_id"), "jac-groups")
    name = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    names = grouped.join(rows.select(key.alias("key"), name.alias("name")), "key")
    first = names.groupBy("component_id").agg(F.min_by("key", "name").alias("first"))
    gone = grouped.join(first, "component_id").where("key <> first").select("key")
    return unpacked(without_keys(packed(rows, key=key), "key", gone))
