"""Merkle manifest of a document table, with stored checkpoints (operator 13).

Every row is a leaf. Inside a group (source) leaves are ordered, and runs of ``fanout`` nodes become the digest of their
children until one is left, the subroot; the subroots, in the order of their groups, become the root the same way. Only every
``stride``-th level is written: it holds one node for each aligned subtree of ``fanout ** stride`` nodes of the level
below. A proof descends through the stored levels: each aligned subtree is one group of rows of bounded size, its missing
interior nodes are computed again from the stored ones below, the siblings on every path are emitted, and the interior
is forgotten. What stands above a subtree's top is joined to it, one row for each subtree.

Leaves are numbered inside their group from a written table sorted by range: one offset for each pair of group and
partition, so that a group may hold any share of the rows. All later steps are keyed by (group, number of the subtree).

Digests are lower-case hexadecimal SHA-256 over the hexadecimal text of the children. Defined cases: a null value is ``-``
in its leaf; the null group comes first; null ids come first in their group; rows of one group and id are ordered by their
leaves, and repeated rows are leaves each; an empty table has no root and an empty result; other columns are not read,
whatever their names."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import discard, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
#: Offsets of so many runs are broadcast at most; more are joined by shuffle.
BROADCAST_RUNS = 100_000


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text; ``-`` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text]), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to along its proof."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, ...) with size, the number of rows of the key, and idx: 0, 1, ... in ``order`` inside it. Rows that
    are equal there come in any order."""
    place, tie = F.monotonically_increasing_id().alias("place"), F.monotonically_increasing_id().alias("tie")
    given = materialize(rows.select("*", tie), "manifest-rows")
    ranged = given.repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    placed = materialize(ranged.select("*", place), "manifest-sorted")
    discard(given)
    part = F.shiftright("place", 33)
    runs = placed.groupBy("key", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row for each partition that holds the key.
    each = W.partitionBy("key")
    before = F.coalesce(F.sum("n").over(each.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(each).alias("size")), "manifest-runs")
    few = runs.count() <= BROADCAST_RUNS
    out = placed.withColumn("part", part).join(F.broadcast(runs) if few else runs, ["key", "part"])
    return out.withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def climb(nodes: list[str], size: int, steps: int, fanout: int) -> list[list[str]]:
    """Up to ``steps`` levels above an aligned run of nodes, itself first; ``size`` is the number of nodes of its whole level."""
    levels = [nodes]
    while len(levels) <= steps and size > 1:
        below = levels[-1]
        levels.append([sha256("".join(below[k : k + fanout]).encode()).hexdigest() for k in range(0, len(below), fanout)])
        size = -(-size // fanout)
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[dict]:
    """What stands left and right of the path from node ``at``, level by level up to the top."""
    out = []
    for run in levels[:-1]:
        first = at - at % fanout
        out.append({"left": "".join(run[first:at]), "right": "".join(run[at + 1 : first + fanout])})
        at //= fanout
    return out


def _emitted(nodes: pa.Table, steps: int, fanout: int, rest: list[dict]) -> pa.Array:
    """The proofs of the sorted nodes of one aligned subtree, going on with ``rest`` above it."""
    levels = climb(nodes["node"].to_pylist(), nodes["size"][0].as_py(), steps, fanout)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.array([siblings(levels, k, fanout) + rest for k in range(len(nodes))], kind)


def stored_levels(leaves: DataFrame, fanout: int, stride: int) -> list[DataFrame]:
    """(key, size, idx, node) of every ``stride``-th level, each written, from the leaves to one node for each key."""

    def top(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        size = nodes["size"][0].as_py()
        levels = climb(nodes["node"].to_pylist(), size, stride, fanout)
        for _ in levels[1:]:
            size = -(-size // fanout)
        return pa.table({"key": nodes["key"][:1], "size": pa.array([size], pa.int64()), "idx": nodes["block"][:1], "node": [levels[-1][0]]})

    levels = [leaves.select("key", "size", "idx", "node")]
    while (levels[-1].agg(F.max("size")).first()[0] or 0) > 1:
        subtree = F.floor(F.col("idx") / fanout**stride).alias("block")
        above = levels[-1].select("key", "size", "idx", "node", subtree).groupBy("key", "block").applyInArrow(top, "key string, size long, idx long, node string")
        levels.append(materialize(above, "manifest-level"))
    return levels


def paths(level: DataFrame, above: DataFrame, fanout: int, stride: int) -> DataFrame:
    """(key, idx, node, proof) of all nodes of a stored level. above: (key, idx, proof) of the stored level above it."""

    def extract(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        proof = _emitted(nodes, stride, fanout, tops["proof"][0].as_py())
        return pa.table({"key": nodes["key"], "idx": nodes["idx"], "node": nodes["node"], "proof": proof})

    subtree = F.floor(F.col("idx") / fanout**stride).alias("block")
    below = level.select("key", "size", "idx", "node", subtree).groupBy("key", "block")
    tops = above.select("key", F.col("idx").alias("block"), "proof").groupBy("key", "block")
    return below.cogroup(tops).applyInArrow(extract, f"key string, idx long, node string, proof {PROOF}")


@dataclass
class Manifest:
    """leaves: (key, size, idx, node, carried columns), written. levels: the stored levels of the groups, the leaves'
    first. upper: the stored levels over the subroots, in the order of the keys, as the one group ``''``."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    fanout: int
    stride: int

    def root(self) -> DataFrame:
        """One row (root)."""
        return self.upper[-1].select(F.col("node").alias("root"))

    def proofs(self) -> DataFrame:
        """(carried columns, leaf, subroot, root, proof) of every leaf. proof: for each level from the leaf to the root,
        the digests left and right of the path, joined."""
        empty = F.array().cast(PROOF)
        at = self.upper[-1].select("key", "idx", empty.alias("proof"))
        for level in reversed(self.upper):
            at = paths(level, at, self.fanout, self.stride)
        # The path of a subroot goes on from the top of its group's own tree.
        named = self.subroots.select(F.col("group").alias("key"), "idx").join(at.select("idx", F.col("node").alias("subroot"), "proof"), "idx")
        named = materialize(named.crossJoin(F.broadcast(self.root())).select("key", "subroot", "root", "proof"), "manifest-subroots")
        at = named.select("key", F.lit(0).cast("long").alias("idx"), "proof")
        for level in reversed(self.levels[1:]):
            at = materialize(paths(level, at, self.fanout, self.stride), "manifest-paths")
        return self._with_rows(at, named)

    def _with_rows(self, above: DataFrame, named: DataFrame) -> DataFrame:
        """The leaves' own paths, emitted beside their carried columns. A row of ``named`` for each subtree brings the
        subroot and the root."""
        fanout, stride = self.fanout, self.stride if len(self.levels) > 1 else 0
        kinds = {f.name: f.dataType for f in self.leaves.schema.fields}
        carried = [c for c in self.leaves.columns if c not in ("key", "size", "idx", "node")]

        def extract(nodes: pa.Table, tops: pa.Table) -> pa.Table:
            nodes, top = nodes.sort_by("idx"), tops.to_pylist()[0]
            every = lambda name: pa.array([top[name]] * len(nodes), pa.string())
            own = [*[nodes[c] for c in carried], nodes["node"], every("subroot"), every("root")]
            return pa.table([*own, _emitted(nodes, stride, fanout, top["proof"])], names=[*carried, "leaf", "subroot", "root", "proof"])

        subtree = F.floor(F.col("idx") / fanout**stride).alias("block")
        below = self.leaves.select("*", subtree).groupBy("key", "block")
        tops = above.select("key", F.col("idx").alias("block"), "proof").join(named.select("key", "subroot", "root"), "key").groupBy("key", "block")
        schema = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in carried) + f"leaf string, subroot string, root string, proof {PROOF}"
        return below.cogroup(tops).applyInArrow(extract, schema)


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group_col: str = "source", order_col: str = "doc_id", fanout: int = 16, stride: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` over the values of ``columns``; ``carry`` are columns to keep beside the leaves, by names
    other than key, size, idx, node, order and leaf."""
    group = F.col(group_col).cast("string")
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), group))
    extra = [c.alias(name) for name, c in (carry or {}).items()]
    rows = docs.select(key.alias("key"), F.col(order_col).alias("order"), leaf_digest([F.col(c) for c in columns]).alias("node"), *extra)
    leaves = materialize(numbered(rows, ["order", "node"]).drop("order"), "manifest-leaves")
    levels = stored_levels(leaves, fanout, stride)
    tops = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "node")
    subroots = materialize(numbered(tops, ["group"]), "manifest-tops")
    return Manifest(leaves, levels, subroots, stored_levels(subroots, fanout, stride), fanout, stride)
