"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assetloom.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every neighbour larger than u to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum of the edges: equal for equal tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


class _Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def add(self, pdf: pd.DataFrame) -> None:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def pairs(self) -> tuple[list, list]:
        return list(self.parent), [self.root(x) for x in self.parent]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch as stars around the smallest node of each component there."""
    for pdf in batches:
        forest = _Forest()
        forest.add(pdf)
        node, root = forest.pairs()
        out = pd.DataFrame({"u": node, "v": root})
        yield out[out["u"] != out["v"]]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a bounded number of edges."""
    forest = _Forest()
    for pdf in batches:
        forest.add(pdf)
    node, root = forest.pairs()
    yield pd.DataFrame({"node": node, "component": root})


def connected_components(edges: DataFrame, local_edges: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. ``edges`` has two columns of
    one orderable type; nulls, self-loops and repeats are ignored. Each batch of edges is contracted to a forest where it
    lies. Up to ``local_edges`` edges that are left, as counted, are solved in one task; more by rounds, whose number
    grows with the logarithm of the node count, each written to the shared folder."""
    a, b = edges.columns
    kind = dict(edges.dtypes)[a]
    given = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    state = materialize(given.mapInPandas(_contract, f"u {kind}, v {kind}").distinct(), "cc")
    before = _mark(state)
    if before[0] <= local_edges:
        return state.coalesce(1).mapInPandas(_solve, f"node {kind}, component {kind}")
    nodes = materialize(state.select(F.col("u").alias("node")).union(state.select("v")).distinct(), "cc-nodes")
    while True:
        last, state = state, materialize(_small_star(_large_star(state)).where("u <> v").distinct(), "cc")
        now = _mark(state)
        discard(last)
        if now == before:
            break
        before = now
    return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
