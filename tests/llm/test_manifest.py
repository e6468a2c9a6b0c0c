"""The Merkle manifest against a plain tree of lists, at several fan-outs and strides."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assetloom.llm import manifest as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(root, proof of each node as a list of levels of siblings)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + fanout]) for k in range(0, len(below), fanout)])
    proofs = []
    for at in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            first = at - at % fanout
            proof.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            at //= fanout
        proofs.append(proof)
    return levels[-1][0], proofs


def plain(rows, fanout):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made, tops = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, proofs = tree([leaf(r) for r in own], fanout)
        tops.append(top)
        made.append((own, proofs))
    root, upper = tree(tops, fanout)
    return [(r[0], leaf(r), top, root, proof + up) for (own, proofs), top, up in zip(made, tops, upper) for r, proof in zip(own, proofs)]


def rows():
    sizes = {"a": 95, "b": 17, "ä": 16, None: 33, "": 1, "A": 2}
    out = [(1000 * k + j, s, ["en", None][j % 2], j if j % 3 else None, None if j % 7 == 3 else f"Text {j} é𝒳") for k, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return [*out, out[0], out[5], out[5], (None, "a", None, None, None), (None, None, None, None, None), (1001, "a", "de", 3, "used id")]


@pytest.mark.parametrize(("fanout", "stride"), [(16, 2), (3, 2), (4, 1)])
def test_proofs(spark, fanout, stride):
    df = spark.createDataFrame(rows(), "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "size", "idx", "node", "order", "leaf", "root", "tie", "place", "part", "block")})
    built = M.build_manifest(df.repartition(5), fanout=fanout, stride=stride, carry={"doc_id": F.col("doc_id")})
    found = built.proofs().withColumn("folded", M.fold_proof(F.col("leaf"), F.col("proof"))).withColumn("digest", M.proof_digest(F.col("proof"))).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in found), key=str)
    assert got == sorted(plain(rows(), fanout), key=str)
    assert all(r.folded == r.root and r.digest == H(*(x + y for x, y in r.proof)) for r in found)
    # Only every stride-th level is there.
    assert built.levels[1].where("key = 'sa'").count() == -(-100 // fanout**stride)


def test_small_and_empty(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = M.build_manifest(spark.createDataFrame([(1, "s", None, 2, "ab")], schema), carry={"doc_id": F.col("doc_id")})
    row = one.proofs().first()
    assert row.leaf == row.subroot == row.root == leaf((1, "s", None, 2, "ab")) and row.proof == []
    none = M.build_manifest(spark.createDataFrame([], schema), carry={"doc_id": F.col("doc_id")})
    assert none.proofs().count() == 0 and none.root().count() == 0


def test_one_group_over_many_partitions(spark):
    """Places inside a group that spans partitions, ids beyond 2 ** 53 beside null ones, text ids."""
    big = [((1 << 60) + k if k else None, "hot", None, k, str(k)) for k in range(300)]
    df = spark.createDataFrame(big, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    found = M.build_manifest(df, carry={"doc_id": F.col("doc_id")}).proofs().select("doc_id", "leaf", "root").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((r[0], r[1], r[3]) for r in plain(big, 16)), key=str)
    named = M.build_manifest(df.withColumn("doc_id", F.col("doc_id").cast("string")), carry={"doc_id": F.col("doc_id")})
    assert named.proofs().count() == 300
