"""What is kept and carried on: moments, prints of lists, replayed batches, versions, states of a log, strengths of items."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assetloom.common import children
from assetloom.operators import decisions as D, incremental as I, quality as Q
from assetloom.sources import media as S, sinks as K
from assetloom.streaming.refresh import read_target, refresh_part

LOG = "project string, seq long, op string, delete_paths array<string>, all_paths array<string>"


def listed(spark, *p):
    return spark.createDataFrame([(x,) for x in p], "path string")


def test_moments(spark):
    """Parts that come and go give the statistics of the rows that are there, also far from zero."""
    rnd = np.random.default_rng(2)
    rows = [(k, k % 5, float(1e8 + rnd.normal()), None if k % 7 == 0 else float(rnd.integers(0, 9)), 3.0) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, part long, far double, `a.b` double, flat double").withColumnsRenamed({"a.b": "some"})
    names = ["far", "some", "flat"]
    kept = Q.part_moments(df.where("part <> 3"), names, ["part"]).unionByName(Q.part_moments(df.where("part = 3"), names, ["part"]))
    left = Q.without_moments(kept, Q.part_moments(df.where("part = 1 OR part = 2 AND id % 2 = 0"), names, ["part"]))
    want = df.where("NOT (part = 1 OR part = 2 AND id % 2 = 0)").toPandas()
    got = Q.moment_stats(left, names).first()
    for c in names:
        assert got[f"mean_{c}"] == pytest.approx(want[c].mean(), rel=1e-12) and got[f"std_{c}"] == pytest.approx(want[c].std(ddof=0), rel=1e-5, abs=1e-7)
    norm = {r.id: r.norm_some for r in Q.component_norm(df, ["some"], Q.moment_stats(left, ["some"])).collect()}
    z = (df.toPandas().set_index("id")["some"] - want["some"].mean()) / want["some"].std(ddof=0)
    assert norm[1] == pytest.approx(1 / (1 + np.exp(-z[1])))
    gone = Q.without_moments(kept, kept)
    assert gone.count() == 0 and Q.moment_stats(gone, names).first()["mean_far"] is None


@settings(max_examples=3, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_drift(spark, now, before):
    a, b = (spark.createDataFrame([(f"/p/{k}",) for k in sorted(s)], "path string") for s in (now, before))
    want = {(f"/p/{k}", "cached" if k in now and k in before else "new" if k in now else "removed") for k in now | before}
    assert {tuple(r) for r in I.drift_split(a, b, buckets=16).collect()} == want == {tuple(r) for r in I.incremental_split(a, b).collect()}
    assert I.drift_status(b, a, I.path_prints(b)).first().status == ("ready" if now == before else "stale")
    assert I.is_subset(a, b) == (now <= before)


def test_drift_joins_the_change_only(spark):
    """Of 20,000 paths with one more and one less only those of two buckets are joined."""
    a = spark.range(20_000).select(F.concat(F.lit("/p/"), "id").alias("path"))
    b = a.where("path <> '/p/17'").unionByName(listed(spark, "/q"))
    changed = I.changed_buckets(I.path_prints(a), I.path_prints(b))
    assert 1 <= changed.count() <= 2
    assert sorted(tuple(r) for r in I.drift_split(a, b).where("status <> 'cached'").collect()) == [("/p/17", "new"), ("/q", "removed")]
    assert I.drift_status(b.unionByName(b), b).first().status == "ready"  # repeats don't count


def test_replayed_batches(spark, tmp_path):
    target, calls = f"file://{tmp_path}/t", []

    def compute(df):
        calls.append(1)
        return df.withColumn("n", F.length("path"))

    rows = lambda: sorted((r.path, r.n) for r in read_target(spark, target).collect())
    assert read_target(spark, target) is None
    refresh_part(listed(spark, "a", "bb", "bb"), target, "s-0", compute)
    refresh_part(listed(spark, "bb"), target, "s-1", compute)  # cut off
    refresh_part(listed(spark, "bb", "ccc"), target, "s-1", compute)
    first = rows()
    refresh_part(listed(spark, "bb", "ccc"), target, "s-1", compute)
    refresh_part(listed(spark, "a", "bb", "bb"), target, "s-0", compute)
    assert rows() == first == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_versions(spark, tmp_path):
    base = f"file://{tmp_path}/table"
    assert K.read_version(spark, base) is None and K.latest_version(spark, base) is None
    for k in range(12):
        K.write_version(spark.range(k), base)
    assert K.read_version(spark, base).count() == 11 and len(children(spark, base)) == 12
    # A version that was cut off isn't read, and the next is behind it.
    cut = K.write_version(spark.range(50), base)
    import os

    os.remove(cut.removeprefix("file://") + "/_SUCCESS")
    assert K.read_version(spark, base).count() == 11
    assert K.write_version(spark.range(3), base) > cut and K.read_version(spark, base).count() == 3
    assert K.drop_versions(spark, base, keep=2) == 11 and K.read_version(spark, base).count() == 3


def test_deleted_set(spark, tmp_path):
    (tmp_path / "pending.txt").write_text("  a.jpg \n\nb\n")
    (tmp_path / "curation.json").write_text('{"deleted": ["x", " y"]}')
    at = lambda name: f"file://{tmp_path}/{name}"
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(S.read_deleted(spark, at("curation.json"), at("pending.txt"))) == [" y", "x"]
    assert paths(S.read_deleted(spark, at("absent.json"), at("pending.txt"))) == ["a.jpg", "b"]
    assert paths(S.read_deleted(spark, at("absent.json"), at("absent.txt"))) == [] and paths(S.read_deleted(spark, None, None)) == []


def random_log(projects, n, seed):
    rnd = random.Random(seed)
    log = []
    for p in projects:
        for seq in range(n):
            own = [f"/{rnd.randint(0, 8)}" for _ in range(rnd.randint(0, 3))]
            log.append((p, seq, rnd.choice(["confirm", "confirm", "undo", "restore"]), own, [f"/{rnd.randint(0, 8)}"] if rnd.random() < 0.3 else []))
    return log


def state_at(log, project, seq):
    """(pending, removed results) after the events up to ``seq``, one by one."""
    pending, removed, stack = set(), [], []
    for p, s, op, delete, every in sorted(log):
        if p != project or s > seq:
            continue
        if op == "confirm":
            pending |= set(delete)
            out = every or delete
            removed.append((s, set(out)))
            if delete or every:
                stack = [*stack, (s, delete)][-D.UNDO_DEPTH :]
        elif op == "restore":
            pending -= set(delete)
        elif stack:
            at, own = stack.pop()
            pending -= set(own)
            removed = [r for r in removed if r[0] != at]
    return pending, set().union(*(r[1] for r in removed)) if removed else set()


def test_states_of_a_log(spark):
    projects = ["p", "q", "r"]
    log = random_log(projects, 40, 3)
    df = spark.createDataFrame(log, LOG).repartition(5)
    asked = [(p, s) for p in projects for s in (0, 7, 19, 39)]
    points = spark.createDataFrame(asked, "project string, seq long")
    results = [(p, k % 2, 1.0, f"/{k}", float(k * 3 % 7), k // 2 + 1) for p in projects for k in range(9)]
    table = spark.createDataFrame(results, "project string, cluster_id long, cluster_score double, path string, score double, rank long")
    pending, left = {}, {}
    for r in D.pending_as_of(df, points).collect():
        pending.setdefault((r.project, r.seq), set()).add(r.path)
    rows = D.results_as_of(table, df, points).collect()
    for r in rows:
        left.setdefault((r.project, r.seq), set()).add(r.path)
    for p, s in asked:
        want, gone = state_at(log, p, s)
        assert pending.get((p, s), set()) == want and left.get((p, s), set()) == {r[3] for r in results if r[0] == p and r[3] not in gone}
    for key in {(r.project, r.seq, r.cluster_id) for r in rows}:
        own = sorted((r for r in rows if (r.project, r.seq, r.cluster_id) == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [r.score for r in own] == sorted((r.score for r in own), reverse=True)
    last = {(r.project, r.path) for r in D.results_after(table, df).collect()}
    assert last == {(r[0], r[3]) for r in results if r[3] not in state_at(log, r[0], 39)[1]}


def test_results_of_two_projects_stay_apart(spark):
    log = spark.createDataFrame([("p", 1, "confirm", ["a"], []), ("q", 1, "confirm", ["b"], [])], LOG)
    one = spark.createDataFrame([(1, 1.0, "a", 0.5, 1), (1, 1.0, "b", 0.4, 2)], "cluster_id long, cluster_score double, path string, score double, rank long")
    with pytest.raises(ValueError):
        D.results_after(one, log)
    assert [r.path for r in D.results_after(one, log.where("project = 'p'")).collect()] == ["b"]
    both = one.crossJoin(spark.createDataFrame([("p",), ("q",)], "project string"))
    assert sorted((r.project, r.path) for r in D.results_after(both, log).collect()) == [("p", "b"), ("q", "a")]


def test_strengths(spark):
    """The maximum of the posterior: its gradient vanishes; parts that never met, and items that never won, have a place."""
    rnd, true = random.Random(8), [0.2, 0.5, 1.0, 2.0, 4.0]
    games = [(1, a, b) if rnd.random() < true[a] / (true[a] + true[b]) else (1, b, a) for _ in range(400) for a, b in [rnd.sample(range(5), 2)]]
    games += [(2, 10, 11)] * 3 + [(2, 12, 13), (2, 13, 12)] + [(1, 3, 3), (1, None, 2)]
    table = spark.createDataFrame(games, "cluster_id long, winner long, loser long")
    got = {(r.cluster_id, r["item"]): r for r in D.matchup_strengths(table, prior=0.5).collect()}
    rounds = {(r.cluster_id, r["item"]): r.strength for r in D.matchup_strengths(table, prior=0.5, tolerance=1e-3, max_local=0).collect()}
    assert rounds == pytest.approx({k: r.strength for k, r in got.items()}, rel=0.02)
    s = {k: r.strength for k, r in got.items()}
    for (c, x), r in got.items():
        own = [g for g in games if g[0] == c and x in g[1:] and g[1] != g[2] and None not in g]
        assert r.n_games == len(own) and r.n_wins == sum(g[1] == x for g in own)
        share = sum(s[c, x] / (s[c, x] + s[c, g[2] if g[1] == x else g[1]]) for g in own) + 2 * 0.5 * s[c, x] / (s[c, x] + 1)
        assert r.n_wins + 0.5 == pytest.approx(share, abs=1e-4)
    assert sorted(range(5), key=lambda x: s[1, x]) == [0, 1, 2, 3, 4] and s[2, 10] > s[2, 11] and s[2, 12] == pytest.approx(s[2, 13])
    assert D.matchup_strengths(spark.createDataFrame([], "cluster_id long, winner long, loser long")).count() == 0


def test_long_vectors(spark):
    """The norm is computed once for a vector: 2,000 of 1,024 values take seconds at most."""
    import time

    from assetloom.functions.vectors import l2_normalize
    from assetloom.operators.ranking import cluster_centroid

    df = spark.range(2000).select(F.col("id").alias("cluster_id"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda k: F.sin(k * (F.col("id") + 1))).alias("embedding"))
    began = time.time()
    df.select(l2_normalize(F.col("embedding")).alias("v")).write.format("noop").mode("overwrite").save()
    cluster_centroid(df).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 30
