"""What must hold however many rows there are: shares of rows sent, whole results, bounded rests."""

import os
import time
import tracemalloc
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom import common
from assetloom.operators import decisions, graph_linkage, linkage, neighbors, pivots, runs
from assetloom.plans import queries

D = 8


def points(n, groups, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, D))[rng.integers(0, groups, n)] + rng.normal(size=(n, D)) * noise
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, names=("id", "v")):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"{names[0]} long, {names[1]} array<double>")


def test_rows_are_sent_to_few_blocks(spark):
    assert neighbors._blocks_of(100_000, None) <= neighbors.BLOCKS
    few, many = frame(spark, points(10, 2)), frame(spark, points(90, 2)).selectExpr("id + 100 AS id", "v")
    # Ten rows are one block, which each of the many meets once.
    dealt = neighbors._both_dealt(few, many, [], 10)
    assert dealt.where("side = 1").count() == 90 and dealt.where("side = 0").count() == 90


@pytest.mark.parametrize("values", [0, 100 * D, 10**9])
def test_rest_of_a_component_in_a_task(spark, values):
    v = points(240, 12)
    df = frame(spark, v, ("asset_id", "embedding"))
    got = {r[0]: r[1] for r in linkage.average_linkage(df, 0.5, max_local=5, block_rows=60, finish_values=values).collect()}
    assert got == dict(enumerate(linkage.merge_rounds(np.arange(len(v)), v, 0.5).tolist()))


def test_screened_rounds_equal_direct(monkeypatch):
    v = points(700, 30)
    direct = linkage.merge_rounds(np.arange(700), v, 0.5)
    monkeypatch.setattr(linkage, "DIRECT", 1)
    assert (linkage.merge_rounds(np.arange(700), v, 0.5) == direct).all()


def test_components_without_pairs(spark):
    df = frame(spark, points(400, 10, noise=0.05))
    edges = neighbors.component_edges(df, 0.2, block_rows=100)
    # At most one edge for each row of a pair of blocks: the pairs are far more.
    assert edges.count() < neighbors.pairs_within(df, 0.2).count() / 2
    of = lambda e: {(r.node, r.component) for r in linkage.connected_components(e).collect()}
    assert of(edges) == of(neighbors.pairs_within(df, 0.2).select("a", "b"))


def test_bridges_hold_no_pairs_of_parts(spark):
    v = points(200, 20, noise=0.02)
    rows = frame(spark, v).selectExpr("id", "id % 20 AS part", "id % 20 AS deal", "v")
    found = neighbors.closest_of_parts(rows, rows, 3.0, 50).collect()
    d = np.round(1 - v @ v.T, neighbors.DECIMALS)
    best = {}
    for a in range(200):
        for b in range(a + 1, 200):
            if a % 20 != b % 20:
                key = tuple(sorted((a % 20, b % 20)))
                best[key] = min(best.get(key, (9,)), (d[a, b], a, b))
    got = {}
    for r in found:
        key = tuple(sorted((r.a % 20, r.b % 20)))
        got[key] = min(got.get(key, (9,)), (r.dist, r.a, r.b))
    assert got == best and len(found) < 3 * len(best)


def test_lsh_finds_a_pair_once_with_few_copies(spark):
    assert neighbors.lsh_size(600_000, 0.65, 0.95, 64)[1] <= 32
    df = frame(spark, points(300, 20, noise=0.1))
    found = neighbors.approximate_pairs(df, 0.1, block_rows=16)
    whole = {(r.a, r.b, r.dist) for r in neighbors.pairs_within(df, 0.1).collect()}
    rows = [(r.a, r.b, r.dist) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= whole and len(rows) >= 0.9 * len(whole)


def test_vectors_of_a_bucket_move_once(spark):
    """Only keys of several blocks are looked up, by broadcast whatever Spark reckons; a bucket of many rows is one block."""
    bits, _ = neighbors.lsh_size(600_000, 0.65, 0.95, 64)
    assert 600_000 / 2**bits < neighbors.BUCKET_ROWS
    df = frame(spark, points(90, 6)).selectExpr("id", "v", "CASE WHEN id % 10 = 9 THEN NULL WHEN id < 60 THEN 1 ELSE id % 3 END AS g")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = neighbors._self_dealt(df, ["g"], 20)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # Only the group of more than 20 rows is in blocks; rows without a group meet nothing.
        assert {r.g for r in dealt.where("bj > 0").collect()} == {1} and dealt.where("g IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    group = {r.id: r.g for r in df.collect()}
    got = {(r.a, r.b) for r in neighbors.pairs_within(df, 0.5, 20, by=["g"]).collect()}
    assert got == {(r.a, r.b) for r in neighbors.pairs_within(df, 0.5).collect() if group[r.a] is not None and group[r.a] == group[r.b]}


def test_descent_sends_a_vector_to_a_group_once(spark, monkeypatch):
    """Not to each of the two lists' lengths of meetings; and lists grow with the rows, as recall falls with them."""
    assert neighbors.spare_entries(2000) == 20 and neighbors.spare_entries(100_000) > neighbors.spare_entries(10_000) > 20
    rng, sent = np.random.default_rng(5), []
    v = rng.normal(size=(700, 16))
    df = frame(spark, v / np.linalg.norm(v, axis=1, keepdims=True))
    meet, cogroup = neighbors._meet, type(df.groupBy("id")).cogroup
    monkeypatch.setattr(type(df.groupBy("id")), "cogroup", lambda links, vectors: sent.append(vectors._df.groupBy("id").count().agg({"count": "max"}).first()[0]) or cogroup(links, vectors))
    monkeypatch.setattr(neighbors, "LEAST_MEETINGS", 64)
    monkeypatch.setattr(neighbors, "_meet", lambda most: sent.append(most) or meet(most))
    exact = {(r.id, r.neighbor, r.dist) for r in neighbors.knn(df, df, 5).collect()}
    found = {(r.id, r.neighbor, r.dist) for r in neighbors.knn_descent(df, 5, start_rows=64).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.95 * len(exact)
    assert sent and max(sent) <= max(25, neighbors.GROUPS)


def test_threshold_counts_all_rows(spark, monkeypatch):
    """More rows than the sample of 5,000 that was the default."""
    seen, nearest = [], neighbors.nn_distance
    monkeypatch.setattr(neighbors, "nn_distance", lambda df: seen.append(df.count()) or nearest(df))
    neighbors.calibrate_threshold(frame(spark, points(5100, 40)), 0.5).collect()
    assert seen == [5100]


def test_pruned_rows_go_to_heaps(spark, monkeypatch):
    df = frame(spark, points(400, 8, noise=0.1))
    sent = []
    monkeypatch.setattr(pivots, "in_blocks", lambda dealt, *a: sent.append(dealt.count()) or neighbors.in_blocks(dealt, *a))
    got = {(r.a, r.b, r.dist) for r in pivots.pairs_within_pruned(df, 0.6, block_rows=4).collect()}
    # Blocks of four rows are a hundred or more; a row goes to a few heaps.
    assert sent[0] <= 400 * (pivots.HEAPS + 1)
    assert got == {(r.a, r.b, r.dist) for r in neighbors.pairs_within(df, 0.6).collect()}


def test_undo_chain_solves_projects_in_batches(spark):
    rows = [(p, k, "confirm" if k % 3 else "undo", [f"/{k}"]) for p in range(50) for k in range(12)]
    log = spark.createDataFrame(rows, "project long, seq long, op string, delete_paths array<string>").repartition(5)
    undone, left = decisions.match_undos(log, 3)
    got = {(r.project, r.seq, r.confirm) for r in undone.collect()}
    assert got == {(p, k, k - 1) for p in range(50) for k in (3, 6, 9)}
    assert {(r.project, r.confirm) for r in left.collect()} == {(p, k) for p in range(50) for k in (7, 10, 11)}
    # Many projects come back from one batch.
    pdf = spark.range(40).selectExpr("id AS project", "0 AS part", "0L AS seq", "5L AS entry").toPandas()
    out = list(decisions._chain(3, ["project", "part", "entry", "confirm"])(iter([pdf])))
    assert sum(map(len, out)) == 40 and len(out) <= 2


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    """Rounds don't pile up on disk until the driver collects its garbage, and nothing else is cleaned up."""
    was, other = spark.conf.get(common.CLEANUP), spark.range(500).repartition(3, "id").groupBy("id").count()
    assert len(other.collect()) == 500
    before = shuffle_files(spark)
    df = spark.range(300).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.materialize(df, "sizes")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 7 and spark.conf.get(common.CLEANUP) == was
    # What others have shuffled stays: the same plan runs again from it.
    assert len(other.collect()) == 500


def test_cleaning_ends_with_the_last_thread(spark):
    was = spark.conf.get(common.CLEANUP)
    one, two = common.cleaned_up(spark), common.cleaned_up(spark)
    one.__enter__(), two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(common.CLEANUP) == "true"
    two.__exit__(None, None, None)
    assert spark.conf.get(common.CLEANUP) == was


def test_recall_leaves_its_result_only(spark, sf_dir):
    folder = urlparse(common.shared_dir(spark)).path
    there = set(os.listdir(folder))
    got = {tuple(r) for r in queries.approximate_recall(spark, sf_dir).collect()}
    assert got == {("descent", True), ("planes", True)}
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - there] == ["recall"]


def test_queue_for_a_cluster_takes_no_rounds(spark, monkeypatch):
    """A cluster that takes one row after another: a round each, but in a task."""
    edges = spark.createDataFrame([(k, k + 1, 0.01 * (k + 1)) for k in range(12)], "a long, b long, dist double")
    written = []
    monkeypatch.setattr(graph_linkage, "materialize", lambda df, tag, own=graph_linkage.materialize: (written.append(tag), own(df, tag))[1])
    labels = lambda **options: {r.id: r.cluster for r in graph_linkage.cluster_graph(edges, 0.09, max_local=5, **options).collect()}
    got = labels()
    assert got == dict.fromkeys(range(9), 0) and "graph-pairs" not in written
    assert labels(finish_edges=0) == labels(finish_edges=7) == got


def test_heap_equals_rounds():
    rnd = np.random.default_rng(5)
    a, b = np.unique(np.sort(rnd.integers(0, 400, size=(3000, 2)), axis=1), axis=0).T
    a, b = a[a < b], b[a < b]
    rounds, heap, both = (graph_linkage.contract(a, b, rnd_dist, np.ones(len(a)), 0.5, least)[1] for rnd_dist in [rnd.random(len(a))] for least in (0, 1, 16))
    assert (heap == rounds).all() and (both == rounds).all() and 10 < len(set(rounds.tolist())) < 390


def test_large_components_beside_small_ones(spark, monkeypatch):
    monkeypatch.setattr(graph_linkage, "SMALL_EDGES", 3)
    rows = [(10 * p, 10 * p + k, 10 * p + k + 1, 0.1 * (k + 1), 1) for p in range(6) for k in range(2 + p)]
    edges = spark.createDataFrame(rows, "component long, a long, b long, total double, n long").coalesce(1)
    got = {r.id: r.cluster for r in graph_linkage._solved(edges, 0.45).collect()}
    assert got == {10 * p + k: 10 * p + (k if k > 4 else 0) for p in range(6) for k in range(3 + p)}


def test_remembered_neighbours_equal_looks(monkeypatch):
    """Vectors in groups, weighted, and many at equal distances; most of those whose neighbour merged needn't look again."""
    rng = np.random.default_rng(6)
    spread = points(1500, 60, seed=6, noise=0.6)
    even = np.unique(rng.integers(-1, 2, size=(1200, D)), axis=0).astype(float)
    even = even[(even != 0).any(axis=1)]
    even /= np.linalg.norm(even, axis=1, keepdims=True)
    cases = [(v, t, rng.integers(1, 4, len(v))) for v in (spread, even) for t in (0.1, 0.4, 0.9)]
    monkeypatch.setattr(linkage, "DIRECT", 10**9)
    direct = [linkage.merge_rounds(np.arange(len(v)), v, t, w) for v, t, w in cases]
    looked = []
    monkeypatch.setattr(linkage, "DIRECT", 20)
    monkeypatch.setattr(linkage, "MOST_ROWS", 300)
    monkeypatch.setattr(linkage, "LOOKING", 200)
    monkeypatch.setattr(linkage, "_nearest", lambda k, a, b, own, known=linkage._nearest: (looked.append(len(a[0]) * len(b[0])), known(k, a, b, own))[1])
    for listed in (1, 3, 12):
        monkeypatch.setattr(linkage, "LISTED", listed)
        looked.append(-1)
        for want, (v, t, w) in zip(direct, cases):
            assert (linkage.merge_rounds(np.arange(len(v)), v, t, w) == want).all()
    pairs = [sum(x for x in looked[a + 1 : b]) for starts in [[k for k, x in enumerate(looked) if x < 0] + [len(looked)]] for a, b in zip(starts, starts[1:])]
    assert pairs[2] < 0.8 * pairs[0]


def test_packed_vectors():
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]], pa.list_(pa.float32())), pa.array([1, 2, 3])], ["v", "id"])
    packed = pa.RecordBatch.from_arrays([runs.packed.func(batch.slice(1)["v"])], ["v"])
    assert packed.schema.field("v").type == pa.binary()
    assert np.array_equal(runs.columns_of(packed)["v"], [[3, np.nan], [5, 6]], equal_nan=True)
    with pytest.raises(ValueError):
        runs.columns_of(pa.RecordBatch.from_arrays([runs.packed.func(pa.array([[1.0], [1.0, 2.0]]))], ["v"]))


def test_meetings_hold_little_beside_what_comes_in():
    """Bytes for each row: before, 9,820 and 6,023."""
    rng, peaks = np.random.default_rng(4), []
    for n in (20_000, 40_000):
        v = rng.normal(size=(n, 16)).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        vectors = pa.table({"id": rng.permutation(n), "v": pa.ListArray.from_arrays(np.arange(0, n * 16 + 1, 16, dtype=np.int32), pa.array(v.ravel())), "bound": np.full(n, 0.9)})
        links = pa.table({"meet": np.arange(n * 10) % (n // 12), "part": np.zeros(n * 10, np.int32), "id": rng.integers(0, n, n * 10), "fresh": rng.random(n * 10) < 0.5})
        tracemalloc.start()
        found = neighbors._meet(12)(links, vectors)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        assert max(np.unique(found["id"].to_numpy(), return_counts=True)[1]) == 12
    assert max(peaks) < 4000, peaks
