"""Curation operators on the small results fixture."""

import random

import pytest
from pyspark.sql import functions as F

from assetloom.operators import decisions as D, export as X, incremental as I, ranking as R
from assetloom.operators.positions import with_position, with_rank
from assetloom.sources import media as S, sinks as K

ROWS = [
    (1, "c1_a.JPG", 0.72, 0.98, 1), (1, "c1_b.JPG", 0.61, 0.97, 2), (1, "c1_c.JPG", 0.45, 0.96, 3), (2, "c2_a.JPG", 0.68, 0.99, 1), (2, "c2_b.JPG", 0.52, 0.95, 2), (3, "s3.JPG", 0.30, 1.0, 1), (4, "s4.JPG", 0.65, 1.0, 1),
]


@pytest.fixture
def images(spark):
    return spark.createDataFrame(ROWS, "cluster_id long, path string, score double, centrality double, rank int").withColumn("cluster_score", F.max("score").over(D.W.partitionBy("cluster_id")))


def paths(df):
    return sorted(r.path for r in df.collect())


def listed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_counts(spark, images):
    assert D.state_summary(images, listed(spark)).first()[:3] == (2, 2, 0)
    assert images.transform(D.cluster_split).where("is_multi").count() == 5


def test_confirm_and_rerank(spark, images):
    marked = D.default_keeps(images).where("cluster_id = 1 and not keep").select("path")
    assert paths(marked) == ["c1_b.JPG", "c1_c.JPG"]
    results, pending = D.confirm_batch(images, listed(spark), marked)
    assert paths(pending) == ["c1_b.JPG", "c1_c.JPG"]
    assert D.state_summary(results, pending).first()[:3] == (1, 3, 2)
    assert paths(D.pending_remove(pending, listed(spark, "c1_b.JPG"))) == ["c1_c.JPG"]


def test_rerank_keeps_stale_score(spark, images):
    out = {r.path: r for r in R.rerank_after_removal(images, listed(spark, "c1_a.JPG", "s3.JPG")).collect()}
    assert out["c1_b.JPG"].rank == 1 and out["c1_b.JPG"].cluster_score == 0.72 and out["c1_c.JPG"].best_image == "c1_b.JPG" and "s3.JPG" not in out


@pytest.mark.parametrize("threshold, n", [(0.4, 1), (0.99, 2), (0.0, 0)])
def test_singles(images, threshold, n):
    singles = D.cluster_split(images).where("not is_multi")
    assert D.singleton_decisions(singles, threshold).where("not keep").count() == n


def test_toggles(spark, images):
    toggled = D.toggle_overrides(D.default_keeps(images.where("cluster_id = 1")), spark.createDataFrame([("c1_a.JPG", 1), ("c1_b.JPG", 2)], "path string, n_toggles int"))
    assert toggled.where("not keep").count() == 3


def test_pending_lists(spark):
    got = D.pending_append(listed(spark, "a", "b"), listed(spark, "b", "c", "c"))
    assert paths(got) == ["a", "b", "c", "c"]
    assert S.read_pending(spark, "/tmp/none/such").count() == 0


def test_undo(spark):
    log = [(1, 1, "confirm", ["a", "b"]), (1, 2, "confirm", ["c"]), (1, 3, "undo", None), (1, 4, "restore", ["a"]), (2, 1, "undo", None), (2, 2, "confirm", ["z"])]
    out = D.undo_fold(spark.createDataFrame(log, "project long, seq long, op string, delete_paths array<string>"))
    assert sorted(map(tuple, out.collect())) == [(1, "b"), (2, "z")]
    deep = [(1, k, "confirm", [str(k)]) for k in range(12)] + [(1, 20 + k, "undo", None) for k in range(12)]
    out = D.undo_fold(spark.createDataFrame(deep, "project long, seq long, op string, delete_paths array<string>"))
    assert sorted(r.path for r in out.collect()) == ["0", "1"]


LOG = "project long, seq long, op string, delete_paths array<string>, all_paths array<string>"


def test_undo_restores_results(spark, images):
    """The fixture's session: confirm, undo, confirm again; a confirm of nothing leaves no entry."""
    log = [(1, 1, "confirm", ["c1_b.JPG", "c1_c.JPG"], []), (1, 2, "confirm", [], []), (1, 3, "undo", None, None)]
    df = spark.createDataFrame(log, LOG)
    assert D.undo_fold(df).count() == 0 and paths(D.results_after(images, df)) == sorted(r[1] for r in ROWS)
    undone, stack = D.match_undos(df)
    assert [tuple(r) for r in undone.collect()] == [(1, 3, 1)] and not D.state_summary(images, listed(spark), stack=stack).first().undo_available
    df = spark.createDataFrame([*log, (1, 4, "confirm", ["c1_b.JPG"], ["c1_a.JPG", "c1_b.JPG"]), (1, 5, "restore", ["c1_b.JPG"], None)], LOG)
    left = D.results_after(images, df)
    assert "c1_a.JPG" not in paths(left) and "c1_b.JPG" not in paths(left) and D.undo_fold(df).count() == 0
    assert D.state_summary(left, listed(spark), stack=D.match_undos(df)[1]).first().undo_available


def test_undo_over_parts(spark):
    """Logs long enough to be walked in several parts, against a plain stack."""
    rnd = random.Random(4)
    log = [(p, s, rnd.choice(["confirm", "confirm", "undo", "undo", "restore"]), [f"p{rnd.randrange(30)}"], None) for p, n in ((1, 4000), (2, 300), (3, 5)) for s in range(n)]
    want, stacks = set(), {}
    for p in (1, 2, 3):
        pending, stack = {}, []
        for _, s, op, own, _ in (r for r in log if r[0] == p):
            if op == "confirm":
                pending |= dict.fromkeys(own)
                stack = [*stack, own][-10:]
            elif op == "restore" or stack:
                for x in own if op == "restore" else stack.pop():
                    pending.pop(x, None)
        want |= {(p, x) for x in pending}
        stacks[p] = len(stack)
    rnd.shuffle(log)
    df = spark.createDataFrame(log, LOG)
    assert {tuple(r) for r in D.undo_fold(df).collect()} == want
    assert {r[0]: r[1] for r in D.match_undos(df)[1].groupBy("project").count().collect()} == {p: n for p, n in stacks.items() if n}


def test_confirm_without_all_paths(spark, images):
    results, pending = D.confirm_batch(images, listed(spark), listed(spark, "s3.JPG"), listed(spark))
    assert "s3.JPG" not in paths(results) and paths(pending) == ["s3.JPG"]
    results, pending = D.confirm_batch(images, listed(spark, "x"), listed(spark), listed(spark))
    assert paths(results) == sorted(r[1] for r in ROWS) and paths(pending) == ["x"]
    assert D.change_counts(listed(spark, "a", "b", "b"), listed(spark, "b", "c", "c"), listed(spark, "b", "z")).first() == (2, 2)


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    assert all(r.position == r.x + 1 for r in with_position(df, ["x"]).collect())
    hot = sorted((r.x, r.k) for r in with_rank(df, "g", ["x"], "k").where("g = 'hot'").collect())
    assert [k for _, k in hot] == list(range(1, 335))
    assert with_position(df.where("false"), ["x"]).count() == 0


def test_list_readers(spark, tmp_path):
    (tmp_path / "pending.txt").write_text(" a \n\nb\n")
    (tmp_path / "curation.json").write_text('{"deleted": ["x", "y"]}')
    at = lambda name: f"file://{tmp_path}/{name}"
    assert paths(S.read_pending(spark, at("pending.txt"))) == [" a ", "b"] and paths(S.read_pending(spark, at("pending.txt"), strip=True)) == ["a", "b"]
    assert paths(S.read_deleted(spark, at("curation.json"), at("pending.txt"))) == ["x", "y"]
    assert paths(S.read_deleted(spark, None, at("pending.txt"))) == ["a", "b"] and S.read_deleted(spark, None, None).count() == 0
    K.write_paths(listed(spark, "k", "l"), at("out"))
    assert sorted(r.value for r in spark.read.text(at("out")).collect()) == ["k", "l"]
    K.write_clusters(spark.createDataFrame([(1, 5), (1, 4), (2, 6)], "cluster_id long, asset_id long"), at("clusters"))
    assert {r.cluster_id: r.members for r in spark.read.json(at("clusters")).collect()} == {1: [4, 5], 2: [6]}


def test_export_names(spark):
    rows = [("/x/a.jpg", 1), ("/y/a.jpg", 2), ("/z/a_1.jpg", 3), ("/w/a.jpg", 4), ("/v/.hid", 5), ("/u/.hid", 6), ("/t/b", 7)]
    taken = spark.createDataFrame([("b",)], "name string")
    got = {r.path: r.dest for r in X.export_plan(spark.createDataFrame(rows, "path string, seq long"), taken).collect()}
    assert got["/x/a.jpg"] == "a.jpg" and got["/z/a_1.jpg"] == "a_1.jpg" and got["/t/b"] == "b_1" and got["/u/.hid"] == ".hid_1"
    assert len(set(got.values())) == 7 and {got["/y/a.jpg"], got["/w/a.jpg"]} <= {"a_2.jpg", "a_3.jpg", "a_4.jpg"}


def test_delete_plan(spark):
    listing = spark.createDataFrame([("/r/a.x", 1), ("/rr/a.x", 2), ("/r/b", 3), ("/r/s/a.x", 4)], "path string, seq long")
    plan = X.delete_plan(listing, listed(spark, "/r/a.x", "/rr/a.x", "/r/s/a.x"), "/r", spark.createDataFrame([("a_1.x",)], "name string"))
    assert {r.path: (r.status, r.dest) for r in plan.collect()} == {"/r/a.x": ("would_move", "a.x"), "/rr/a.x": ("outside_root", None), "/r/b": ("missing", None), "/r/s/a.x": ("would_move", "a_2.x")}
    assert X.delete_summary(plan).first() == (2, 2)


def test_refresh(spark):
    calls = []

    def compute(df):
        calls.append(1)
        return df.select("path", F.length("path").alias("x"))

    cache = spark.createDataFrame([("a", 100), ("gone", 7)], "path string, x int")
    current = listed(spark, "a", "bb")
    assert sorted(map(tuple, I.refresh(current, cache, compute).collect())) == [("a", 100), ("bb", 2)]
    assert sorted(map(tuple, I.refresh(current, cache, compute, strict=True).collect())) == [("a", 1), ("bb", 2)]
    assert sorted(map(tuple, I.refresh(current, cache.withColumnRenamed("x", "y"), compute).collect())) == [("a", 1), ("bb", 2)]
    assert I.inventory_drift(None, current) == "never_run" and I.inventory_drift(current, current) == "ready" and I.inventory_drift(cache, current) == "stale"


def test_results_round_trip(spark, images, tmp_path):
    out = f"file://{tmp_path}/results"
    K.write_results(images.withColumn("captured_at", F.when(F.col("rank") == 1, F.timestamp_seconds(F.lit(5)))), out)
    back = S.read_results(spark, out, lines=True)
    assert sorted((r.cluster_id, r.path, r.rank) for r in back.collect()) == sorted((r[0], r[1], r[4]) for r in ROWS)
    assert back.where("exif_timestamp is null").count() == 3
    text = spark.read.text(out).first()[0]
    assert "null" not in text
    K.write_version(images, f"file://{tmp_path}/table")
    assert K.read_version(spark, f"file://{tmp_path}/table").count() == 7


def test_ensemble_quirks(spark):
    from assetloom.operators.quality import component_norm, ensemble_score

    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "asset_id long, musiq double, sharpness double")
    norm = {r.asset_id: (r.norm_musiq, r.norm_sharpness) for r in component_norm(df, ["musiq", "sharpness"]).collect()}
    assert norm[1][0] == pytest.approx(0.2689414, abs=1e-6) and norm[1][1] == 0.0
    scores = {r.asset_id: r.score for r in ensemble_score(df).collect()}
    assert scores[2] == pytest.approx(0.35 * 0.7310586 / 0.45, abs=1e-6)
