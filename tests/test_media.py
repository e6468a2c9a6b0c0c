"""Files: listings, pixels, model hooks, the streaming refresh."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.functions.paths import is_inside
from assetloom.operators.model_hooks import embed, pixel_metric, score_metrics, unavailable_metrics
from assetloom.operators.quality import exposure_penalty, laplacian_sharpness
from assetloom.sources import media as S
from assetloom.streaming.refresh import read_target, refresh_stream


def png(path, grid):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = grid.shape
    raw = b"".join(b"\0" + row.tobytes() for row in grid.astype(np.uint8))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    grid = np.random.default_rng(1).integers(0, 256, (8, 8, 3))
    png(tmp_path / "a.png", grid)
    png(tmp_path / "sub" / "B.PNG", np.full((8, 8, 3), 255))
    (tmp_path / "bad.jpg").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path, grid


def test_listing(spark, folder):
    files = S.list_files(spark, f"file://{folder[0]}")
    assert sorted(r.path.rsplit("/", 1)[1] for r in S.media_inventory(files).collect()) == ["B.PNG", "a.png", "bad.jpg"]
    with pytest.raises(ValueError):
        S.media_inventory(files.where("path like '%.txt'"), required=True)


def test_pixels(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.read_pixels(spark, f"file://{folder[0]}").where("path not like '%.txt'").withColumns({"p": exposure_penalty(F.col("luma")), "s": laplacian_sharpness(F.col("luma"), F.col("width"))}).collect()}
    assert rows["bad.jpg"].luma is None
    assert rows["B.PNG"].p == pytest.approx(1.0)
    x = folder[1].astype(float) / 255
    luma = 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
    pad = np.pad(luma, 1)
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * luma
    assert rows["a.png"].s == pytest.approx(lap.var(ddof=1), abs=1e-6)


def test_hooks(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "id long, x array<double>")

    def make():
        return lambda batch: batch * 2

    out = {r.id: r.embedding for r in embed(df, "x", make, input_shape=[2]).collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and out[2] == [0.0, 0.0]
    both = embed(df.withColumn("y", F.reverse("x")), "x", make, flipped_col="y", input_shape=[2])
    assert both.columns == ["id", "x", "y", "embedding"] and {r.id: r.embedding for r in both.collect()}[1] == pytest.approx([0.5**0.5, 0.5**0.5])

    def total():
        def score(batch):
            if any(v[0] < 0 for v in batch):
                raise ValueError
            return np.array([sum(v) for v in batch])

        return score

    def broken():
        raise RuntimeError

    got = score_metrics(df, "x", {"total": total, "broken": broken})
    assert [tuple(r) for r in unavailable_metrics(spark, {"total": total, "broken": broken}).collect()] == [("broken", "RuntimeError: ")]
    grids = df.select("id", pixel_metric(F.when(F.col("id") < 3, F.col("x")), lambda g: float(1 / g.max())).alias("m"))
    assert {r.id: r.m for r in grids.collect()} == {1: 0.25, 2: float("inf"), 3: 0.0}
    assert "broken" not in got.columns and {r.id: r.total for r in got.collect()} == {1: 7.0, 2: 0.0, 3: 0.0}


def test_containment(spark):
    df = spark.createDataFrame([("/a/b",), ("/a",), ("/ab/c",)], "p string").select("p", is_inside(F.col("p"), "/a/").alias("i"))
    assert {r.p: r.i for r in df.collect()} == {"/a/b": True, "/a": True, "/ab/c": False}


def test_streaming_refresh(spark, tmp_path):
    source, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    add = lambda *p: spark.createDataFrame([(x,) for x in p], "path string").coalesce(1).write.mode("append").parquet(source)
    compute = lambda df: df.withColumn("n", F.length("path"))
    add("a", "bb")
    refresh_stream(spark, source, "path string", target, check, compute).awaitTermination()
    add("bb", "ccc")
    refresh_stream(spark, source, "path string", target, check, compute).awaitTermination()
    assert sorted((r.path, r.n) for r in read_target(spark, target).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]
    # Another checkpoint sees all files again, and neither repeats nor overwrites what is there.
    refresh_stream(spark, source, "path string", target, f"{check}2", compute).awaitTermination()
    assert sorted((r.path, r.n) for r in read_target(spark, target).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]
