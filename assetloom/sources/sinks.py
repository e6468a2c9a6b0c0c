"""Sinks: versioned tables, cluster and result documents, path lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.common import children, delete, exists
from assetloom.operators.ranking import results_nested


def _versions(spark: SparkSession, base: str) -> list[str]:
    """The folders of a table's versions, oldest first: they are named by a number that counts up."""
    return sorted(name for name in children(spark, base) if name.startswith("version="))


def write_version(df: DataFrame, base: str) -> str:
    """Writes a new version of a table below ``base`` and returns its folder; readers of older ones aren't disturbed. Two
    writers at once make two versions, of which one is the later."""
    known = _versions(df.sparkSession, base)
    number = int(known[-1].split("=")[1].split("-")[0]) + 1 if known else 0
    path = f"{base.rstrip('/')}/version={number:010d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest version that was written to its end; None without one."""
    for name in reversed(_versions(spark, base)):
        path = f"{base.rstrip('/')}/{name}"
        if exists(spark, f"{path}/_SUCCESS"):
            return path
    return None


def read_version(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest whole version of a table; None without one."""
    path = latest_version(spark, base)
    return None if path is None else spark.read.parquet(path)


def drop_versions(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Deletes all versions older than the newest ``keep`` whole ones, and returns how many. Whoever still reads them loses them."""
    names = _versions(spark, base)
    whole = [n for n in names if exists(spark, f"{base.rstrip('/')}/{n}/_SUCCESS")]
    old = [n for n in names if whole[-keep:] and n < whole[-keep:][0]]
    for name in old:
        delete(spark, f"{base.rstrip('/')}/{name}")
    return len(old)


def cluster_members(df: DataFrame, cluster: str = "cluster_id", id_col: str = "asset_id") -> DataFrame:
    """(cluster, members): sorted ids."""
    return df.groupBy(cluster).agg(F.sort_array(F.collect_list(id_col)).alias("members"))


def write_clusters(df: DataFrame, path: str) -> None:
    cluster_members(df).write.mode("overwrite").json(path)


def write_results(ranked: DataFrame, path: str, components: list[str] | None = None) -> None:
    """One JSON line per document of one cluster; null fields are left out."""
    nested = results_nested(ranked, components).select("schema_version", F.array(F.struct("cluster_id", "cluster_score", "best_image", "images")).alias("clusters"))
    nested.select(F.to_json(F.struct("schema_version", "clusters")).alias("value")).write.mode("overwrite").text(path)


def write_paths(paths: DataFrame, path: str) -> None:
    """One path per line."""
    paths.select("path").write.mode("overwrite").text(path)
