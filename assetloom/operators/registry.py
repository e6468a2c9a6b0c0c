"""Project registry: upserts, recents and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from assetloom.functions.paths import basename


def recents_upsert(entries: DataFrame) -> DataFrame:
    """One row per folder from a history (folder, opened, ran, image_count): last_opened is the latest opening,
    last_pipeline_run and image_count those of the latest opening in which the pipeline ran; a folder whose pipeline
    never ran has no run and the count of its first opening."""
    ran = F.when(F.col("ran"), F.col("opened"))
    out = entries.groupBy("folder").agg(F.max("opened").alias("last_opened"), F.max(ran).alias("last_pipeline_run"), F.max_by("image_count", ran).alias("__ran"), F.min_by("image_count", "opened").alias("__first"))
    return out.select("folder", "last_opened", "last_pipeline_run", F.coalesce("__ran", "__first").alias("image_count"))


def recents_top(registry: DataFrame, k: int = 20) -> DataFrame:
    """The k folders opened last."""
    return registry.orderBy(F.desc("last_opened"), "folder").limit(k)


def project_status(registry: DataFrame, drift: DataFrame, existing: DataFrame, running: DataFrame) -> DataFrame:
    """``registry`` with display_name and status: running before a missing folder (never_run) before its drift.
    drift: (folder, status); existing, running: (folder)."""
    mark = lambda df, name: df.select("folder").distinct().withColumn(name, F.lit(True))
    joined = registry.join(mark(existing, "__there"), "folder", "left").join(mark(running, "__runs"), "folder", "left").join(drift.select("folder", F.col("status").alias("__drift")), "folder", "left")
    status = F.when(F.col("__runs"), "running").when(F.col("__there").isNull(), "never_run").otherwise(F.coalesce("__drift", F.lit("never_run")))
    return joined.select(*registry.columns, basename(F.col("folder")).alias("display_name"), status.alias("status"))
