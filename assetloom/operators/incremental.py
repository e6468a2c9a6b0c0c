"""Incremental refresh of per-asset tables keyed by path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize


def incremental_split(current: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, status): cached, new or removed."""
    a, b = current.select("path").distinct().withColumn("here", F.lit(True)), cache.select("path").distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "new").otherwise("cached")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def refresh(current: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame], strict: bool = False) -> DataFrame:
    """The table ``compute`` makes of ``current``, taken from ``cache`` where a path is known. A cache with other columns
    is not used; with ``strict`` neither is one that knows paths which are gone. ``compute`` keeps path."""
    if cache is None:
        return compute(current)
    fresh = compute(current.join(cache.select("path"), "path", "left_anti"))
    if set(fresh.columns) != set(cache.columns) or (strict and not is_subset(cache, current)):
        return compute(current)
    return cache.join(current.select("path"), "path", "left_semi").select(*fresh.columns).unionByName(fresh)


def path_prints(paths: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """(bucket, n, p0, p1, p2, p3): counts and sums of hashes of the paths in each bucket of their hashes, in any order: equal for
    equal lists. One pass, and at most ``buckets`` rows, which may be kept beside a list."""
    one, two = F.xxhash64("path"), F.xxhash64(F.lit(1), "path")
    low, high = (lambda h: h.bitwiseAND(F.lit((1 << 32) - 1))), (lambda h: F.shiftrightunsigned(h, 32))
    sums = [F.sum(part(h)).alias(f"p{2 * k + j}") for k, h in enumerate((one, two)) for j, part in enumerate((low, high))]
    return paths.groupBy(_bucket(buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), "path"), F.lit(buckets)).cast("int")


def changed_buckets(current: DataFrame, before: DataFrame) -> DataFrame:
    """(bucket) of two tables of prints that differ: at most as many rows as there are buckets."""
    sums = ["n", "p0", "p1", "p2", "p3"]
    both = current.select("bucket", F.struct(*sums).alias("a")).join(before.select("bucket", F.struct(*sums).alias("b")), "bucket", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def drift_split(current: DataFrame, before: DataFrame, prints: DataFrame | None = None, buckets: int = 1 << 14) -> DataFrame:
    """As ``incremental_split`` of two lists without repeats, and without moving them: (path, status). Only paths of buckets
    whose prints differ are joined, so what is shuffled follows the change. ``prints``: those of ``before``, where kept."""
    changed = materialize(changed_buckets(path_prints(current, buckets), path_prints(before, buckets) if prints is None else prints), "drift")
    at = lambda df, how: df.select("path", _bucket(buckets).alias("bucket")).join(F.broadcast(changed), "bucket", how).select("path")
    return at(current, "left_anti").withColumn("status", F.lit("cached")).unionByName(incremental_split(at(current, "left_semi"), at(before, "left_semi")))


def drift_status(processed: DataFrame, current: DataFrame, prints: DataFrame | None = None, buckets: int = 1 << 14) -> DataFrame:
    """One row (status): ready if both hold the same paths, else stale. Lists with repeats of a path may have other prints
    and yet be the same set, so buckets that differ are joined."""
    split = drift_split(current, processed, prints, buckets)
    changed = split.agg(F.count_if(F.col("status") != "cached").alias("n"))
    return changed.select(F.when(F.col("n") > 0, "stale").otherwise("ready").alias("status"))


def is_subset(few: DataFrame, many: DataFrame) -> bool:
    """Whether every path of ``few`` is in ``many``."""
    return drift_split(many, few).where("status = 'removed'").isEmpty()


def inventory_drift(processed: DataFrame | None, current: DataFrame) -> str:
    """ready if both hold the same paths, stale if not, never_run without a processed list."""
    return "never_run" if processed is None else drift_status(processed, current).first().status
