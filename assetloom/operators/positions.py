"""Numbering rows in order, over whole tables or groups of any size, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import materialize


def with_position(df: DataFrame, order: list[str | Column], out: str = "position") -> DataFrame:
    """``df`` with 1, 2, ... in ``order``, which must leave no ties. The sorted table is written with the place of each row
    in its partition; what is added up in one window is one row per partition."""
    place = F.monotonically_increasing_id()
    rows = materialize(df.orderBy(*order).withColumn("__place", place), "sorted")
    part, inside = F.shiftright("__place", 33).alias("__part"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    numbered = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(out, F.col("__before") + inside + 1).drop("__part", "__place", "__before")


def with_rank(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """``df`` with 1, 2, ... in ``order`` inside each value of ``by``, of which one may have most of the rows."""
    placed = with_position(df, [by, *order], "__position")
    first = placed.groupBy(by).agg(F.min("__position").alias("__first"))
    return placed.join(first, by).withColumn(out, F.col("__position") - F.col("__first") + 1).drop("__position", "__first")
