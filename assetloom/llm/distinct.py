"""Repeated rows of a document table, reduced to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import split_possible
from assetloom.llm.rows import field, packed, unpacked


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id and text, columns unchanged; a null id is an id. Of rows that differ elsewhere the one stays whose
    other columns come first as JSON, so they may be of types without an order. Only rows that may be repeated are moved."""
    if not docs.columns:
        return docs
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    repeated = materialize(docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return docs
    several, single = (df.select("row") for df in split_possible(packed(docs, key=key), "key", repeated))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if not others:
        return unpacked(single).unionByName(unpacked(several).distinct())
    several = several.withColumn("others", F.struct(*[field(c).alias(c) for c in others]))
    least = several.groupBy(field(id_col).alias("id"), field(text_col).alias("text")).agg(F.min_by("others", F.to_json("others")).alias("least"))
    rows = least.select(*[F.col("id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col("least").getField(c).alias(c) for c in docs.columns])
    return unpacked(single).unionByName(rows)
