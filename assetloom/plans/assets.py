"""Assets, components, grids and regions as bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.common import load


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, path, captured_at, label, embedding, musiq, nima, laion_aes. A missing document gives 0.0 components,
    the fill of a failed metric; the clipiqa component is absent."""
    e, v, d = (load(spark, sf_dir, t) for t in ("embeddings", "events", "documents"))
    joined = e.join(v.select("event_id", "ts", "value"), e["vec_id"] == F.col("event_id"), "left").join(d.select("doc_id", "source", "n_chars", "text"), e["vec_id"] == F.col("doc_id"), "left")
    kinds = F.array(*[F.lit(x) for x in ("jpg", "JPG", "png", "txt")])
    path = F.concat(F.lit("/lib/"), F.coalesce("source", F.lit("none")), F.lit("/"), (F.col("vec_id") % 50).cast("string"), F.lit("."), F.element_at(kinds, (F.col("vec_id") % 4 + 1).cast("int")))
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return joined.select(
        F.col("vec_id").alias("asset_id"), path.alias("path"), F.when(F.col("vec_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("captured_at"), "label", "embedding",
        F.coalesce("value", F.lit(0e0)).alias("musiq"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0e0)).alias("nima"), F.coalesce(spaces.cast("double"), F.lit(0e0)).alias("laion_aes"),
    )


#: The same binding in SQL, for the queries compared with DuckDB.
ASSETS_SQL = """
assets AS (SELECT e.vec_id AS asset_id,
    '/lib/' || coalesce(d.source, 'none') || '/' || (e.vec_id % 50)::VARCHAR || '.' || (['jpg', 'JPG', 'png', 'txt'])[(e.vec_id % 4 + 1)::INTEGER] AS path,
    CASE WHEN e.vec_id % 7 <> 0 THEN v.ts END AS captured_at, e.label, e.embedding, coalesce(v.value, 0e0) AS musiq, coalesce(d.n_chars::DOUBLE, 0e0) AS nima,
    coalesce((length(d.text) - length(replace(d.text, ' ', '')))::DOUBLE, 0e0) AS laion_aes
  FROM embeddings e LEFT JOIN events v ON v.event_id = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id)
"""


def grids(asset_table: DataFrame) -> DataFrame:
    """(asset_id, luma): an 8 by 8 luma grid from the vector."""
    return asset_table.select("asset_id", F.transform("embedding", lambda v: F.least(F.lit(1e0), F.greatest(F.lit(0e0), 0.5e0 + 2e0 * v.cast("double")))).alias("luma"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, w, h, sharp, tie-break columns) from lineitem."""
    l = load(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("asset_id"), F.col("l_quantity").cast("int").alias("w"), F.col("l_linenumber").alias("h"), F.col("l_discount").alias("sharp"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
