"""Ranking inside clusters: centroids, centrality, ranks, summaries, nested results, re-ranking."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from assetloom.functions.vectors import dot, norm, scaled
from assetloom.operators.positions import with_position


def mean_vectors(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mean) of the vectors of each group. Partial sums combine before the shuffle."""
    v = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(v)).alias("mean"))


def cluster_centroid(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, centroid): the mean vector over max(its norm, 1e-8)."""
    length = F.greatest(norm(F.col("mean")), F.lit(1e-8))
    return mean_vectors(df, [cluster]).select(cluster, scaled(F.col("mean"), length).alias("centroid"))


def centrality(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``df`` with centrality: inner product with the cluster's centroid. Clusters are few rows against their members."""
    return df.join(cluster_centroid(df, cluster), cluster).withColumn("centrality", dot(F.col("embedding"), F.col("centroid"))).drop("centroid")


def rank_in_cluster(df: DataFrame, cluster: str = "cluster_id", ties: tuple[str, ...] = ("path", "asset_id")) -> DataFrame:
    """``df`` with rank: score, then centrality, both descending and unrounded, then path order."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), F.desc("centrality"), *ties)))


def cluster_summary(ranked: DataFrame) -> DataFrame:
    """(cluster_id, cluster_score, best_image, n_images)."""
    best = F.struct(F.col("rank"))
    return ranked.groupBy("cluster_id").agg(F.round(F.max("score"), 4).alias("cluster_score"), F.min_by("path", best).alias("best_image"), F.count(F.lit(1)).alias("n_images"))


def cluster_order(summary: DataFrame) -> DataFrame:
    """Adds position: best cluster first, then by id."""
    return with_position(summary, [F.desc("cluster_score"), "cluster_id"])


def top_k(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The first k of each cluster."""
    return ranked.where(F.col("rank") <= k)


def results_nested(ranked: DataFrame, components: list[str] | None = None) -> DataFrame:
    """One row per cluster with its images in rank order; to_json leaves null fields out."""
    comps = F.map_from_arrays(F.array(*[F.lit(c) for c in components]), F.array(*[F.round(F.col(f"`{c}`"), 4) for c in components])) if components else F.lit(None).cast("map<string,double>")
    taken = F.round(F.col("captured_at").cast("double"), 4) if "captured_at" in ranked.columns else F.lit(None).cast("double")
    image = F.struct("rank", "path", F.round("score", 4).alias("score"), F.round("centrality", 4).alias("centrality"), taken.alias("exif_timestamp"), comps.alias("score_components"))
    # Maps can't be sorted: images are ordered by a comparator on the rank.
    images = F.array_sort(F.collect_list(image), lambda a, b: (a["rank"] - b["rank"]).cast("int"))
    out = ranked.groupBy("cluster_id").agg(F.round(F.max("score"), 4).alias("cluster_score"), images.alias("images"))
    return out.select(F.lit(1).alias("schema_version"), "cluster_id", "cluster_score", F.col("images")[0]["path"].alias("best_image"), "images")


def rerank_after_removal(results: DataFrame, removed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Results (by..., cluster_id, cluster_score, path, score, rank) without the ``removed`` (by..., path): rank by score,
    ties in the old order; best_image is the first that stays in list order; cluster_score is left as it was; clusters
    without images are gone."""
    by = by or []
    left = results.join(removed.select(*by, "path").distinct(), [*by, "path"], "left_anti")
    cluster = W.partitionBy(*by, "cluster_id")
    new, first = F.row_number().over(cluster.orderBy(F.desc("score"), "rank")), F.first("path").over(cluster.orderBy("rank"))
    return left.select(*by, "cluster_id", "cluster_score", "path", "score", new.alias("new_rank"), first.alias("best_image")).withColumnRenamed("new_rank", "rank")
