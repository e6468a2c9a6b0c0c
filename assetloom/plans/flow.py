"""The whole dataflow: vectors and times to clusters, components to scores, scores to ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetloom.common import materialize
from assetloom.operators.linkage import two_stage
from assetloom.operators.neighbors import calibrate_threshold
from assetloom.operators.quality import ensemble_score
from assetloom.operators.ranking import centrality, rank_in_cluster
from assetloom.operators.temporal import burst_merge, gap_split


def cluster_assets(assets: DataFrame, tight: float = 0.08, loose: float | None = 0.22, burst_window_s: float = 3.0, max_gap_s: float = 3600.0, **options) -> DataFrame:
    """``assets`` with parent, sub, merged, split and cluster_id (smallest asset of the final cluster). Without ``loose``
    the threshold is calibrated on the nearest-neighbour distances."""
    if loose is None:
        loose = calibrate_threshold(assets.select(F.col("asset_id").alias("id"), F.col("embedding").alias("v")), 0.22).first()[0]
    staged = materialize(two_stage(assets, tight, loose, **options), "flow-two-stage")
    split = gap_split(burst_merge(staged, burst_window_s), "merged", max_gap_s)
    names = split.groupBy("merged", "split").agg(F.min("asset_id").alias("cluster_id"))
    return split.join(names, ["merged", "split"])


def ranked_assets(clustered: DataFrame) -> DataFrame:
    """Scores over the whole table, centrality and rank inside each cluster_id."""
    return rank_in_cluster(centrality(ensemble_score(clustered)))
