"""Quality components: pixel statistics, normalisation over the whole table, weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Weights of the components in the score.
SCORE_WEIGHTS = {
    "musiq": 0.35,
    "nima": 0.25,
    "clipiqa+": 0.20,
    "laion_aes": 0.10,
    "sharpness": 0.10,
}
EXPOSURE_PENALTY_WEIGHT = 0.15
FACE_BONUS_WEIGHT = 0.10


def component_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (population) of every component."""
    return df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{p}_{c}") for c in names for p, f in (("mean", F.avg), ("std", F.stddev_pop))])


def part_moments(df: DataFrame, names: list[str], part: list[str] | None = None) -> DataFrame:
    """(part..., component, n, mean, m2) of every part's values that aren't null; m2 is the sum of squared distances from the
    mean. Written once for each part, as a part comes, these are all that ``moment_stats`` reads."""
    part = part or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"`{c}`").cast("double").alias("x")) for c in names]))
    x = df.select(*part, pairs.alias("p")).select(*part, "p.*").where("x is not null")
    moments = x.groupBy(*part, "component").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    return moments.select(*part, "component", "n", "mean", (F.col("var") * F.col("n")).alias("m2"))


def combine_moments(moments: DataFrame) -> DataFrame:
    """(component, n, mean, m2) of all parts together. The squares are taken from the common mean, in a second pass over the
    parts' rows, as they would cancel out otherwise."""
    n, share = F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean"))
    whole = moments.groupBy("component").agg(n, (share / F.sum("n")).alias("mean")).where("n > 0")
    off = F.col("p.mean") - F.col("w.mean")
    m2 = moments.alias("p").join(whole.alias("w"), "component").groupBy("component").agg(F.sum(F.col("p.m2") + F.col("p.n") * off * off).alias("m2"))
    return whole.join(m2, "component").select("component", "n", "mean", "m2")


def without_moments(moments: DataFrame, gone: DataFrame) -> DataFrame:
    """``moments`` (part..., component, n, mean, m2) without those of removed rows, given by the same columns: neither the
    rows that stay nor those of other parts are read again."""
    keys = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    left = gone.select(*keys, F.col("n").alias("gone_n"), F.col("mean").alias("gone_mean"), F.col("m2").alias("gone_m2"))
    joined = moments.join(left, keys, "left")
    n = F.col("n") - F.col("gone_n")
    mean = (F.col("n") * F.col("mean") - F.col("gone_n") * F.col("gone_mean")) / n
    off = F.col("gone_mean") - mean
    m2 = F.col("m2") - F.col("gone_m2") - F.col("gone_n") * n / F.col("n") * off * off
    untouched = F.col("gone_n").isNull()
    pick = lambda c, new: F.when(untouched, F.col(c)).otherwise(new).alias(c)
    return joined.where(untouched | (n > 0)).select(*keys, pick("n", n), pick("mean", mean), pick("m2", F.greatest(m2, F.lit(0e0))))


def moment_stats(moments: DataFrame, names: list[str]) -> DataFrame:
    """As ``component_stats``, from the moments of parts."""
    whole = combine_moments(moments)
    at = lambda c, v: F.max(F.when(F.col("component") == c, v))
    return whole.agg(*[at(c, v).alias(f"{p}_{c}") for c in names for p, v in (("mean", F.col("mean")), ("std", F.sqrt(F.col("m2") / F.col("n"))))])


def component_norm(df: DataFrame, names: list[str], stats: DataFrame | None = None) -> DataFrame:
    """``df`` with norm_<c>: the sigmoid of the z-score, 0.0 where the spread is below 1e-6. The statistics are one row: those
    of ``df``, or ``stats`` where they are kept (``moment_stats``)."""

    def norm(c: str) -> Column:
        z = (F.col(f"`{c}`").cast("double") - F.col(f"`mean_{c}`")) / F.col(f"`std_{c}`")
        return F.when(F.col(f"`std_{c}`") < 1e-6, 0e0).otherwise(1e0 / (1e0 + F.exp(-z)))

    out = df.crossJoin(F.broadcast(component_stats(df, names) if stats is None else stats))
    for c in names:
        out = out.withColumn(f"norm_{c}", norm(c))
    return out.drop(*[f"{p}_{c}" for c in names for p in ("mean", "std")])


def ensemble_score(df: DataFrame, names: list[str] | None = None, weights: dict[str, float] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``df`` with norm_<c> and score: the weighted mean of the components present, minus the exposure penalty, plus the
    region bonus, where those columns exist. ``stats`` as in ``component_norm``."""
    weights = weights or SCORE_WEIGHTS
    present = names if names is not None else [c for c in [*weights, "exposure_penalty", "face_bonus"] if c in df.columns]
    out = component_norm(df, present, stats)
    main = [c for c in weights if c in present]
    total = sum(weights[c] for c in main)
    score = reduce(lambda a, c: a + F.lit(weights[c]) * F.col(f"`norm_{c}`"), main, F.lit(0e0)) / F.lit(total if total > 0 else 1e0)
    if "exposure_penalty" in present:
        score = score - F.lit(EXPOSURE_PENALTY_WEIGHT) * F.col("norm_exposure_penalty")
    if "face_bonus" in present:
        score = score + F.lit(FACE_BONUS_WEIGHT) * F.col("norm_face_bonus")
    return out.withColumn("score", score)


def exposure_penalty(luma: Column) -> Column:
    """Over- and underexposure of a luma grid in [0, 1], between 0 and 1."""
    n = F.size(luma).cast("double")
    mean = F.aggregate(luma, F.lit(0e0), lambda a, x: a + x) / n
    dark, bright = F.size(F.filter(luma, lambda x: x < 0.02e0)) / n, F.size(F.filter(luma, lambda x: x > 0.98e0)) / n
    return F.least(F.lit(1e0), 0.4e0 * (F.abs(mean - 0.5e0) * 2e0) + 3e0 * dark + 3e0 * bright)


def laplacian_sharpness(luma: Column, width: Column | int) -> Column:
    """Sample variance of the 4-neighbour Laplacian of a grid stored row by row, zero outside."""
    w = F.lit(width) if isinstance(width, int) else width
    n = F.size(luma)
    at = lambda ok, k: F.when(ok, F.coalesce(F.get(luma, k), F.lit(0e0))).otherwise(0e0)
    lap = F.transform(luma, lambda v, i: at(i % w > 0, i - 1) + at(i % w < w - 1, i + 1) + at(i >= w, i - w) + at(i + w < n, i + w) - 4e0 * v)
    mean = F.aggregate(lap, F.lit(0e0), lambda a, x: a + x) / n
    return F.transform(F.array(mean), lambda m: F.aggregate(lap, F.lit(0e0), lambda a, x: a + (x - m) * (x - m)))[0] / (n - 1)


def region_bonus(assets: DataFrame, regions: DataFrame, ties: list[str], grid_area: float, min_share: float = 0.002) -> DataFrame:
    """(asset_id, face_bonus): from the largest region of each asset; 0 without one or if it is too small."""
    area = F.col("w") * F.col("h")
    largest = regions.groupBy("asset_id").agg(F.min_by(F.struct(area.alias("area"), "sharp"), F.struct(-area, *ties)).alias("r"))
    bonus = F.when(F.col("r.area") / F.lit(grid_area) < min_share, 0e0).otherwise(1e0 - F.exp(-50e0 * F.col("r.sharp")))
    return assets.select("asset_id").join(largest, "asset_id", "left").select("asset_id", F.coalesce(bonus, F.lit(0e0)).alias("face_bonus"))
