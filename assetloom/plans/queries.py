"""Queries of the curation operators over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from assetloom.common import Scratch, load, materialize, shared_dir
from assetloom.functions import paths as P, vectors as V
from assetloom.operators import decisions as D, export as X, incremental as I, linkage as L, model_hooks as M, neighbors as N, pivots, quality as Q, ranking as R, recluster as C, registry as G, temporal as T
from assetloom.operators.components import connected_components
from assetloom.plans.assets import ASSETS_SQL, assets, grids, regions
from assetloom.plans.flow import cluster_assets, ranked_assets
from assetloom.sources import media as S
from assetloom.sources.sinks import cluster_members
from assetloom.streaming.refresh import read_target, refresh_part

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parameters of the test bindings.
TIGHT, LOOSE, NEAR, BURST_S, GAP_S = 0.65, 0.80, 0.65, 3600.0, 21600.0
COMPONENTS = ["musiq", "nima", "laion_aes"]


def query(sql: str | None = None):
    """Registers a query under its function's name. The SQL may start from the tables of ASSETS_SQL and SCORED_SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


NORM = "CASE WHEN s_{c} < 1e-6 THEN 0e0 ELSE 1e0 / (1e0 + exp(-(({c} - m_{c}) / s_{c}))) END"
WITH_ASSETS = "WITH RECURSIVE " + ASSETS_SQL
SCORED_SQL = (
    WITH_ASSETS
    + """, stats AS (SELECT avg(musiq) AS m_musiq, stddev_pop(musiq) AS s_musiq, avg(nima) AS m_nima, stddev_pop(nima) AS s_nima, avg(laion_aes) AS m_laion_aes, stddev_pop(laion_aes) AS s_laion_aes FROM assets),
scored AS (SELECT a.*, label AS cluster_id, """
    + ", ".join(f"{NORM.format(c=c)} AS norm_{c}" for c in COMPONENTS)
    + """ FROM assets a, stats),
score AS (SELECT *, (0.35e0 * norm_musiq + 0.25e0 * norm_nima + 0.10e0 * norm_laion_aes) / (0.35e0 + 0.25e0 + 0.10e0) AS score FROM scored),
vec AS (SELECT asset_id, cluster_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS v FROM score),
mean AS (SELECT cluster_id, pos, avg(v) AS v FROM vec GROUP BY ALL),
size AS (SELECT cluster_id, greatest(sqrt(sum(v * v)), 1e-8) AS len FROM mean GROUP BY 1),
central AS (SELECT vec.asset_id, sum(vec.v * mean.v / len) AS centrality FROM vec JOIN mean USING (cluster_id, pos) JOIN size USING (cluster_id) GROUP BY 1),
ranked AS (SELECT s.*, centrality, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, centrality DESC, path, asset_id) AS rank FROM score s JOIN central USING (asset_id))
"""
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).withColumn("cluster_id", F.col("label"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_assets(labelled(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def r(c: str, places: int = 4):
    """Rounded, without a negative zero."""
    return (F.round(F.col(c), places) + F.lit(0e0)).alias(c)


# Flagship: scores, centroids and ranks inside the given labels.
@query(SCORED_SQL + "SELECT asset_id, cluster_id, path, round(score, 4) AS score, round(centrality, 4) AS centrality, rank FROM ranked")
def ranked_clusters(spark, sf_dir):
    return ranked(spark, sf_dir).select("asset_id", "cluster_id", "path", r("score"), r("centrality"), "rank")


# Sources
@query(WITH_ASSETS + r"SELECT DISTINCT path FROM assets WHERE lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'bmp', 'webp')")
def media_inventory(spark, sf_dir):
    return S.media_inventory(assets(spark, sf_dir).select("path"))


@query(WITH_ASSETS + r"""SELECT dir, name, count(*) FILTER (WHERE lower(regexp_extract(path, '\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'bmp', 'webp')) AS n_images
FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, regexp_extract(path, '([^/]*)/[^/]+$', 1) AS name FROM assets) WHERE NOT starts_with(name, '.') GROUP BY dir, name""")
def dir_image_counts(spark, sf_dir):
    return S.dir_image_counts(assets(spark, sf_dir).select("path"))


@query(r"SELECT line AS path FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def pending_list(spark, sf_dir):
    """Lines of the documents as a pending list: blank ones go, repeats stay."""
    return S.pending_lines(load(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


# Sinks
@query("SELECT label AS cluster_id, list_sort(list(vec_id)) AS members FROM embeddings GROUP BY label")
def cluster_members_by_label(spark, sf_dir):
    return cluster_members(load(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("asset_id")))


@query(SCORED_SQL + """SELECT cluster_id, 1 AS schema_version, round(max(score), 4) AS cluster_score, min_by(path, rank) AS best_image, count(*) AS n_images, count(captured_at) AS n_times,
sum(round(score, 4) * rank) AS rank_sum FROM ranked GROUP BY cluster_id""")
def results_nested(spark, sf_dir):
    n = R.results_nested(ranked(spark, sf_dir), COMPONENTS)
    times = F.size(F.filter("images", lambda i: i["exif_timestamp"].isNotNull())).cast("long")
    ranks = F.aggregate("images", F.lit(0e0), lambda a, i: a + i["score"] * i["rank"])
    return n.select("cluster_id", "schema_version", "cluster_score", "best_image", F.size("images").cast("long").alias("n_images"), times.alias("n_times"), ranks.alias("rank_sum"))


PENDING_SQL = WITH_ASSETS + ", pending AS (SELECT path FROM assets WHERE asset_id % 5 = 0), batch AS (SELECT path FROM assets WHERE asset_id % 3 = 0) "
#: Ids as paths: unlike the paths they are unique, so that parts of a list stay.
ID_LISTS_SQL = WITH_ASSETS + ", pending AS (SELECT asset_id::VARCHAR AS path FROM assets WHERE asset_id % 5 = 0), batch AS (SELECT asset_id::VARCHAR AS path FROM assets WHERE asset_id % 3 = 0) "


def _id_lists(spark, sf_dir):
    ids = assets(spark, sf_dir).select("asset_id", F.col("asset_id").cast("string").alias("path"))
    return ids.where("asset_id % 5 = 0").select("path"), ids.where("asset_id % 3 = 0").select("path")


def _pending(a: DataFrame) -> DataFrame:
    return a.where("asset_id % 5 = 0").select("path")


@query(PENDING_SQL + "SELECT path FROM pending UNION ALL SELECT path FROM batch WHERE path NOT IN (SELECT path FROM pending)")
def pending_append(spark, sf_dir):
    a = assets(spark, sf_dir)
    return D.pending_append(_pending(a), a.where("asset_id % 3 = 0").select("path"))


@query(ID_LISTS_SQL + "SELECT path FROM pending WHERE path NOT IN (SELECT path FROM batch)")
def pending_remove(spark, sf_dir):
    return D.pending_remove(*_id_lists(spark, sf_dir))


@query(ID_LISTS_SQL + "SELECT count(*) FILTER (WHERE path NOT IN (SELECT path FROM pending)) AS n_new, (SELECT count(*) FROM pending WHERE path IN (SELECT path FROM batch)) AS n_removed FROM batch")
def change_counts(spark, sf_dir):
    pending, batch = _id_lists(spark, sf_dir)
    return D.change_counts(pending, batch, batch)


# Projections and predicates
@query("SELECT vec_id AS asset_id, path_id AS cluster_id, count(*) OVER (PARTITION BY path_id) > 1 AS is_multi FROM (SELECT vec_id, hash_id AS path_id FROM (SELECT vec_id, (vec_id * 7) % (SELECT count(*) FROM embeddings) // 2 * (vec_id % 2) + vec_id * (1 - vec_id % 2) AS hash_id FROM embeddings))")
def cluster_split(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    c = F.floor((F.col("vec_id") * 7) % F.col("n") / 2) * (F.col("vec_id") % 2) + F.col("vec_id") * (1 - F.col("vec_id") % 2)
    return D.cluster_split(e.crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("asset_id"), c.alias("cluster_id")))


@query(SCORED_SQL + "SELECT asset_id, rank = 1 AS keep FROM ranked")
def default_keeps(spark, sf_dir):
    return D.default_keeps(ranked(spark, sf_dir)).select("asset_id", "keep")


@query(SCORED_SQL + "SELECT asset_id, score >= 0.4e0 AS keep FROM score")
def singleton_decisions(spark, sf_dir):
    return D.singleton_decisions(Q.ensemble_score(labelled(spark, sf_dir))).select("asset_id", "keep")


@query(SCORED_SQL + "SELECT t / 100e0 AS threshold, count(*) FILTER (WHERE floor(score * 100 + 1e-9) >= t) AS n_keep FROM score, range(101) r(t) GROUP BY t")
def threshold_sweep(spark, sf_dir):
    return D.threshold_sweep(Q.ensemble_score(labelled(spark, sf_dir)))


@query(SCORED_SQL + "SELECT CASE WHEN score < 0.4e0 THEN 'bad' WHEN score < 0.5e0 THEN 'borderline' ELSE 'good' END AS band, count(*) AS n FROM score GROUP BY 1")
def quality_bands(spark, sf_dir):
    return D.quality_bands(Q.ensemble_score(labelled(spark, sf_dir)))


@query(SCORED_SQL + "SELECT asset_id, round(score - max(score) OVER (PARTITION BY cluster_id), 4) + 0e0 AS delta FROM score")
def score_delta(spark, sf_dir):
    return D.score_delta(Q.ensemble_score(labelled(spark, sf_dir))).select("asset_id", r("delta"))


@query(SCORED_SQL + ", t AS (SELECT path, sum(asset_id % 3) AS n FROM assets GROUP BY path) SELECT asset_id, (rank = 1) <> (n % 2 = 1) AS keep FROM ranked JOIN t USING (path)")
def toggle_overrides(spark, sf_dir):
    toggles = assets(spark, sf_dir).groupBy("path").agg(F.sum(F.col("asset_id") % 3).alias("n_toggles"))
    return D.toggle_overrides(D.default_keeps(ranked(spark, sf_dir)), toggles).select("asset_id", "keep")


@query("SELECT page_id, path = '/en' OR starts_with(path, '/en/') AS inside FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def path_containment(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return p.select("page_id", P.is_inside(F.col("path"), "/en").alias("inside"))


# Incremental refresh
CACHE_SQL = WITH_ASSETS + """, named AS (SELECT path, min(asset_id) AS id, max(musiq) AS musiq FROM assets GROUP BY path),
cache AS (SELECT path, musiq FROM named WHERE id % 3 <> 0 UNION ALL SELECT '/gone/' || id::VARCHAR, -musiq FROM named WHERE id % 11 = 0) """


def _named(spark, sf_dir):
    n = assets(spark, sf_dir).groupBy("path").agg(F.min("asset_id").alias("id"), F.max("musiq").alias("musiq"))
    gone = n.where("id % 11 = 0").select(F.concat(F.lit("/gone/"), F.col("id").cast("string")).alias("path"), (-F.col("musiq")).alias("musiq"))
    return n, n.where("id % 3 <> 0").select("path", "musiq").unionByName(gone)


@query(CACHE_SQL + "SELECT coalesce(n.path, c.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN c.path IS NULL THEN 'new' ELSE 'cached' END AS status FROM named n FULL JOIN cache c ON n.path = c.path")
def incremental_split(spark, sf_dir):
    return I.incremental_split(*_named(spark, sf_dir))


@query(CACHE_SQL + "SELECT n.path, coalesce(c.musiq, 2 * n.musiq) AS musiq FROM named n LEFT JOIN cache c USING (path)")
def incremental_merge(spark, sf_dir):
    n, cache = _named(spark, sf_dir)
    return I.refresh(n, cache, lambda df: df.select("path", (2 * F.col("musiq")).alias("musiq")))


@query(CACHE_SQL + """SELECT 'cache' AS against, CASE WHEN EXISTS (SELECT path FROM named EXCEPT SELECT path FROM cache) OR EXISTS (SELECT path FROM cache EXCEPT SELECT path FROM named) THEN 'stale' ELSE 'ready' END AS status
UNION ALL SELECT 'media', CASE WHEN EXISTS (SELECT path FROM named EXCEPT SELECT path FROM assets) OR EXISTS (SELECT path FROM assets EXCEPT SELECT path FROM named) THEN 'stale' ELSE 'ready' END""")
def inventory_drift(spark, sf_dir):
    n, cache = _named(spark, sf_dir)
    of = lambda name, df: I.drift_status(df, n).select(F.lit(name).alias("against"), "status")
    return of("cache", cache).unionByName(of("media", assets(spark, sf_dir)))


@query(CACHE_SQL + "SELECT coalesce(n.path, c.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN c.path IS NULL THEN 'new' ELSE 'cached' END AS status FROM named n FULL JOIN cache c ON n.path = c.path")
def drift_split(spark, sf_dir):
    """The split by prints of buckets: most of them hold no change."""
    return I.drift_split(*_named(spark, sf_dir))


@query("SELECT path, length(path) AS n, batch FROM (SELECT 'u' || (event_id % 701)::VARCHAR AS path, min(event_id % 3) AS batch FROM events GROUP BY ALL)")
def refresh_replayed(spark, sf_dir):
    """Three batches of events, of which the second is cut off and then runs twice, as after a failure."""
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("event_id") % 701).cast("string")).alias("path"), (F.col("event_id") % 3).alias("batch"))
    target = f"{shared_dir(spark)}/replayed-{uuid.uuid4().hex}"
    add = lambda rows, part: refresh_part(rows, target, part, lambda df: df.select("path", F.length("path").cast("long").alias("n"), "batch"))
    add(e.where("batch = 0"), "q-0")
    add(e.where("batch = 1").limit(100), "q-1")
    for batch in (1, 1, 2):
        add(e.where(F.col("batch") == batch), f"q-{batch}")
    return read_target(spark, target).select("path", "n", "batch")


# Neighbours
DIST = "1e0 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
NEAR_SQL = f"WITH RECURSIVE p AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, {DIST} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS rank FROM p) "


@query(NEAR_SQL + 'SELECT id, neighbor, round(dist, 5) AS dist, rank FROM k WHERE rank <= 5')
def knn_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return N.knn(v, v, 5).select("id", "neighbor", r("dist", 5), "rank")


@query(NEAR_SQL + "SELECT id AS src, neighbor AS dst FROM k WHERE rank <= 5 UNION SELECT neighbor, id FROM k WHERE rank <= 5")
def knn_graph(spark, sf_dir):
    return N.knn_graph(vectors(spark, sf_dir), 5)


@query(NEAR_SQL + "SELECT id, neighbor, round(dist, 5) AS dist FROM k WHERE rank = 1")
def nn_distance(spark, sf_dir):
    return N.nn_distance(vectors(spark, sf_dir)).select("id", "neighbor", r("dist", 5))


@query(NEAR_SQL + f"SELECT id AS a, neighbor AS b, round(dist, 5) AS dist FROM p WHERE id < neighbor AND dist < {NEAR}e0")
def near_dup_pairs(spark, sf_dir):
    return N.pairs_within(vectors(spark, sf_dir), NEAR).select("a", "b", r("dist", 5))


@query(NEAR_SQL + f"SELECT id AS a, neighbor AS b, round(dist, 5) AS dist FROM p WHERE id < neighbor AND dist < {NEAR}e0")
def near_dup_pairs_pruned(spark, sf_dir):
    """The same pairs, from the pairs of blocks that pivots don't rule out."""
    return pivots.pairs_within_pruned(vectors(spark, sf_dir), NEAR, block_rows=64).select("a", "b", r("dist", 5))


@query()
def knn_descent(spark, sf_dir):
    return N.knn_descent(vectors(spark, sf_dir), 5).select("id", "neighbor", r("dist", 5), "rank")


@query("SELECT 'descent' AS kind, true AS reached UNION ALL SELECT 'planes', true")
def approximate_recall(spark, sf_dir):
    """Whether the approximate ways find 0.9 or more of what the exact ones find: neighbours among 5, pairs below NEAR."""
    v = vectors(spark, sf_dir)

    def recall(kind: str, exact: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
        hit = exact.join(found.select(*on).withColumn("hit", F.lit(1)), on, "left")
        return hit.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached")).select(F.lit(kind).alias("kind"), "reached")

    with Scratch() as scratch:
        near = recall("descent", N.knn(v, v, 5), N.knn_descent(v, 5, start_rows=32), ["id", "neighbor"])
        out = materialize(near.unionByName(recall("planes", N.pairs_within(v, NEAR), N.approximate_pairs(v, NEAR, block_rows=64), ["a", "b"])), "recall")
    scratch.delete(spark, but_for=out)
    return out


HIST_SQL = NEAR_SQL + ", n AS (SELECT least(39, floor(dist * 40))::INTEGER AS bin FROM k WHERE rank = 1 AND dist BETWEEN 0 AND 1), hist AS (SELECT b.bin::INTEGER AS bin, count(n.bin) AS cnt FROM range(40) b(bin) LEFT JOIN n ON n.bin = b.bin GROUP BY 1) "


@query(HIST_SQL + "SELECT bin, cnt FROM hist")
def nn_histogram(spark, sf_dir):
    return N.histogram(N.nn_distance(vectors(spark, sf_dir)), "dist", 0.0, 1.0)


@query(HIST_SQL + """, m AS (SELECT bin, cnt, lag(cnt) OVER (ORDER BY bin) AS before, first(bin) OVER (ORDER BY cnt DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peak FROM hist)
SELECT round(coalesce((min(bin) FILTER (WHERE bin > peak AND (bin = 39 OR cnt < before)) + 0.5e0) * 0.025e0, 0.22e0), 6) AS threshold FROM m""")
def calibrate_threshold(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return N.calibrate_threshold(v, 0.22, low=0.0, high=1.0, clamp=None).select(r("threshold", 6))


FIRST_DROP_SQL = """, m AS (SELECT bin, cnt, lag(cnt) OVER (ORDER BY bin) AS before, first(bin) OVER (ORDER BY cnt DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peak FROM hist),
drop_at AS (SELECT min(bin) FILTER (WHERE bin > peak AND (bin = 39 OR cnt < before)) AS bin FROM m) """


def _default_sql(dist: str) -> str:
    """The default range, clamp and fallback over the nearest distances."""
    hist = f""", n AS (SELECT least(39, floor({dist} * 80))::INTEGER AS bin FROM k WHERE rank = 1 AND {dist} BETWEEN 0 AND 0.5e0),
hist AS (SELECT b.bin::INTEGER AS bin, count(n.bin) AS cnt FROM range(40) b(bin) LEFT JOIN n ON n.bin = b.bin GROUP BY 1)"""
    return NEAR_SQL + hist + FIRST_DROP_SQL + "SELECT round(greatest(0.05e0, least(coalesce((bin + 0.5e0) * 0.0125e0, 0.35e0), 0.35e0)), 6) AS threshold FROM drop_at"


@query(_default_sql("dist"))
def calibrate_threshold_default(spark, sf_dir):
    """The default range and clamp."""
    return N.calibrate_threshold(vectors(spark, sf_dir), 0.35).select(r("threshold", 6))


@query(_default_sql("(dist / 2)"))
def calibrate_threshold_halved(spark, sf_dir):
    """The same where the clamp doesn't decide: one value more in common halves all distances."""
    half = F.transform("v", lambda x: x.cast("double") / F.sqrt(F.lit(2e0)))
    return N.calibrate_threshold(vectors(spark, sf_dir).select("id", F.concat(half, F.array(F.sqrt(F.lit(0.5e0)))).alias("v")), 0.35).select(r("threshold", 6))


# Time
BURST_SQL = WITH_ASSETS + f""", sub AS (SELECT asset_id, captured_at, label AS parent, label * 1000 + asset_id % 50 AS sub FROM assets),
gap AS (SELECT sub, lag(sub) OVER w AS before, epoch_us(captured_at) / 1e6 - lag(epoch_us(captured_at) / 1e6) OVER w AS gap FROM sub WHERE captured_at IS NOT NULL WINDOW w AS (PARTITION BY parent ORDER BY captured_at, asset_id)),
edge AS (SELECT DISTINCT least(sub, before) AS a, greatest(sub, before) AS b FROM gap WHERE gap <= {BURST_S}e0 AND sub <> before),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach(n, c) AS (SELECT sub, sub FROM sub UNION SELECT s.b, r.c FROM reach r JOIN sym s ON s.a = r.n),
comp AS (SELECT n AS sub, min(c) AS merged FROM reach GROUP BY n) """


def _subs(spark, sf_dir):
    return assets(spark, sf_dir).select("asset_id", "captured_at", F.col("label").cast("long").alias("parent"), (F.col("label") * 1000 + F.col("asset_id") % 50).cast("long").alias("sub"))


@query(BURST_SQL + "SELECT a, b FROM edge")
def burst_edges(spark, sf_dir):
    return T.burst_edges(_subs(spark, sf_dir), BURST_S)


@query(BURST_SQL + "SELECT asset_id, sub, merged FROM sub JOIN comp USING (sub)")
def burst_merge(spark, sf_dir):
    return T.burst_merge(_subs(spark, sf_dir), BURST_S).select("asset_id", "sub", "merged")


@query(WITH_ASSETS + """, g AS (SELECT asset_id, label, captured_at, CASE WHEN epoch_us(captured_at) / 1e6 - lag(epoch_us(captured_at) / 1e6) OVER w > 3600e0 THEN 1 ELSE 0 END AS new FROM assets WINDOW w AS (PARTITION BY label ORDER BY captured_at NULLS LAST, asset_id))
SELECT asset_id, CASE WHEN captured_at IS NULL THEN 0 ELSE sum(new) OVER (PARTITION BY label ORDER BY captured_at NULLS LAST, asset_id ROWS UNBOUNDED PRECEDING) END::BIGINT AS split FROM g""")
def gap_split(spark, sf_dir):
    return T.gap_split(assets(spark, sf_dir), "label", 3600.0).select("asset_id", "split")


# Clustering
@query()
def near_dup_pairs_lsh(spark, sf_dir):
    """Approximate: over random planes, with buckets small enough that the given tables fill several."""
    return N.approximate_pairs(vectors(spark, sf_dir), NEAR, block_rows=64).select("a", "b", r("dist", 5))


@query(NEAR_SQL + f", e AS (SELECT id, neighbor FROM p WHERE dist < {NEAR}e0), reach(node, c) AS (SELECT id, id FROM e UNION SELECT e.neighbor, r.c FROM reach r JOIN e ON e.id = r.node) SELECT node, min(c) AS component FROM reach GROUP BY node")
def components_of_near_pairs(spark, sf_dir):
    return connected_components(N.pairs_within(vectors(spark, sf_dir), NEAR).select("a", "b"))


@query()
def cluster_loose(spark, sf_dir):
    return L.average_linkage(assets(spark, sf_dir), LOOSE)


@query()
def cluster_tight(spark, sf_dir):
    return L.average_linkage(assets(spark, sf_dir), TIGHT)


@query()
def cluster_knn(spark, sf_dir):
    """Merges follow the graph of the 10 nearest."""
    return L.average_linkage(assets(spark, sf_dir), TIGHT, neighbors=10)


@query("SELECT vec_id AS asset_id, true AS same FROM embeddings WHERE vec_id % 11 <> 3")
def recluster(spark, sf_dir):
    """Clusters kept up to date over two inserts and a removal, held to a run over what is there at the end."""
    a = assets(spark, sf_dir).select("asset_id", "embedding")
    state, _ = C.update_clustering(C.empty_clustering(spark), TIGHT, a.where("asset_id % 5 > 1"))
    state, _ = C.update_clustering(state, TIGHT, a.where("asset_id % 5 = 1"), a.where("asset_id % 11 = 3"))
    state, _ = C.update_clustering(state, TIGHT, a.where("asset_id % 5 = 0 AND asset_id % 11 <> 3"), a.where("asset_id % 11 = 3"))
    whole = L.average_linkage(a.where("asset_id % 11 <> 3"), TIGHT).withColumnRenamed("cluster", "expected")
    return state.labels().join(whole, "asset_id", "full").select("asset_id", F.col("cluster").eqNullSafe(F.col("expected")).alias("same"))


def _cuts(name: str, clusters: DataFrame, e: DataFrame, within: list[str], threshold: float) -> DataFrame:
    """One row: rows, clusters named by another than their smallest row, and pairs of clusters in one of ``within`` that are
    closer on average than the threshold, and so would have merged."""
    wrong = clusters.groupBy("cluster").agg(F.min("asset_id").alias("least")).agg(F.count_if(F.col("least") != F.col("cluster")).alias("misnamed"))
    mean = R.mean_vectors(clusters.join(e, "asset_id"), [*within, "cluster"]).withColumnRenamed("mean", "v").withColumn("id", F.col("cluster").cast("long"))
    close = N.pairs_within(mean.select(*within, "id", "v"), threshold - 1e-9, by=within).agg(F.count(F.lit(1)).alias("mergeable"))
    return clusters.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(wrong)).crossJoin(F.broadcast(close))


@query("SELECT unnest(['loose', 'tight', 'nested']) AS kind, count(*) AS n, 0::BIGINT AS misnamed, 0::BIGINT AS mergeable FROM embeddings")
def cluster_cuts(spark, sf_dir):
    """What holds for average linkage below a threshold: no two clusters are left that are closer."""
    a = assets(spark, sf_dir)
    unit = a.select("asset_id", "embedding")
    nested = L.two_stage(a, TIGHT, LOOSE).select("asset_id", "parent", F.col("sub").alias("cluster"))
    loose, tight = (L.average_linkage(a, t) for t in (LOOSE, TIGHT))
    return _cuts("loose", loose, unit, [], LOOSE).unionByName(_cuts("tight", tight, unit, [], TIGHT)).unionByName(_cuts("nested", nested, unit, ["parent"], TIGHT))


@query()
def cluster_two_stage(spark, sf_dir):
    return L.two_stage(assets(spark, sf_dir), TIGHT, LOOSE).select("asset_id", "parent", "sub")


@query()
def clustered_and_ranked(spark, sf_dir):
    """The whole dataflow."""
    done = ranked_assets(cluster_assets(assets(spark, sf_dir), TIGHT, LOOSE, BURST_S, GAP_S))
    return done.select("asset_id", "parent", "sub", "merged", "split", "cluster_id", r("score"), r("centrality"), "rank")


@query(WITH_ASSETS + ", s AS (SELECT asset_id, label * 100 + asset_id % 13 AS c FROM assets), n AS (SELECT c, count(*) AS n FROM s GROUP BY c) SELECT asset_id, CASE WHEN n >= 5 THEN c ELSE asset_id END AS cluster_id FROM s JOIN n USING (c)")
def min_size_policy(spark, sf_dir):
    a = assets(spark, sf_dir).select("asset_id", (F.col("label") * 100 + F.col("asset_id") % 13).alias("cluster_id"))
    return L.min_size_policy(a, "cluster_id", 5)


# Aggregations
@query(SCORED_SQL + "SELECT " + ", ".join(f"round(m_{c}, 6) AS mean_{c}, round(s_{c}, 6) AS std_{c}" for c in COMPONENTS) + " FROM stats")
def component_stats(spark, sf_dir):
    s = Q.component_stats(assets(spark, sf_dir), COMPONENTS)
    return s.select(*[r(c, 6) for c in s.columns])


@query(SCORED_SQL + "SELECT " + ", ".join(f"round(m_{c}, 6) AS mean_{c}, round(s_{c}, 6) AS std_{c}" for c in COMPONENTS) + " FROM stats")
def component_stats_kept(spark, sf_dir):
    """The same from kept moments: parts of rows, of which one came twice as much as stays and one changed."""
    a = assets(spark, sf_dir).withColumn("part", F.col("asset_id") % 4)
    parts = Q.part_moments(a.unionByName(a.where("part = 1").withColumn("musiq", F.col("musiq") + 5)), COMPONENTS, ["part"])
    gone = Q.part_moments(a.where("part = 1").withColumn("musiq", F.col("musiq") + 5), COMPONENTS, ["part"])
    s = Q.moment_stats(Q.without_moments(parts, gone), COMPONENTS)
    return s.select(*[r(c, 6) for c in s.columns])


@query(SCORED_SQL + "SELECT asset_id, " + ", ".join(f"round(norm_{c}, 6) AS norm_{c}" for c in COMPONENTS) + " FROM scored")
def component_norm(spark, sf_dir):
    return Q.component_norm(assets(spark, sf_dir), COMPONENTS).select("asset_id", *[r(f"norm_{c}", 6) for c in COMPONENTS])


@query(SCORED_SQL + "SELECT asset_id, round(score, 6) AS score FROM score")
def ensemble_score(spark, sf_dir):
    return Q.ensemble_score(assets(spark, sf_dir)).select("asset_id", r("score", 6))


@query(SCORED_SQL + "SELECT cluster_id, pos, round(v / len, 6) + 0e0 AS v FROM mean JOIN size USING (cluster_id)")
def cluster_centroid(spark, sf_dir):
    c = R.cluster_centroid(labelled(spark, sf_dir)).select("cluster_id", F.posexplode("centroid").alias("pos", "v"))
    return c.select("cluster_id", (F.col("pos") + 1).cast("long").alias("pos"), r("v", 6))


@query(SCORED_SQL + "SELECT cluster_id, round(max(score), 4) AS cluster_score, min_by(path, rank) AS best_image, count(*) AS n_images FROM ranked GROUP BY 1")
def cluster_summary(spark, sf_dir):
    return R.cluster_summary(ranked(spark, sf_dir))


@query(SCORED_SQL + "SELECT cluster_id, count(*) FILTER (WHERE rank = 1) AS n_keep, count(*) FILTER (WHERE rank <> 1) AS n_delete FROM ranked GROUP BY 1")
def keep_counts(spark, sf_dir):
    return D.keep_counts(D.default_keeps(ranked(spark, sf_dir)))


@query(WITH_ASSETS + ", n AS (SELECT path, count(*) AS n FROM assets GROUP BY path) SELECT count(*) FILTER (WHERE n > 1) AS n_clusters, count(*) FILTER (WHERE n = 1) AS n_singletons, (SELECT count(*) FROM assets WHERE asset_id % 5 = 0) AS n_pending, 0.4e0 AS threshold, false AS undo_available FROM n")
def state_summary(spark, sf_dir):
    a = assets(spark, sf_dir)
    return D.state_summary(a.select(F.col("path").alias("cluster_id")), _pending(a))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT *, (SELECT count(*) FILTER (WHERE n > 1) FROM n) AS n_clusters, (SELECT count(*) FILTER (WHERE n = 1) FROM n) AS n_singletons, 0::BIGINT AS n_pending, 0.4e0 AS threshold FROM (VALUES ('left', true), ('undone', false)) v(log, undo_available)")
def state_summary_undo(spark, sf_dir):
    """A log with a confirm that can be undone, and one whose confirms all are."""
    clusters = load(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"))
    none = clusters.where("false").select(F.lit("").alias("path"))
    log = load(spark, sf_dir, "events").where("event_id < 12").select(F.lit("p").alias("project"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "confirm").otherwise("undo").alias("op"), F.array(F.lit("/x")).alias("delete_paths"))
    of = lambda name, df: D.state_summary(clusters, none, stack=D.match_undos(df)[1]).withColumn("log", F.lit(name))
    return of("left", log.where("seq < 11")).unionByName(of("undone", log))


@query(WITH_ASSETS + "SELECT count(captured_at) AS n_times, count(*) AS n FROM assets")
def timestamp_coverage(spark, sf_dir):
    return T.timestamp_coverage(assets(spark, sf_dir))


GRID_SQL = "WITH g AS (SELECT vec_id AS asset_id, unnest(range(64)) AS k, least(1e0, greatest(0e0, 0.5e0 + 2e0 * unnest(embedding)::DOUBLE)) AS luma FROM embeddings)"


@query(GRID_SQL + " SELECT asset_id, round(least(1e0, 0.4e0 * (abs(avg(luma) - 0.5e0) * 2e0) + 3e0 * avg((luma < 0.02e0)::INTEGER) + 3e0 * avg((luma > 0.98e0)::INTEGER)), 6) AS penalty FROM g GROUP BY asset_id")
def exposure_penalty(spark, sf_dir):
    return grids(assets(spark, sf_dir)).select("asset_id", Q.exposure_penalty(F.col("luma")).alias("penalty")).select("asset_id", r("penalty", 6))


@query(GRID_SQL + """, l AS (SELECT a.asset_id, a.k, sum(b.luma) - 4e0 * a.luma AS lap FROM g a JOIN g b ON a.asset_id = b.asset_id AND abs(a.k // 8 - b.k // 8) + abs(a.k % 8 - b.k % 8) = 1 GROUP BY a.asset_id, a.k, a.luma)
SELECT asset_id, round(var_samp(lap), 6) AS sharpness FROM l GROUP BY asset_id""")
def laplacian_sharpness(spark, sf_dir):
    return grids(assets(spark, sf_dir)).select("asset_id", Q.laplacian_sharpness(F.col("luma"), 8).alias("sharpness")).select("asset_id", r("sharpness", 6))


@query("""WITH g AS (SELECT l_orderkey AS asset_id, l_quantity::INTEGER * l_linenumber AS area, l_discount AS sharp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INTEGER * l_linenumber DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) AS k FROM lineitem)
SELECT o_orderkey AS asset_id, round(coalesce(CASE WHEN area / 5000e0 < 0.002e0 THEN 0e0 ELSE 1e0 - exp(-50e0 * sharp) END, 0e0), 6) AS face_bonus FROM orders LEFT JOIN g ON g.asset_id = o_orderkey AND k = 1""")
def region_bonus(spark, sf_dir):
    owners = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"))
    return Q.region_bonus(owners, regions(spark, sf_dir), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"], 5000.0).select("asset_id", r("face_bonus", 6))


# Windows, sorts, set operations
@query(SCORED_SQL + "SELECT asset_id, cluster_id, rank FROM ranked")
def rank_in_cluster(spark, sf_dir):
    return ranked(spark, sf_dir).select("asset_id", "cluster_id", "rank")


RERANK_SQL = SCORED_SQL + """, old AS (SELECT cluster_id, asset_id::VARCHAR AS path, score, rank, max(score) OVER (PARTITION BY cluster_id) AS cluster_score FROM ranked),
kept AS (SELECT * FROM old WHERE path NOT IN (SELECT asset_id::VARCHAR FROM assets WHERE asset_id % 3 = 0 OR label = 4)) """


def _results(spark, sf_dir):
    return ranked(spark, sf_dir).select("cluster_id", F.max("score").over(W.partitionBy("cluster_id")).alias("cluster_score"), F.col("asset_id").cast("string").alias("path"), "score", "rank")


@query(RERANK_SQL + "SELECT cluster_id, round(cluster_score, 4) AS cluster_score, path, round(score, 4) AS score, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, rank) AS rank, first(path) OVER (PARTITION BY cluster_id ORDER BY rank) AS best_image FROM kept")
def rerank_after_removal(spark, sf_dir):
    gone = assets(spark, sf_dir).where("asset_id % 3 = 0 OR label = 4").select(F.col("asset_id").cast("string").alias("path"))
    return R.rerank_after_removal(_results(spark, sf_dir), gone).select("cluster_id", r("cluster_score"), "path", r("score"), "rank", "best_image")


ORDER_SQL = SCORED_SQL + ", o AS (SELECT cluster_id, cluster_score, row_number() OVER (ORDER BY cluster_score DESC, cluster_id) AS position FROM (SELECT cluster_id, round(max(score), 4) AS cluster_score FROM ranked GROUP BY 1)) "


@query(ORDER_SQL + "SELECT * FROM o")
def cluster_order(spark, sf_dir):
    return R.cluster_order(R.cluster_summary(ranked(spark, sf_dir))).select("cluster_id", "cluster_score", "position")


@query(ORDER_SQL + "SELECT cluster_id, position, count(*) OVER () AS total FROM o")
def review_progress(spark, sf_dir):
    return D.review_progress(R.cluster_order(R.cluster_summary(ranked(spark, sf_dir)))).select("cluster_id", "position", "total")


@query(SCORED_SQL + "SELECT asset_id, round(score, 4) AS score, row_number() OVER (ORDER BY score, asset_id) AS position FROM score")
def singles_worst_first(spark, sf_dir):
    return D.singles_worst_first(Q.ensemble_score(labelled(spark, sf_dir))).select("asset_id", r("score"), "position")


@query(SCORED_SQL + "SELECT asset_id, true AS kept_all, score >= 0.6e0 AS kept_good FROM score")
def keep_overrides(spark, sf_dir):
    """Keep all, and the threshold again over it."""
    kept = D.keep_all(Q.ensemble_score(labelled(spark, sf_dir))).withColumn("kept_all", F.col("keep"))
    return D.select_bad(kept, 0.6).select("asset_id", "kept_all", F.col("keep").alias("kept_good"))


@query(SCORED_SQL + "SELECT asset_id, cluster_id, rank FROM ranked WHERE rank <= 3")
def topk_per_cluster(spark, sf_dir):
    return R.top_k(ranked(spark, sf_dir), 3).select("asset_id", "cluster_id", "rank")


REGISTRY_SQL = """WITH e AS (SELECT md5(user_id::VARCHAR) AS folder, ts AS opened, event_type = 'signup' AS ran, event_id AS image_count FROM events),
r AS (SELECT folder, max(opened) AS last_opened, max(opened) FILTER (WHERE ran) AS last_pipeline_run, coalesce(max_by(image_count, opened) FILTER (WHERE ran), min_by(image_count, opened)) AS image_count FROM e GROUP BY folder) """


def _registry(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return G.recents_upsert(e.select(P.project_key(F.col("user_id").cast("string")).alias("folder"), F.col("ts").alias("opened"), (F.col("event_type") == "signup").alias("ran"), F.col("event_id").alias("image_count")))


@query(REGISTRY_SQL + "SELECT * FROM r")
def recents_upsert(spark, sf_dir):
    return _registry(spark, sf_dir)


@query(REGISTRY_SQL + "SELECT folder, last_opened FROM r ORDER BY last_opened DESC, folder LIMIT 20")
def recents_top20(spark, sf_dir):
    return G.recents_top(_registry(spark, sf_dir)).select("folder", "last_opened")


@query(REGISTRY_SQL + """, s AS (SELECT *, ascii(folder) % 3 AS k, ascii(substr(folder, 2, 1)) AS m FROM r)
SELECT folder, image_count, folder AS display_name, CASE WHEN m % 5 = 0 THEN 'running' WHEN k = 0 THEN 'never_run' WHEN m % 2 = 0 THEN 'ready' ELSE 'stale' END AS status FROM s""")
def project_status(spark, sf_dir):
    reg = _registry(spark, sf_dir).select("folder", "image_count")
    m = F.ascii(F.substring("folder", 2, 1))
    drift = reg.select("folder", F.when(m % 2 == 0, "ready").otherwise("stale").alias("status"))
    return G.project_status(reg, drift, reg.where(F.ascii("folder") % 3 != 0), reg.where(m % 5 == 0))


@query(SCORED_SQL + "SELECT asset_id, cluster_id, rank FROM ranked WHERE path NOT IN (SELECT path FROM assets WHERE asset_id % 5 = 0)")
def keepers(spark, sf_dir):
    return X.keepers(ranked(spark, sf_dir), _pending(assets(spark, sf_dir))).select("asset_id", "cluster_id", "rank")


@query(WITH_ASSETS + r""", n AS (SELECT asset_id, regexp_extract(path, '([^/]+)$', 1) AS name FROM assets), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY asset_id) - 1 AS k FROM n)
SELECT asset_id, CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) || '_' || k::VARCHAR || regexp_extract(name, '^.+?(\.[^.]*)?$', 1) END AS dest FROM k""")
def export_plan(spark, sf_dir):
    return X.export_plan(assets(spark, sf_dir).select("path", F.col("asset_id").alias("seq"))).select(F.col("seq").alias("asset_id"), "dest")


@query(WITH_ASSETS + """, s AS (SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 'x_' || (asset_id % 9)::VARCHAR || '.jpg' ELSE 'x.jpg' END AS name FROM assets)
SELECT count(*) AS n, count(*) AS distinct_names, count(DISTINCT name) AS plain, true AS numbered, 0::BIGINT AS taken_again FROM s""")
def export_plan_clashes(spark, sf_dir):
    """Names of which some are the numbered forms of others: all are given once, every plain name stays with one source, and the
    rest are numbered."""
    name = F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit("x_"), (F.col("asset_id") % 9).cast("string"), F.lit(".jpg"))).otherwise("x.jpg")
    plan = X.export_plan(assets(spark, sf_dir).select(F.concat(F.lit("/a/"), F.col("asset_id").cast("string"), F.lit("/"), name).alias("path"), F.col("asset_id").alias("seq")))
    kept = F.element_at(F.split("path", "/"), -1) == F.col("dest")
    known = F.broadcast(plan.groupBy("dest").agg(F.count(F.lit(1)).alias("times")).agg(F.count(F.lit(1)).alias("distinct_names"), F.count_if(F.col("times") > 1).alias("taken_again")))
    return plan.agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("plain"), F.every(kept | F.col("dest").rlike(r"^x(_[0-9]+)+\.jpg$")).alias("numbered")).crossJoin(known)


# Scalars
@query("""SELECT event_id, try_strptime(coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')), '%Y:%m:%d %H:%M:%S') AS taken FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN 'broken' ELSE '' END AS a,
CASE WHEN event_id % 4 = 2 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS b, strftime(ts, '%Y:%m:%d 00:00:00') AS c FROM events)""")
def exif_timestamp(spark, sf_dir):
    full, day = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.date_format("ts", "yyyy:MM:dd 00:00:00")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, full).when(k == 1, "broken").otherwise("")
    return load(spark, sf_dir, "events").select("event_id", P.exif_timestamp(raw, F.when(k == 2, full), day).alias("taken"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT vec_id, unnest(range(1, 65)) AS pos, round(unnest(v) / CASE WHEN n = 0 THEN 1e0 ELSE n END, 6) + 0e0 AS v FROM n")
def l2_normalize(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    return e.select("vec_id", F.posexplode(V.l2_normalize(scaled)).alias("pos", "v")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), r("v", 6))


@query("""WITH t AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, k % 8 + 1 AS pos, round(max(v) FILTER (WHERE k // 8 = 0), 6) + 0e0 AS head, round(avg(v) FILTER (WHERE k // 8 >= 3), 6) + 0e0 AS patch FROM t GROUP BY ALL""")
def token_pooling(spark, sf_dir):
    """A vector as 8 tokens of 8 values: token 0, two register tokens, five patches."""
    tokens = F.array(*[F.slice("embedding", 8 * k + 1, 8) for k in range(8)])
    pooled = load(spark, sf_dir, "embeddings").select("vec_id", V.token_pooling(tokens, 2).alias("p"))
    both = pooled.select("vec_id", F.posexplode(F.arrays_zip(F.slice("p", 1, 8).alias("head"), F.slice("p", 9, 8).alias("patch"))).alias("pos", "z"))
    return both.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("z.head").alias("head"), F.col("z.patch").alias("patch")).select("vec_id", "pos", r("head", 6), r("patch", 6))


@query("SELECT vec_id, unnest(range(1, 65)) AS pos, round((unnest(embedding)::DOUBLE + unnest(list_reverse(embedding))::DOUBLE) * 0.5e0, 6) + 0e0 AS v FROM embeddings")
def tta_average(spark, sf_dir):
    out = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.tta_average(F.col("embedding"), F.reverse("embedding"))).alias("pos", "v"))
    return out.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), r("v", 6))


@query(f"SELECT a.vec_id, round({DIST}, 5) + 0e0 AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", V.cosine_distance(F.col("embedding"), F.col("other")).alias("dist")).select("vec_id", r("dist", 5))


@query(SCORED_SQL + "SELECT asset_id, round(centrality, 5) AS centrality FROM central")
def centrality(spark, sf_dir):
    return R.centrality(labelled(spark, sf_dir)).select("asset_id", r("centrality", 5))


@query("SELECT page_id, md5(url) AS key FROM pages")
def project_key(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", P.project_key(F.col("url")).alias("key"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def props_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", P.json_field(F.col("props"), "k", "long").alias("k"))


# Curation
CONFIRM_SQL = RERANK_SQL.replace("asset_id % 3 = 0 OR label = 4", "asset_id % 4 = 1")


@query(CONFIRM_SQL + "SELECT 'pending' AS kind, asset_id::VARCHAR AS path, NULL::BIGINT AS rank FROM assets WHERE asset_id % 5 = 0 OR asset_id % 4 = 1 UNION ALL SELECT 'result', path, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, rank) FROM kept")
def confirm_batch(spark, sf_dir):
    ids = assets(spark, sf_dir).select("asset_id", F.col("asset_id").cast("string").alias("path"))
    results, pending = D.confirm_batch(_results(spark, sf_dir), ids.where("asset_id % 5 = 0").select("path"), ids.where("asset_id % 4 = 1").select("path"))
    return pending.select(F.lit("pending").alias("kind"), "path", F.lit(None).cast("long").alias("rank")).unionByName(results.select(F.lit("result").alias("kind"), "path", F.col("rank").cast("long").alias("rank")))


@query("SELECT user_id, max_by(CASE event_type WHEN 'purchase' THEN 'mark' ELSE 'restore' END, event_id) AS op, max(event_id) AS seq FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def latest_decision(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "mark").when(F.col("event_type") == "error", "restore")
    return D.latest_decision(load(spark, sf_dir, "events").select("user_id", op.alias("op"), F.col("event_id").alias("seq")), "user_id")


UNDO_SQL = """WITH RECURSIVE log AS (SELECT user_id AS project, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'undo' ELSE 'restore' END AS op,
    ['/p/' || (event_id % 7)::VARCHAR, '/p/' || (event_id % 3)::VARCHAR] AS paths FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
steps AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM log),
walk AS (SELECT DISTINCT project, 0::BIGINT AS k, NULL::BIGINT AS seq, []::BIGINT[] AS stack, NULL::BIGINT AS undone FROM log
    UNION ALL SELECT s.project, s.k, s.seq, CASE s.op WHEN 'confirm' THEN list_append(stack, s.seq)[-10:] WHEN 'undo' THEN stack[:-2] ELSE stack END, CASE WHEN s.op = 'undo' THEN stack[-1] END
    FROM walk w JOIN steps s ON s.project = w.project AND s.k = w.k + 1),
undone AS (SELECT project, seq, undone AS confirm FROM walk WHERE undone IS NOT NULL) """


def _log(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "restore")
    paths = F.array(F.concat(F.lit("/p/"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("/p/"), (F.col("event_id") % 3).cast("string")))
    return load(spark, sf_dir, "events").where(op.isNotNull()).select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), op.alias("op"), paths.alias("delete_paths"))


@query(UNDO_SQL + """, e AS (SELECT project, seq, unnest(paths) AS path, op = 'confirm' AS there FROM log WHERE op <> 'undo' UNION ALL SELECT u.project, u.seq, unnest(l.paths), false FROM undone u JOIN log l ON l.project = u.project AND l.seq = u.confirm)
SELECT project, path FROM (SELECT project, path, max_by(there, seq) AS there FROM e GROUP BY ALL) WHERE there""")
def undo_fold(spark, sf_dir):
    return D.undo_fold(_log(spark, sf_dir))


@query(UNDO_SQL + "SELECT project, seq, confirm FROM undone")
def undone_confirms(spark, sf_dir):
    return D.match_undos(_log(spark, sf_dir))[0]


#: Points of the log at which states are asked for.
ASKED = [40, 150, 600, 2000]
AS_OF_SQL = UNDO_SQL + ", asked AS (SELECT DISTINCT project, unnest([" + ", ".join(map(str, ASKED)) + "])::BIGINT AS upto FROM log) "


def _asked(log: DataFrame) -> DataFrame:
    return log.select("project").distinct().select("project", F.explode(F.array(*[F.lit(n).cast("long") for n in ASKED])).alias("seq"))


@query(AS_OF_SQL + """, e AS (SELECT project, seq, unnest(paths) AS path, op = 'confirm' AS there FROM log WHERE op <> 'undo' UNION ALL SELECT u.project, u.seq, unnest(l.paths), false FROM undone u JOIN log l ON l.project = u.project AND l.seq = u.confirm)
SELECT project, upto AS seq, path FROM (SELECT project, upto, path, max_by(there, seq) AS there FROM e JOIN asked USING (project) WHERE seq <= upto GROUP BY ALL) WHERE there""")
def pending_as_of(spark, sf_dir):
    log = _log(spark, sf_dir)
    return D.pending_as_of(log, _asked(log))


@query(AS_OF_SQL + """, r AS (SELECT DISTINCT project, k % 2 AS cluster_id, 7e0 AS cluster_score, '/p/' || k::VARCHAR AS path, ((k * 5) % 7)::DOUBLE AS score, k // 2 + 1 AS rank FROM log, range(7) t(k)),
gone AS (SELECT DISTINCT l.project, a.upto, unnest(l.paths) AS path FROM log l JOIN asked a ON a.project = l.project AND l.seq <= a.upto LEFT JOIN undone u ON u.project = l.project AND u.confirm = l.seq AND u.seq <= a.upto WHERE l.op = 'confirm' AND u.seq IS NULL),
kept AS (SELECT r.*, a.upto FROM r JOIN asked a USING (project) LEFT JOIN gone g ON g.project = r.project AND g.upto = a.upto AND g.path = r.path WHERE g.path IS NULL)
SELECT project, upto AS seq, cluster_id, path, row_number() OVER (PARTITION BY project, upto, cluster_id ORDER BY score DESC, rank) AS rank, first(path) OVER (PARTITION BY project, upto, cluster_id ORDER BY rank) AS best_image FROM kept""")
def results_as_of(spark, sf_dir):
    """Seven results of each project, as they were at some points of its log."""
    log = _log(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("k")
    results = log.select("project").distinct().select("project", k).select(
        "project", (F.col("k") % 2).alias("cluster_id"), F.lit(7e0).alias("cluster_score"), F.concat(F.lit("/p/"), F.col("k").cast("string")).alias("path"),
        ((F.col("k") * 5) % 7).cast("double").alias("score"), F.expr("k div 2 + 1").alias("rank"),
    )
    return D.results_as_of(results, log, _asked(log)).select("project", "seq", "cluster_id", "path", "rank", "best_image")


@query(WITH_ASSETS + r""", st AS (SELECT asset_id, regexp_extract(path, '([^/]+)$', 1) AS name,
    CASE WHEN NOT (path = '/lib/src1' OR starts_with(path, '/lib/src1/')) THEN 'outside_root' WHEN path NOT IN (SELECT path FROM assets WHERE asset_id % 3 = 0) THEN 'missing' ELSE 'would_move' END AS status FROM assets),
k AS (SELECT *, row_number() OVER (PARTITION BY status, name ORDER BY asset_id) - 1 AS k FROM st)
SELECT asset_id, status, CASE WHEN status = 'would_move' THEN CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) || '_' || k::VARCHAR || regexp_extract(name, '^.+?(\.[^.]*)?$', 1) END END AS dest FROM k""")
def delete_plan(spark, sf_dir):
    a = assets(spark, sf_dir).select("path", F.col("asset_id").alias("seq"))
    return X.delete_plan(a, a.where("seq % 3 = 0"), "/lib/src1").select(F.col("seq").alias("asset_id"), "status", "dest")


@query(SCORED_SQL + "SELECT cluster_id, asset_id, rank = 1 AS keep FROM (SELECT *, max(score) OVER (PARTITION BY cluster_id) AS best FROM ranked) WHERE best >= 0.85e0")
def auto_keep_best(spark, sf_dir):
    named = ranked(spark, sf_dir).withColumn("path", F.col("asset_id"))
    return D.auto_keep_best(named, 0.85).withColumnRenamed("path", "asset_id")


@query(SCORED_SQL + "SELECT cluster_id, asset_id AS a, lead(asset_id) OVER w AS b FROM ranked WINDOW w AS (PARTITION BY cluster_id ORDER BY rank) QUALIFY b IS NOT NULL")
def matchup_pairs(spark, sf_dir):
    return D.matchup_pairs(ranked(spark, sf_dir)).select("cluster_id", "a", "b")


GAMES_SQL = """WITH RECURSIVE g AS (SELECT user_id % 3 AS cluster_id, event_id % 7 AS a, (event_id * 5 + 3) % 11 AS b, event_type IN ('purchase', 'signup') AS first FROM events),
games AS (SELECT cluster_id, CASE WHEN first THEN a ELSE b END AS winner, CASE WHEN first THEN b ELSE a END AS loser FROM g WHERE a <> b) """


def _games(spark, sf_dir):
    a, b, first = F.col("event_id") % 7, (F.col("event_id") * 5 + 3) % 11, F.col("event_type").isin("purchase", "signup")
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("cluster_id"), F.when(first, a).otherwise(b).alias("winner"), F.when(first, b).otherwise(a).alias("loser"))
    return e.where("winner <> loser")


@query(GAMES_SQL + "SELECT winner, count(*) AS n_wins FROM games GROUP BY winner")
def matchup_wins(spark, sf_dir):
    return D.matchup_wins(_games(spark, sf_dir))


@query(GAMES_SQL + """, pairs AS (SELECT cluster_id, item, other, count(*)::DOUBLE AS n, sum(won)::DOUBLE AS won FROM (SELECT cluster_id, winner AS item, loser AS other, 1 AS won FROM games UNION ALL SELECT cluster_id, loser, winner, 0 FROM games) GROUP BY ALL),
totals AS (SELECT cluster_id, item, sum(n) AS n_games, sum(won) AS n_wins FROM pairs GROUP BY ALL),
walk AS (SELECT 0 AS k, cluster_id, item, 1e0 AS s FROM totals
    UNION ALL (WITH now AS (SELECT * FROM walk), m AS (SELECT any_value(x.k) + 1 AS k, p.cluster_id, p.item, (any_value(t.n_wins) + 0.5e0) / (sum(p.n / (x.s + y.s)) + 1e0 / (any_value(x.s) + 1e0)) AS s
        FROM pairs p JOIN now x ON x.cluster_id = p.cluster_id AND x.item = p.item JOIN now y ON y.cluster_id = p.cluster_id AND y.item = p.other JOIN totals t ON t.cluster_id = p.cluster_id AND t.item = p.item WHERE x.k < 150 GROUP BY p.cluster_id, p.item)
        SELECT k, cluster_id, item, s * exp(-(sum(2 * s / (s + 1) - 1) OVER c) / (sum(2 * s / ((s + 1) * (s + 1))) OVER c)) FROM m WINDOW c AS (PARTITION BY cluster_id)))
SELECT cluster_id, item, n_games::BIGINT AS n_games, n_wins::BIGINT AS n_wins, round(s, 4) AS strength FROM walk JOIN totals USING (cluster_id, item) WHERE k = 150""")
def matchup_strengths(spark, sf_dir):
    """Games between the days and weeks of events; 150 rounds of the recursion are as good as convergence."""
    return D.matchup_strengths(_games(spark, sf_dir)).select("cluster_id", "item", "n_games", "n_wins", r("strength"))


# User models, with plain functions in their place
def _pool_model():
    """Token 0 and the mean of the patches, of 8 tokens of 8 values."""

    def run(x: np.ndarray) -> np.ndarray:
        tokens = np.asarray(x, np.float64).reshape(len(x), 8, 8)
        return np.concatenate([tokens[:, 0], tokens[:, 3:].mean(axis=1)], axis=1)

    return run


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings),
p AS (SELECT vec_id, k % 8 AS pos, max((x + y) / 2) FILTER (WHERE k // 8 = 0) AS head, avg((x + y) / 2) FILTER (WHERE k // 8 >= 3) AS patch FROM v GROUP BY ALL),
a AS (SELECT vec_id, pos + 1 AS pos, head AS v FROM p UNION ALL SELECT vec_id, pos + 9, patch FROM p), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM a GROUP BY vec_id)
SELECT vec_id, pos, round(v / n, 6) + 0e0 AS v FROM a JOIN n USING (vec_id)""")
def embed_pooled(spark, sf_dir):
    """A model in batches, over a row and its mirror image: pooled, averaged, normalised."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("mirrored", F.reverse("x"))
    out = M.embed(e, "x", _pool_model, flipped_col="mirrored", input_shape=[64])
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), r("v", 6))


def _strict_model():
    """Fails on a batch with a value it doesn't take."""

    def run(values: list) -> list:
        if any(v > 60 for v in values):
            raise ValueError("out of range")
        return [2 * v for v in values]

    return run


def _missing_model():
    raise ImportError("no weights")


@query("SELECT event_id, round(CASE WHEN value > 60 THEN 0e0 ELSE 2e0 * value END, 6) AS strict FROM events")
def score_metrics(spark, sf_dir):
    """A scorer that fails for some rows, and so for most batches, beside one that can't be made."""
    out = M.score_metrics(load(spark, sf_dir, "events").select("event_id", "value"), "value", {"strict": _strict_model, "missing": _missing_model})
    return out.drop("value").select("event_id", *[r(c, 6) for c in out.columns if c in ("strict", "missing")])


def _contrast(grid: np.ndarray) -> float:
    if grid.max() < 0.8:
        raise ValueError("too dark")
    return float(grid.max() - grid.min())


@query(GRID_SQL + " SELECT asset_id, round(CASE WHEN max(luma) < 0.8e0 THEN 0e0 ELSE max(luma) - min(luma) END, 6) + 0e0 AS contrast FROM g GROUP BY asset_id")
def pixel_metric(spark, sf_dir):
    return grids(assets(spark, sf_dir)).select("asset_id", M.pixel_metric(F.col("luma"), _contrast).alias("contrast")).select("asset_id", r("contrast", 6))
