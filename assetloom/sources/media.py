"""Sources: media listings, pending lists, result documents, feature tables, pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.common import exists
from assetloom.functions.paths import basename, is_media, parent

IMAGES = "array<struct<path:string,score:double,centrality:double,rank:int,exif_timestamp:double,score_components:map<string,double>>>"
RESULTS = f"schema_version int, clusters array<struct<cluster_id:long,cluster_score:double,best_image:string,images:{IMAGES}>>"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def media_inventory(files: DataFrame, required: bool = False) -> DataFrame:
    """The media files of a listing, without repeats. With ``required`` an empty one is an error."""
    found = files.where(is_media(F.col("path"))).dropDuplicates(["path"])
    if required and found.isEmpty():
        raise ValueError("no media files found")
    return found


def dir_image_counts(files: DataFrame) -> DataFrame:
    """(dir, name, n_images): media files that are direct children of each directory. Hidden directories are left out,
    directories without images stay with 0."""
    by_dir = files.groupBy(parent(F.col("path")).alias("dir")).agg(F.count_if(is_media(F.col("path"))).alias("n_images"))
    return by_dir.withColumn("name", basename(F.col("dir"))).where(~F.col("name").startswith("."))


def read_pending(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(path): the lines of a pending list that aren't blank, repeats included. A missing file is an empty list."""
    try:
        lines = spark.read.text(path)
        lines.limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string")
    return pending_lines(lines, strip)


def pending_lines(lines: DataFrame, strip: bool = False) -> DataFrame:
    kept = lines.where(F.trim("value") != "")
    return kept.select((F.trim("value") if strip else F.col("value")).alias("path"))


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per image of a results document, or with ``lines`` of files of one document per line; absent fields are
    null."""
    docs = spark.read.schema(RESULTS).option("multiLine", not lines).json(path)
    clusters = docs.select(F.inline("clusters"))
    return clusters.select("cluster_id", "cluster_score", "best_image", F.inline("images"))


def read_deleted(spark: SparkSession, curation_path: str | None, legacy_path: str | None) -> DataFrame:
    """(path): the deleted set of a curation document, if it is there, else the lines of a legacy list without blanks around
    them, else nothing."""
    if curation_path and exists(spark, curation_path):
        return spark.read.schema("deleted array<string>").option("multiLine", True).json(curation_path).select(F.explode("deleted").alias("path"))
    if legacy_path:
        return read_pending(spark, legacy_path, strip=True)
    return spark.createDataFrame([], "path string")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, luma ARRAY<DOUBLE> row by row) of decodable images; others keep their row with a null grid."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder).select("image.*")
    return images.mapInPandas(_luma, "path string, width int, height int, luma array<double>")


def _luma(batches):
    import numpy as np
    import pandas as pd

    for pdf in batches:
        grids = []
        for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
            if w <= 0:
                grids.append(None)
                continue
            x = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64) / 255
            # Channels come as blue, green, red; fixed values: luma weights.
            grids.append((0.299 * x[..., 2] + 0.587 * x[..., 1] + 0.114 * x[..., 0]).ravel() if c >= 3 else x[..., 0].ravel())
        yield pd.DataFrame({"path": pdf["origin"], "width": pdf["width"], "height": pdf["height"], "luma": grids})
