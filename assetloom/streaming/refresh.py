"""The incremental refresh run over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_target(spark: SparkSession, target: str, but: str | None = None) -> DataFrame | None:
    """The table of all parts written so far, or of all ``but`` one; None where there is none."""
    try:
        rows = spark.read.option("basePath", target).parquet(f"{target.rstrip('/')}/part=*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    named = rows.withColumn("part", F.col("part").cast("string"))
    return named if but is None else named.where(F.col("part") != but)


def refresh_part(batch: DataFrame, target: str, part: str, compute: Callable[[DataFrame], DataFrame]) -> None:
    """Computes the rows of ``batch`` (path, ...) that no other part of ``target`` holds, as the part of that name. A part
    that is there, whole or cut short, is written anew, so a batch that runs twice leaves what it left at first."""
    rows = batch.dropDuplicates(["path"])
    known = read_target(batch.sparkSession, target, part)
    fresh = rows if known is None else rows.join(known.select("path"), "path", "left_anti")
    compute(fresh).write.mode("overwrite").parquet(f"{target.rstrip('/')}/part={part}")


def refresh_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Computes the rows of new parquet files below ``source`` (with a path column) that ``target`` lacks. Handles what is
    there and ends; call it again for later files. A part belongs to a batch of this stream, whose id its checkpoint keeps:
    after a failure Spark repeats the batch, which overwrites its own part, and a stream with another checkpoint never
    overwrites a part of this one."""

    def one(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        refresh_part(batch, target, f"{stream}-{number}", compute)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
