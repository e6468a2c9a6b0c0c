"""Keepers, collision-free names and deletion plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.functions.paths import basename, dot_suffix, is_inside, stem
from assetloom.operators.positions import with_rank


def keepers(images: DataFrame, deleted: DataFrame) -> DataFrame:
    """All images but the deleted ones."""
    return images.join(deleted.select("path").distinct(), "path", "left_anti")


def export_plan(sources: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(path, seq, dest): a free name for each source, given out in order of ``seq``. A source gets its own name if it is
    free, else stem_1, stem_2, ... Sources of one stem and suffix are numbered together; a number that another source
    owns as its plain name, or that is taken, is skipped and the rest move on, until no name is given twice: every round
    settles the first of each name at least. Only names that occur more than once are put in order, and later rounds hold
    only what has clashed."""
    named = sources.select("path", "seq", basename(F.col("path")).alias("name")).withColumns({"stem": stem(F.col("name")), "suffix": dot_suffix(F.col("name"))})
    used = taken.select(F.col("name").alias("dest")).distinct() if taken is not None else named.sparkSession.createDataFrame([], "dest string")
    busy = lambda on: used.select(F.col("dest").alias(on), F.lit(True).alias("busy")).distinct()
    repeated = materialize(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "export-names")
    several, single = named.join(repeated, "name", "left_semi"), named.join(repeated, "name", "left_anti")
    numbered = with_rank(several, "name", ["seq", "path"], "k").unionByName(single.withColumn("k", F.lit(1).cast("long")))
    ranked = materialize(numbered.join(busy("name"), "name", "left"), "export")
    own = F.col("k").eqNullSafe(1) & F.col("busy").isNull()
    done = [ranked.where(own).select("path", "seq", F.col("name").alias("dest"))]
    # The first has the plain name, unless that is taken.
    open_rows = ranked.where(~own).select("path", "seq", "stem", "suffix", "name", (F.col("k") - F.col("busy").isNull().cast("long")).alias("at"))
    while not open_rows.isEmpty():
        given = used.unionByName(reduce(DataFrame.unionByName, done).select("dest")).distinct().select(F.col("dest").alias("try"), F.lit(True).alias("busy"))
        tried = open_rows.withColumn("try", F.concat("stem", F.lit("_"), F.col("at").cast("string"), "suffix"))
        # One name may be tried from two stems, a few rows: the first source gets it.
        first = F.row_number().over(W.partitionBy("try").orderBy("seq", "path")) == 1
        tried = tried.withColumn("first", first).join(given, "try", "left").withColumn("ok", F.col("first") & F.col("busy").isNull())
        # What stays open goes on after the numbers that its name has tried.
        last = tried.groupBy("name").agg(F.max("at").alias("last"))
        tried = materialize(tried.join(last, "name").select("path", "seq", "stem", "suffix", "name", "try", "ok", "last"), "export-round")
        done.append(tried.where("ok").select("path", "seq", F.col("try").alias("dest")))
        left = tried.where("not ok")
        if left.isEmpty():
            break
        open_rows = with_rank(left, "name", ["seq", "path"], "turn").select("path", "seq", "stem", "suffix", "name", (F.col("last") + F.col("turn")).alias("at"))
    return reduce(DataFrame.unionByName, done)


def delete_plan(listed: DataFrame, inventory: DataFrame, root: str, taken: DataFrame | None = None) -> DataFrame:
    """``listed`` (path, seq, ...) with status: outside_root, missing or would_move, in that order of precedence, and dest:
    a free name in the trash for what would move, given out in order of ``seq`` beside the ``taken`` names there."""
    there = inventory.select("path").distinct().withColumn("__there", F.lit(True))
    status = F.when(~is_inside(F.col("path"), root), "outside_root").when(F.col("__there").isNull(), "missing").otherwise("would_move")
    plan = materialize(listed.join(there, "path", "left").withColumn("status", status).drop("__there"), "delete-plan")
    names = export_plan(plan.where("status = 'would_move'").select("path", "seq"), taken)
    return plan.join(names, ["path", "seq"], "left")


def delete_summary(plan: DataFrame) -> DataFrame:
    """One row: moved and skipped."""
    return plan.agg(F.count_if(F.col("status") == "would_move").alias("n_moved"), F.count_if(F.col("status") != "would_move").alias("n_skipped"))
