"""The corpus pipeline: five stages from raw documents to a mix, each written and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.common import Scratch, discard, load, materialize
from assetloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that consisted of nothing else; n_chars follows the text. Documents without an
    id come after the others, by a hash of the text; ids that are no whole numbers come in their own order."""
    unnamed = F.lit(1 << 62).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    order = F.coalesce(F.col("doc_id").cast("long"), unnamed) if whole else F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), unnamed).alias("text"))
    has_words = F.coalesce(F.col("text").rlike(line_dedup.WORD), F.lit(False))
    out = line_dedup.dedup_lines(docs.where(has_words), order).where(has_words)
    out = out.unionByName(docs.where(~has_words))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.drop_near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), short_items=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies. Equal rows of one id and text are one document."""
    return mixing.mix_documents(docs)


_STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
]
#: Tables under the results of the stages that were called one by one, by session, corpus and stage, in the order of the calls.
_LEFT: dict[tuple[str, str, int], list[Scratch]] = {}


def _alone(k: int, stage: Stage) -> Stage:
    """A stage for those who call the stages one by one, write each result and give what they reread to the next. The call
    of a stage deletes what the earliest open call of the one before it, over the same corpus, has left."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        corpus, own = (spark.sparkContext.applicationId, sf_dir), Scratch()
        before = _LEFT.get((*corpus, k - 1), [])
        if before:
            before.pop(0).delete(spark, but_for=docs)
        with own:
            out = stage(spark, docs, sf_dir)
        _LEFT.setdefault((*corpus, k), []).append(own)
        return out

    return run_stage


STAGES = [(name, _alone(k, stage)) for k, (name, stage) in enumerate(_STAGES)]

#: The near-duplicate and mixing stages aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's output and what it wrote on its way go when the next one's is written; nothing is shared with another run.
    The tables of the last stage stay, as its result is read from them."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in _STAGES[:-1]:
        scratch = Scratch()
        with scratch:
            out = stage(spark, docs, sf_dir)
        after = materialize(out, name.replace(" ", "-"))
        scratch.delete(spark)
        discard(docs)
        docs = after
    return _STAGES[-1][1](spark, docs, sf_dir)
