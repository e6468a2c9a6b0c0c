"""Mixing sources to target weights by entropy balancing (operator 10).

Targets: each source asks for a share of ``budget`` times all words, by weight; no source gets more than
``max_copies`` times its own words, and what it cannot take is reshared by weight among the others.

Rates: among all document rates r in [0, max_copies] that meet the sources' word targets, take those closest to
"every document once" in relative entropy. The solution is an exponential tilt, r = min(max_copies, exp(a * size / mean
size)), with one dual variable per source. Newton steps on the dual need two sums per source, which Spark computes over
the (source, size) histogram; each step is one grouped aggregation over all sources together.

Copies: documents of one source and one size are alike. Walking the sizes of a source from large to small, each size
gets the whole number of copies nearest to its expected words plus the error carried from the sizes before, so a source
misses its target by about half of its smallest documents. Inside a size the copies are dealt by hash rank, and ranks
are counted in salted buckets of bounded size.

Defined cases: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, last in order;
repeated rows count as separate documents; an empty table gives an empty result; a null id is hashed like any value;
other columns are not read by ``mix_sources``, and pass through ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import discard, materialize
from assetloom.llm.distinct import distinct_rows

WORD = r"[^\x20\x09-\x0D]+"
#: Stands for the null source; other keys start with "s".
NULL_KEY = "n"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(hist: DataFrame, weights: tuple[int, ...], budget: float, max_copies: int) -> DataFrame:
    """(key, source_size, n_docs, target) from the (key, size, n) histogram. The capped sources are those with the
    smallest cap-to-weight ratio, so resharing until none is above its cap is one running sum over the sources."""
    per = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    # One row per source from here on: an unpartitioned window over it is small.
    ranked = per.withColumn("pos", F.row_number().over(W.orderBy(F.col("key") == NULL_KEY, F.col("key").cast("binary"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "pos")
    level = (
        caps.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("weight_left"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        # Levels fall from the first source that isn't capped on; its level holds for all that aren't.
        .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy()))
    )
    return level.select("key", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def tilted_rate(max_copies: int) -> Column:
    """exp(tilt * size / mean size), at most max_copies."""
    return F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(max_copies)))


def balance(hist: DataFrame, targets: DataFrame, max_copies: int, tol: float, max_iter: int) -> DataFrame:
    """(key, tilt, scale, full) meeting the targets. Each step is one distributed aggregation over the size histogram.
    Newton steps are kept inside a shrinking bracket, so a step that overshoots becomes a bisection. ``full`` marks
    sources that take everything max_copies times: their tilt would be infinite."""
    nothing = F.lit(None).cast("double")
    state = materialize(
        targets.where("source_size > 0").select(
            "key", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"), (F.col("target") >= F.col("source_size") * max_copies * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("tilt"), nothing.alias("low"), nothing.alias("high"), F.lit(True).alias("open"),
        ),
        "mix-state",
    )
    for _ in range(max_iter):
        rate = tilted_rate(max_copies)
        words = F.col("n") * F.col("size")
        sums = (
            hist.join(state.where("open and not full"), "key")
            .groupBy("key")
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < max_copies, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        moved = state.join(sums, "key", "left").withColumn("low", F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        outside = F.when(F.col("low").isNull(), F.col("tilt") * 2 - 1).when(F.col("high").isNull(), F.col("tilt") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        still = F.coalesce(~F.col("full") & (F.abs(gap) > F.lit(tol) * F.col("target")), F.lit(False))
        before, state = state, materialize(moved.select("key", "target", "scale", "full", F.when(~still, F.col("tilt")).when(inside, newton).otherwise(outside).alias("tilt"), "low", "high", still.alias("open")), "mix-state")
        discard(before)
        if state.where("open").isEmpty():
            break
    return state.select("key", "tilt", "scale", "full")


def _round_sizes(max_copies: int):
    import pandas as pd

    def of_source(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source: its sizes from large to small, the rounding error carried along."""
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        carry, copies = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            want = n * size * rate
            k = min(max(int((want + carry) / size + 0.5), 0), int(n) * max_copies) if size > 0 else 0
            carry += want - k * size
            copies.append(k)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "n": pdf["n"], "rate": pdf["rate"], "of_size": copies})

    return of_source


#: Plans of so many (source, size) rows are broadcast at most, about 10 MB; those of more are joined by shuffle.
BROADCAST_PLAN = 200_000


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *carry: Column) -> DataFrame:
    """(id, th, key, size, h, carry...), written once."""
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit(NULL_KEY)).otherwise(F.concat(F.lit("s"), source))
    id_, th = F.col(id_col), F.xxhash64(text_col)
    return materialize(docs.select(id_.alias("id"), th.alias("th"), key.alias("key"), n_words(F.col(text_col)).alias("size"), F.xxhash64(id_, th).alias("h"), *carry), "mix-sizes")


def _plan(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_copies: int, tol: float, max_iter: int) -> DataFrame:
    """(key, size, n, rate, of_size, source_size, target): how many copies the documents of a source and size get."""
    hist = materialize(sizes.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = materialize(source_targets(hist, weights, budget, max_copies), "mix-targets")
    tilt = balance(hist, targets, max_copies, tol, max_iter)
    rate = F.when(F.col("full"), F.lit(float(max_copies))).otherwise(tilted_rate(max_copies))
    rated = hist.join(tilt, "key", "left").select("key", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    # A source is one group here, but of its distinct sizes only: at most as many rows as its longest document has words.
    rounded = rated.groupBy("key").applyInPandas(_round_sizes(max_copies), "key string, size long, n long, rate double, of_size long")
    return materialize(rounded.join(targets.drop("n_docs"), "key"), "mix-plan")


def _ranked(sizes: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """(id, th, key, size, h, the plan, extra): whether a document is among those of its size that get one copy more. The
    rank inside a size is the rows of the buckets before, plus the rank inside the bucket."""
    bucket = F.pmod(F.col("h"), F.ceil(F.col("n") / bucket_rows)).alias("bucket")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_PLAN else plan
    dealt = sizes.select("id", "th", "key", "size", "h").join(plan, ["key", "size"]).withColumn("bucket", bucket)
    counts = dealt.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("key", "size", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    in_bucket = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("h", "id", "th"))
    ranked = dealt.withColumn("in_bucket", in_bucket).join(offsets, ["key", "size", "bucket"])
    return ranked.withColumn("extra", F.col("offset") + F.col("in_bucket") <= F.col("of_size") % F.col("n"))


def _copies(extra: Column) -> Column:
    return F.floor(F.col("of_size") / F.col("n")).cast("long") + extra.cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_copies: int = 2, tol: float = 1e-6, max_iter: int = 60, bucket_rows: int = 512) -> DataFrame:
    """One row per input row: id, th (hash of the text), source, size, source_size, target, rate, copies, taken (words: copies * size)."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    ranked = _ranked(sizes, _plan(sizes, weights, budget, max_copies, tol, max_iter), bucket_rows)
    copies, source = _copies(F.col("extra")), F.when(F.col("key") != NULL_KEY, F.substring("key", 2, 1 << 30))
    return ranked.select(F.col("id").alias(id_col), "th", source.alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_copies: int = 2, tol: float = 1e-6, max_iter: int = 60, bucket_rows: int = 512) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken (names of the table's own columns
    get "mix_" before). Equal rows of one id and text are one document. A document is in the first ranks of its size if
    its hash is not above the last one's, so the texts stay where they are."""
    sizes = _sizes(distinct_rows(docs, id_col, text_col), id_col, text_col, source_col, F.struct("*").alias("row"))
    plan = _plan(sizes, weights, budget, max_copies, tol, max_iter)
    last = _ranked(sizes, plan, bucket_rows).where("extra").groupBy("key", "size").agg(F.max("h").alias("last"))
    plan = materialize(plan.join(last, ["key", "size"], "left").where("of_size > 0"), "mix-last")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_PLAN else plan
    copies = _copies(F.coalesce(F.col("h") <= F.col("last"), F.lit(False)))
    taken = sizes.join(plan, ["key", "size"]).withColumn("copies", copies).where("copies > 0").withColumn("taken", F.col("copies") * F.col("size"))
    name = lambda c: f"mix_{c}" if c in docs.columns else c
    return taken.select("row.*", *[F.col(c).alias(name(c)) for c in ("size", "source_size", "target", "copies", "taken")])
