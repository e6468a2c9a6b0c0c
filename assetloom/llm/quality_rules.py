"""Quality rules with adaptive thresholds (operator 5). DataFrame functions only.

Fixed cutoffs are replaced by upper fences of each measure within a document's (language, source) group, taken over the
documents that pass the base rules and show the measure. All measures are shares, spread over orders of magnitude below a
half and crowded below one, so they are compared as odds on a logarithmic scale: a fence lies ``reach`` quartile distances
above the upper quartile there, and as a share it is always a value below one.

The sketches are mergeable: odds fall into logarithmic bins of relative width 2 * accuracy, and a sketch is the count of each
bin. Counts add up, so partial sketches merge exactly and in any order; those of languages and of all documents come from
the groups' sketches. A small group knows little of its own spread: its sketch is merged with that of its language, scaled to
``weight`` documents, the language's with that of all documents, and that one with ``blank_weight`` documents that say
nothing, as they are spread over all bins alike. So fences pass continuously from a group's own documents to its parents' as the group gets
smaller. Counts are whole numbers throughout. A document is kept if it passes the base rules and no measure is above its
fence. A merged sketch has a row for each of BINS bins, group and measure.

Rows are measured once and written with their measures; a verdict then needs the fences of the row's group only, which
are broadcast where they are few, so no text is moved.

Defined cases: a null or blank text has no words, so its base rules fail; null languages and sources are groups of
their own; repeated rows each count and are each judged and returned; an empty table gives an empty result; other
columns are not read by the measures, and ``filter_quality`` passes them through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.llm.text import SYMBOLS, count_chars, lines_of, n_letters, n_upper, ratio, words_of

#: Shares of: characters of words that are no letter, mark or digit; symbols; repeated lines; words in repeated windows;
#: upper case among letters; exclamation marks among words and these.
MEASURES = ["mark_ratio", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio"]
#: Fences of so many groups are broadcast at most; those of more are joined by shuffle, dealt over SALTS.
BROADCAST_GROUPS, SALTS = 100_000, 64
#: Least odds that a bin tells from none, and the number of bins above it, the last without an end.
TINY, BINS = 1e-4, 1151


def _covered(starts: Column) -> Column:
    """Positions covered by 3-word windows at the sorted ``starts``: each adds the gap to the next, at most 3."""
    step = F.transform(starts, lambda s, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(starts, k + 1) - s, F.lit(3).cast("long"))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``docs`` (with w, the words) with starts: the sorted positions of 3-word windows that occur twice or more.

    Each window becomes one long: its hash above, its position in the low bits. After a sort equal windows are
    neighbours, and neighbours with equal hashes are compared word by word. Where two different windows share a hash,
    they could stand between equal ones, so the windows of that text are sorted by their words instead."""
    n, at = F.size("w"), lambda i: F.get(F.col("w"), i)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    tag = lambda i: F.call_function("shiftleft", window_hash(at(i), at(i + 1), at(i + 2)), F.col("bits")).bitwiseOR(i.cast("long"))
    firsts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    place, top = lambda x: x.bitwiseAND(low).cast("int"), lambda x: F.call_function("shiftright", x, F.col("bits"))

    def equal(p: Column, q: Column) -> Column:
        return (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))

    def to_next(x: Column, k: Column) -> Column:
        """0 if the next window's hash differs, 1 if the next is equal, 2 if only its hash is."""
        y = F.get(F.col("s"), k + 1)
        return F.when(y.isNull() | (top(x) != top(y)), 0).when(equal(place(x), place(y)), 1).otherwise(2)

    def of_pair(codes: str):
        return lambda _, k: (F.get(F.col(codes), k) == 1) | (F.coalesce(F.get(F.col(codes), k - 1), F.lit(0)) == 1)

    docs = docs.withColumn("bits", F.length(F.bin(n.cast("long")))).withColumn("s", F.sort_array(F.when(n >= 3, F.transform(firsts, tag))))
    docs = docs.withColumn("next", F.transform("s", to_next))
    fast = F.transform(F.filter("s", of_pair("next")), lambda x: x.bitwiseAND(low))
    # The slow order is made where it is needed only.
    by_words = F.sort_array(F.transform(firsts, lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))))
    docs = docs.withColumn("words", F.when(F.array_contains("next", 2), F.transform(by_words, lambda x: x["i"])))
    docs = docs.withColumn("word_next", F.transform("words", lambda p, k: F.coalesce(equal(p, F.get(F.col("words"), k + 1)), F.lit(False)).cast("int")))
    slow = F.transform(F.filter("words", of_pair("word_next")), lambda p: p.cast("long"))
    return docs.withColumn("starts", F.sort_array(F.when(F.col("words").isNull(), fast).otherwise(slow)))


def measure(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[Column] | None = None) -> DataFrame:
    """carry..., lang, source, the counts and the ratio measures of every document, over its whole text."""
    kept = [c.alias(f"kept_{k}") for k, c in enumerate(carry or [])]
    names = [f"kept_{k}" for k in range(len(kept))]
    base = docs.select(*kept, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("w", words_of(F.col("t"))).withColumn("lines", lines_of(F.col("t")))
    base, n = repeated_windows(base), F.size("w")
    marks = F.length(F.regexp_replace("t", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    text, n_lines = F.col("t"), F.size("lines")
    counts = base.select(
        *names,
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        count_chars(text, "!").cast("long").alias("n_bangs"),
        n_letters(text).alias("letters"),
        n_upper(text).alias("upper"),
        marks.alias("n_marks"),
    )
    share = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    return counts.select(
        *names,
        *("lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_marks", "word_chars", "mark_ratio"),
        share("n_symbols", "word_chars", "symbol_ratio"),
        share("n_dup_lines", "n_lines", "dup_line_ratio"),
        share("n_repeat_words", "n_words", "repeat_ratio"),
        share("upper", "letters", "upper_ratio"),
        ratio(F.col("n_bangs"), F.col("n_bangs") + F.col("n_words")).alias("bang_ratio"),
    )


def _odds(share: Column) -> Column:
    """share / (1 - share); null for 1, which is above everything."""
    return F.when(share < 1, share / (1 - share))


def sketch(measured: DataFrame, measures: list[str], accuracy: float) -> DataFrame:
    """(lang, source, measure, bin, n): the mergeable sketches. Bin 0 holds odds up to TINY."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    width = F.log(F.lit((1 + accuracy) / (1 - accuracy)))
    odds = _odds(F.col("p.value"))
    place = F.when(odds.isNull(), BINS).when(odds > TINY, F.least(F.ceil(F.log(odds / TINY) / width), F.lit(BINS))).otherwise(0)
    return measured.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", F.col("p.measure").alias("measure"), place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _merged(own: DataFrame, parent: DataFrame, by: list[str], above: list[str], weight: int) -> DataFrame:
    """(by..., measure, bin, w, whole): own counts (by..., measure, bin, n) beside the parent's sketch (above..., measure, bin, w,
    whole) scaled to ``weight`` documents. whole is the sum of w. Both are multiplied by the parent's whole, so they stay
    whole numbers."""
    total = own.groupBy(*by, "measure").agg(F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("own_n"))
    bins = total.join(parent, [*above, "measure"]).join(own.where("bin > 0"), [*by, "measure", "bin"], "left")
    exact = lambda c: c.cast("decimal(38,0)")
    w = exact(F.coalesce("n", F.lit(0)) * F.col("whole")) + exact(F.lit(weight) * F.col("w"))
    return bins.select(*by, "measure", "bin", w.cast("decimal(38,0)").alias("w"), exact((F.col("own_n") + weight) * F.col("whole")).alias("whole"))


def fences(sketches: DataFrame, accuracy: float, reach: float, weight: int, blank_weight: int) -> DataFrame:
    """(lang, source, measure, fence): the odds above which a share is rejected, from each group's merged sketch."""
    count = lambda *by: sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").cast("decimal(20,0)").alias("n"))
    every = sketches.select("measure").distinct().select("measure", F.explode(F.sequence(F.lit(1), F.lit(BINS))).alias("bin"))
    blank = every.select("measure", "bin", F.lit(1).cast("decimal(20,0)").alias("w"), F.lit(BINS).cast("decimal(20,0)").alias("whole"))
    whole = materialize(_merged(count(), blank, [], [], blank_weight), "quality-all")
    lang = materialize(_merged(count("lang"), whole, ["lang"], [], weight), "quality-lang")
    group = _merged(count("lang", "source"), lang, ["lang", "source"], ["lang"], weight)
    part = W.partitionBy("lang", "source", "measure").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    run = group.withColumn("upto", F.sum("w").over(part))
    q = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("whole"), F.col("bin")))
    quart = run.groupBy("lang", "source", "measure").agg(q(1).alias("b25"), q(3).alias("b75"))
    # The upper end of the bin, so that values like the quartile itself are never above.
    edge = F.lit(TINY) * F.pow(F.lit((1 + accuracy) / (1 - accuracy)), F.col("b75") + F.lit(float(reach)) * (F.col("b75") - F.col("b25")))
    return quart.select("lang", "source", "measure", edge.alias("fence"))


def with_verdict(docs: DataFrame, carry: list[Column], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", accuracy: float = 0.01, reach: float = 3.0, weight: int = 200, blank_weight: int = 20, measures: list[str] | None = None) -> DataFrame:
    """kept_0, kept_1, ... (the ``carry`` columns), the counts, base_failed, kept and the measures of every row."""
    measures = measures or MEASURES
    # Null groups get keys of their own, so that the joins below are plain equi-joins.
    key = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c).cast("string")))
    measured = measure(docs, text_col, lang_col, source_col, carry).withColumns({"lang": key("lang"), "source": key("source")})
    measured = materialize(measured, "quality")
    sketches = materialize(sketch(measured.where(~F.col("base_failed")), measures, accuracy), "quality-sketch")
    found = fences(sketches, accuracy, reach, weight, blank_weight).groupBy("lang", "source")
    limits = found.agg(F.struct(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"fence_{m}") for m in measures]).alias("limit"))
    limits = materialize(limits, "quality-limits")
    if limits.count() <= BROADCAST_GROUPS:
        judged = measured.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        # A group may hold a third of all rows: it is dealt over salts, and the limits, one row per group, go to each.
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = measured.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, ["lang", "source", "salt"], "left")
    over = lambda m: F.coalesce(F.coalesce(_odds(F.col(m)), F.lit(float("inf"))) > F.col(f"limit.fence_{m}"), F.lit(False))
    above = reduce(lambda a, m: a | over(m), measures, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~above)


def judge(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, the measures."""
    out = with_verdict(docs, [F.col(id_col)], **options)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(F.col("kept_0").alias(id_col), *counts, *(options.get("measures") or MEASURES))


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, columns unchanged. Each row has a verdict of its own."""
    return with_verdict(docs, [F.struct("*")], **options).where("kept").select("kept_0.*")
