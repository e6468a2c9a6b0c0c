"""Line dedup by a deletion-neighbourhood join (operator 1). DataFrame functions only.

A line goes if an earlier line of the corpus is equal to it or one edit (a character inserted, removed or replaced) away
from it. Earlier means by (id, line number). Lines without a word stay. Lines of fewer than ``min_chars`` characters go
for equal lines only; by default there is no such line.

Equal lines meet by a 128-bit hash. For the edits, one deletion neighbourhood is taken at several scales, each on what
the one before has left; none of them loses a pair within the bound:
- halves: of two such lines, one half is equal. Lines of m * 16 to m * 16 + 15 characters are cut alike (one at the
  lower end also as the longer partner of the class below). Lines that share no half with another line are done;
- sixteenths: all but one of 16 segments are equal, which also fixes the segment that holds the edit. A segment of more
  than SHORT characters is cut again in the same way, so the work is linear in the length of a line;
- characters: the variants of what is left, each with one character removed, and the whole of it, are emitted as hashed
  keys. Equal variants of equal position mean a replaced character; a variant equal to a whole one an inserted one.
A group of equal variants passes on its earliest member only, never its pairs. Candidates are verified on the
whole lines.

Defined cases: null texts have no lines and stay null; rows with a null id keep their lines and remove none; ids may be
of any type with an order; repeated rows (same id and text) are one document, so all of them keep or lose the same
lines; rows that share an id but not the text are told apart by a hash of the text; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import possible_rows, split_possible
from assetloom.llm.rows import as_column, field, packed, unpacked

WORD = r"[^\x20\x09-\x0D]"
AT = ["id", "no", "th"]
#: Up to so many characters the variants are those of the whole.
SHORT = 32


def _classes(n: Column) -> Column:
    """The length classes of a line of n > SHORT characters: its own, and the one below if it is at the lower end."""
    m = F.floor(n / 16).cast("int")
    return F.when(n % 16 == 0, F.array(m, m - 1)).otherwise(F.array(m))


def _half_lengths(n: Column) -> Column:
    """Lengths of the halves of a line of n characters. A line just above SHORT also partners one of SHORT."""
    short = F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int"))
    long = F.transform(_classes(n), lambda m: m * 8)
    return F.array_distinct(F.when(n <= SHORT, short).when(n == SHORT + 1, F.concat(short, long)).otherwise(long))


def _halves(line: Column, n: Column) -> Column:
    def half(h: Column) -> Column:
        return F.array(F.xxhash64(h, F.lit(0), F.substring(line, F.lit(1), h)), F.xxhash64(h, F.lit(1), F.substring(line, n - h + 1, h)))

    return F.flatten(F.transform(_half_lengths(n), half))


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Rows of ``keyed`` whose key several rows have. The counts are one row per key, so a key of many rows can be split."""
    several = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key)
    return keyed.join(several, key)


def line_table(docs: DataFrame, id_col: str | Column, text_col: str, min_chars: int) -> DataFrame:
    """(id, no, th, h1, h2, halves) of every line with a word."""
    known = docs.where(as_column(id_col).isNotNull() & F.col(text_col).isNotNull())
    d = known.select(as_column(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    n = F.length("line")
    halves = F.when(n >= min_chars, _halves(F.col("line"), n))
    return d.where(F.col("line").rlike(WORD)).select(*AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), halves.alias("halves"))


def _sixteenths(long: DataFrame) -> DataFrame:
    """(at, rest, mid): each row cut at each of 16 segments into the segment and a hash of the rest."""
    n = F.length("mid")
    cut = long.select("at", "rest", "mid", n.alias("n"), F.explode(_classes(n)).alias("m"))
    cut = cut.select("at", "rest", "mid", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    left, right = F.col("j") * F.col("m"), (15 - F.col("j")) * F.col("m")
    before, after = F.substring("mid", F.lit(1), left), F.substring("mid", F.col("n") - right + 1, right)
    return cut.select("at", F.xxhash64("rest", "m", "j", before, after).alias("rest"), F.substring("mid", left + 1, F.col("n") - left - right).alias("mid"))


def _variants(ends: DataFrame) -> DataFrame:
    """(at, role, key): what is left of each line, whole and with each of its characters removed."""
    size = F.length("mid")

    def key(role: str, h: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), h.alias("key"))

    def without(i: Column) -> Column:
        rest = F.concat(F.substring("mid", F.lit(1), i - 1), F.substring("mid", i + 1, size))
        return F.array(key("removed", F.xxhash64("rest", F.lit(-1), rest)), key("replaced", F.xxhash64("rest", i, rest)))

    removed = F.flatten(F.transform(F.sequence(F.lit(1), size), without))
    whole = F.array(key("whole", F.xxhash64("rest", F.lit(-1), "mid")))
    return ends.select("at", F.explode(F.concat(whole, removed)).alias("v")).select("at", "v.role", "v.key")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts are one edit apart: past their longest common start and one character, they are equal. The start
    is found by halving, so that long lines take n log n steps; levenshtein() takes n * n, also below a bound."""
    n, m = F.length(a), F.length(b)
    steps = F.sequence(F.ceil(F.log2(F.greatest(F.least(n, m), F.lit(1)) + 1.0)).cast("int"), F.lit(0))

    def longer(start: Column, k: Column) -> Column:
        to = start + F.call_function("shiftleft", F.lit(1), k)
        return F.when((to <= F.least(n, m)) & (F.substring(a, F.lit(1), to) == F.substring(b, F.lit(1), to)), to).otherwise(start)

    start = F.aggregate(steps, F.lit(0), longer)

    def rest(x: Column, own: Column, others: Column) -> Column:
        return F.substring(x, start + 1 + (own >= others).cast("int"), own)

    return (a != b) & (F.abs(n - m) <= 1) & (rest(a, n, m) == rest(b, m, n))


def near_pairs(docs: DataFrame, distinct: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    """(at, near): distinct lines with the earliest line one edit away, where that is earlier."""
    keyed = distinct.where(F.col("halves").isNotNull()).select("at", F.explode("halves").alias("key"))
    picked = _shared(keyed, "key").select("at").distinct()
    wanted = picked.select("at.*").groupBy("id", "th").agg(F.collect_set("no").alias("nos"))
    wanted = materialize(wanted.withColumn("key", F.xxhash64("id", "th")), "lines-wanted")
    texts = docs.where(as_column(id_col).isNotNull()).select(as_column(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = possible_rows(texts.withColumn("key", F.xxhash64("id", "th")), "key", wanted)
    lines = texts.join(wanted.drop("key"), ["id", "th"]).select("id", "th", F.explode("nos").alias("no"), F.split("text", "\n").alias("lines"))
    lines = materialize(lines.select(F.struct(*AT).alias("at"), F.get("lines", F.col("no")).alias("line")).distinct(), "line-text")

    parts, n = lines.select("at", F.lit(0).cast("long").alias("rest"), F.col("line").alias("mid")), F.length("mid")
    ends = parts.where(n <= SHORT + 1)
    # Each pass divides the longest segment by 16.
    while not parts.where(n > SHORT).isEmpty():
        parts = materialize(_shared(_sixteenths(parts.where(n > SHORT)), "rest"), "line-parts")
        ends = ends.unionByName(parts.where(n <= SHORT + 1))

    variants = _variants(ends)
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("at"))).alias(f"by_{role}")
    groups = variants.groupBy("key").agg(F.count(F.lit(1)).alias("c"), first("whole"), first("removed"), first("replaced")).where("c > 1").drop("c")
    near = F.when(F.col("role") == "whole", F.col("by_removed")).when(F.col("role") == "removed", F.col("by_whole")).otherwise(F.col("by_replaced"))
    found = variants.join(groups, "key").select("at", near.alias("near")).where("near < at").distinct()
    both = found.join(lines, "at").join(lines.select(F.col("at").alias("near"), F.col("line").alias("other")), "near")
    return both.where(one_edit(F.col("line"), F.col("other"))).groupBy("at").agg(F.min("near").alias("near"))


def repeated_lines(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(id, no, th, keep_id, keep_no, distance): every line that goes, with the earlier line it goes for."""
    occurrences = materialize(line_table(docs, id_col, text_col, min_chars), "lines")
    first = F.min(F.struct(*AT)).alias("at")
    distinct = materialize(occurrences.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves")), "lines-distinct")
    near = materialize(near_pairs(docs, distinct, id_col, text_col), "lines-near")
    judged = distinct.select("h1", "h2", "at", "copies").join(near, "at", "left").where("copies > 1 or near is not null").drop("copies")
    gone = occurrences.select(*AT, "h1", "h2").join(judged, ["h1", "h2"]).where(F.col("near").isNotNull() | (F.struct(*AT) != F.col("at")))
    keep = F.coalesce("near", "at")
    return gone.select(*AT, keep["id"].alias("keep_id"), keep["no"].alias("keep_no"), F.col("near").isNotNull().cast("int").alias("distance"))


def dedup_lines(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``docs`` without the repeated lines; all rows and other columns stay."""
    gone = repeated_lines(docs, id_col, text_col, min_chars).groupBy("id", "th").agg(F.collect_set("no").alias("gone"))
    gone = materialize(gone.withColumn("key", F.xxhash64("id", "th")), "lines-gone")
    id_, th = as_column(id_col), F.xxhash64(text_col)
    # Only documents that may lose lines are moved.
    rows = packed(docs, id=id_, th=th, key=F.when(id_.isNotNull(), F.xxhash64(id_, th)))
    asked, stay = split_possible(rows, "key", gone)
    joined = asked.join(gone.drop("key"), ["id", "th"], "left")
    lines = F.split(field(text_col), "\n")
    # array_except keeps the order and looks positions up in a hash set.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), field(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return unpacked(joined.withColumn("row", F.col("row").withField(f"`{text_col}`", text)).select("row").unionByName(stay.select("row")))
