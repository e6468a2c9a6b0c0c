"""URL filters (operator 8): host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of one 64-bit block per row, in which each listed URL sets ``bits`` bits. Listed URLs are OR-ed
into their blocks by one aggregation. Its size follows the list, with ten bits or more for each URL, up to a bound that
is safe to broadcast (six million URLs); a longer list only lets more URLs through to the exact step. URLs whose bits
are all set go to an exact join with the list, which removes the false positives; the others skip it.

Defined cases: a null URL or one without "://" has an empty host and path, no rule and verdict "allow"; repeated rows
are judged alike and all returned; empty tables give empty results, an empty list blocks nothing; other columns of the
pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import block_of, blocks_for, bloom_filter, mask_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without "www." or "m.", and path without trailing slash or ".html"; no scheme, query or fragment.
    Null if the host is empty."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/+)$", "")
    return F.when(host != "", F.concat(host, path))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits. rules: (verdict, host, path)."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None, bits: int = 5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed. ``listed`` has one column, canonical_url, of URLs to
    block (repeats and nulls allowed)."""
    url = F.col(url_col)
    listed = materialize(listed.select("canonical_url").where(F.col("canonical_url").isNotNull()).distinct(), "url-list")
    blocks = blocks or blocks_for(listed.count())
    judged = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("key"))
    judged = judged.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).withColumn("block", block_of(F.col("key"), blocks))
    words = bloom_filter(listed, "canonical_url", blocks, bits)
    # Broadcast is safe: the filter has no more rows than blocks, whatever the list.
    tested = judged.join(F.broadcast(words), F.col("block") == F.col("word_block"), "left")
    mask = mask_of(F.col("key"), bits)
    possible = F.coalesce(F.col("word").bitwiseAND(mask) == mask, F.lit(False))
    exact = listed.withColumn("on_list", F.lit(True))
    passed = tested.where(possible).join(exact, F.col("key") == F.col("canonical_url"), "left").withColumn("listed", F.coalesce("on_list", F.lit(False)))
    cols = ["id", "host", "path", "hit", "listed"]
    both = passed.select(*cols).unionByName(tested.where(~possible).withColumn("listed", F.lit(False)).select(*cols))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "listed")
