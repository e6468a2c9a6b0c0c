"""Blocked Bloom filters as tables: at most ``blocks`` rows of one 64-bit block each, whatever is put in.

The number of blocks follows the number of keys up to MOST_BLOCKS, which makes the table safe to broadcast: it is right for
six million keys. Above that a filter only lets more rows pass, and each use is followed by an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize


#: The most rows of a filter: 8 MB of bits, about 40 MB as a broadcast table.
MOST_BLOCKS = 1 << 20


def blocks_for(n: int, bits_per_key: int = 10) -> int:
    """Blocks for n keys: a power of two that gives each ``bits_per_key`` bits or more, up to MOST_BLOCKS."""
    return min(MOST_BLOCKS, 1 << max(10, (n * bits_per_key // 64).bit_length()))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(blocks))


def mask_of(key: Column, bits: int) -> Column:
    """A 64-bit word with the key's bits set: six bits of a second hash choose each of them."""
    h, out = F.xxhash64(F.lit(29), key), F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


def bloom_filter(listed: DataFrame, key: str, blocks: int, bits: int) -> DataFrame:
    """(word_block, word) of the keys that aren't null."""
    return listed.where(F.col(key).isNotNull()).groupBy(block_of(F.col(key), blocks).alias("word_block")).agg(F.bit_or(mask_of(F.col(key), bits)).alias("word"))


def split_possible(df: DataFrame, key: str, listed: DataFrame, bits: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be listed, rows whose key isn't), columns unchanged. ``listed`` is a written table with a column
    of the key's name; a null key is not listed."""
    blocks = blocks_for(listed.count())
    words, mask = F.broadcast(bloom_filter(listed, key, blocks, bits)), mask_of(F.col(key), bits)
    marked = df.join(words, block_of(F.col(key), blocks) == F.col("word_block"), "left").withColumn("may", F.coalesce(F.col("word").bitwiseAND(mask) == mask, F.lit(False)))
    asked, stay = (marked.where(F.col("may") == may).select(*df.columns) for may in (True, False))
    return asked, stay


def possible_rows(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be in ``listed``, and few others; columns unchanged."""
    return split_possible(df, key, listed)[0]


def without_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose key is in ``gone`` (one column of that name). Only rows that may be gone are moved."""
    gone = materialize(gone.where(F.col(key).isNotNull()).distinct(), "gone")
    asked, stay = split_possible(df, key, gone)
    return stay.unionByName(asked.join(gone, key, "left_anti"))
