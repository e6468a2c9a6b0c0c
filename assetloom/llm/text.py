"""Counts of whole texts as plain column expressions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word; null for null."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among the ASCII ``chars``: the bytes that removing them saves."""
    among = "[" + "".join(c if c.isalnum() else "\\" + c for c in chars) + "]+"
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, among, ""))


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)
