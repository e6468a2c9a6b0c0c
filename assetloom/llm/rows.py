"""Whole rows as one column, so that no name inside an operator meets one of the caller's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """(row, columns...): each row of ``docs`` as a struct, with expressions over its columns beside it."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    """The table that ``packed`` was given, as far as its rows are left."""
    return rows.select("row.*")


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(name: str) -> Column:
    """A column of the packed row."""
    return F.col("row").getField(name)


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long. Other types than whole numbers are an error at once, not one in a task."""
    kind = docs.select(id_col).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    return F.col(id_col).cast("long")


def sample_of(key: Column, share: float) -> Column:
    """Whether a row is in the sample of ``share``, by 53 bits of a hash of its key: the same rows at every run."""
    return F.shiftrightunsigned(F.xxhash64(key), 11) < F.lit(min(1.0, share) * float(1 << 53))
