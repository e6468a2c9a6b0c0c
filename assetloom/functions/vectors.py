"""Vector and scalar expressions over ARRAY columns; sums are taken in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(u: Column, v: Column) -> Column:
    """Inner product; null if the lengths differ or an element is null."""
    return F.aggregate(F.zip_with(_double(u), _double(v), lambda a, b: a * b), F.lit(0e0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return scaled(v, F.when(norm(v) == 0, 1e0).otherwise(norm(v)))


def scaled(v: Column, by: Column) -> Column:
    """v / by. The divisor is a list of one value, so that it is computed once and not for each element."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 0)


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - u.v of unit vectors."""
    return 1e0 - dot(u, v)


def tta_average(a: Column, b: Column) -> Column:
    """Mean of the two passes' features, taken before they are normalised."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) * 0.5e0)


def token_pooling(hidden: Column, num_register: Column | int) -> Column:
    """Token 0 followed by the mean of the patch tokens after it and the register tokens."""
    skip = F.lit(num_register) if isinstance(num_register, int) else num_register
    patches = F.slice(hidden, skip + 2, F.greatest(F.size(hidden) - skip - 1, F.lit(0)))
    n = F.size(patches)
    zero = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0e0))
    total = F.aggregate(patches, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    return F.concat(_double(F.element_at(hidden, 1)), F.transform(total, lambda x: F.when(n > 0, x / n)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))
