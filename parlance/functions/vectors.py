"""Vector expressions over ``array<float|double>`` columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(e: Column | str) -> Column:
    return F.col(e) if isinstance(e, str) else e


def inner_product(a, b) -> Column:
    mul = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(mul, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(inner_product(a, a))


def unit(a) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def cosine(a, b) -> Column:
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def angular_of(cos: Column) -> Column:
    """1 - acos of the clipped cosine, not divided by pi."""
    return F.lit(1.0) - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def angular(a, b) -> Column:
    return angular_of(cosine(a, b))
