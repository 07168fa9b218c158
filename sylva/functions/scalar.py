"""Scalar building blocks as Spark columns; logarithms have base 2 and are 0 where undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def xlog(x: Column, y: Column) -> Column:
    """x * log2(y), and 0 unless both are positive."""
    return F.when((x > 0) & (y > 0), x * F.log2(y)).otherwise(F.lit(0.0))


def plogp(x: Column) -> Column:
    return xlog(x, x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def rounded(x: Column, places: int = PLACES) -> Column:
    """``x`` rounded, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """An array divided by its Euclidean length."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))


def share(a: Column) -> Column:
    """An array divided by its sum."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(a, lambda x: x.cast("double") / F.greatest(total, F.lit(1e-12)))


def argmax(a: Column) -> Column:
    """Place, from 0, of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def last_number(text: Column) -> Column:
    """The last decimal number in a text, as a double."""
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return F.element_at(found, -1).cast("double")


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, or a dash if there is none."""
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(F.format_string(f"%.{places}f", x))
