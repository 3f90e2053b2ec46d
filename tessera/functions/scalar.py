"""Lenient coercion and guarded arithmetic: dirty values become null, never NaN and never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, or null for what is no number; NaN counts as missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def timestamp(c: Column) -> Column:
    """A timestamp in UTC, or null for what is none. Any ISO form is read."""
    return c.try_cast("timestamp")


def strict_timestamp(df: DataFrame, name: str) -> DataFrame:
    """The column as timestamps; rows that cannot be read are an error that says how many."""
    bad = df.where(F.col(name).isNull() | timestamp(F.col(name)).isNull()).count()
    if bad:
        raise ValueError(f"{name}: {bad} values are no dates")
    return df.withColumn(name, timestamp(F.col(name)))


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero or missing."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def is_zero(c: Column) -> Column:
    return c == 0


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike greatest and least alone."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def in_range(c: Column, start, end) -> Column:
    """Both ends belong; an end given as a day is its midnight."""
    return c.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
