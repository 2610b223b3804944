"""Column expressions and reducers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_nonneg(value: Column) -> Column:
    """Aggregate: smallest non-negative value; negative values mean missing."""
    return F.min(F.when(value >= 0, value))


def any_true(flag: Column) -> Column:
    """Aggregate: logical or."""
    return F.bool_or(flag)


def other_end(center: Column, src: Column, dst: Column) -> Column:
    """The end of an edge opposite to ``center``."""
    return F.when(src == center, dst).otherwise(src)


def own_end(center: Column, src: Column, dst: Column) -> Column:
    """The end of an edge equal to ``center``."""
    return F.when(src == center, src).otherwise(dst)


def changed(new: Column, old: Column) -> Column:
    """NULL-aware test for a changed value."""
    return ~new.eqNullSafe(old)


def half(value: Column) -> Column:
    """Integer half of a non-negative whole number."""
    return F.floor(value / 2).cast("bigint")
