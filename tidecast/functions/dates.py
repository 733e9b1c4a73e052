"""Months as dates on their first day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_month(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")


def add_months(month: Column, n: Column | int) -> Column:
    return F.add_months(month, n)


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months from one month to another, by calendar."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def is_quarter_end(month: Column) -> Column:
    return F.month(month) % 3 == 0


def month_range(low: Column, high: Column) -> Column:
    """All months from ``low`` to ``high``, both included; null if ``high`` comes first."""
    return F.when(low <= high, F.sequence(low, high, F.expr("interval 1 month")))


def spine(df: DataFrame, month: str = "month", until: Column | None = None) -> DataFrame:
    """One row for each month from the first to the last (or ``until``) of ``df``."""
    ends = df.agg(F.min(month).alias("lo"), (F.max(month) if until is None else until).alias("hi"))
    return ends.select(F.explode(month_range(F.col("lo"), F.col("hi"))).alias(month))
