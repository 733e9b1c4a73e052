"""Accuracy of forecasts, as aggregate columns. A positive bias means that the forecast was too low."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def exact_sum(value: Column, kind: str = MONEY) -> Column:
    """A sum that does not depend on the order of rows, as a double."""
    return F.sum(value.cast(kind)).cast("double")


def wmape(actual: Column, forecast: Column) -> Column:
    """Null if nothing was demanded."""
    total = F.sum(F.abs(actual))
    return F.when(total > 0, F.sum(F.abs(actual - forecast)).cast("double") / total.cast("double"))


def mae(actual: Column, forecast: Column) -> Column:
    return F.sum(F.abs(actual - forecast)).cast("double") / F.count(actual - forecast)


def bias(actual: Column, forecast: Column) -> Column:
    total = F.sum(actual)
    return F.when(total != 0, F.sum(actual - forecast).cast("double") / total.cast("double"))


def mase(actual: Column, forecast: Column, scale: Column) -> Column:
    """The mean of errors over their series' scale; rows without a positive scale are left out."""
    return steady_mean(F.when(scale > 0, F.abs(actual - forecast).cast("double") / scale))


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    d = actual - forecast
    return steady_mean(F.greatest(q * d, (q - 1) * d))


def coverage(actual: Column, low: Column, high: Column) -> Column:
    return F.count_if((actual >= low) & (actual <= high)) / F.count(F.lit(1))


def steady_sum(value: Column) -> Column:
    """A sum of doubles that does not depend on the order of rows: of whole billionths."""
    return F.sum(F.floor(value * 1e9).cast("decimal(38,0)")).cast("double") / 1e9


def steady_mean(value: Column) -> Column:
    return steady_sum(value) / F.count(value)
