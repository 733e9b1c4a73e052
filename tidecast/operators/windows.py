"""Windows over the months of a series."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import months_between

LAGS = 12


def by_month(keys: tuple[str, ...], month: str = "month"):
    return Window.partitionBy(*keys).orderBy(month)


def bounded_fill(df: DataFrame, value: str, keys: tuple[str, ...], limit: int = 6, month: str = "month") -> DataFrame:
    """Gaps take the last value of at most ``limit`` rows before, then the next of at most ``limit`` rows after."""
    w = by_month(keys, month)
    back = df.withColumn(value, F.last(value, True).over(w.rowsBetween(-limit, 0)))
    return back.withColumn(value, F.first(value, True).over(w.rowsBetween(0, limit)))


def strictly_before(df: DataFrame, values: tuple[str, ...], keys: tuple[str, ...], month: str = "month") -> DataFrame:
    """Running sums of all earlier rows, zero at first; the row itself is not counted."""
    w = by_month(keys, month).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for v in values})


def seasonal_naive(series: DataFrame, targets: DataFrame, keys: tuple[str, ...], value: str = "units", season: int = 12) -> DataFrame:
    """``targets`` (keys, month) with ``naive``: the value ``season`` months before, else the series' last value, else zero."""
    old = series.select(*keys, F.add_months("month", season).alias("month"), F.col(value).alias("_old"))
    last = series.groupBy(*keys).agg(F.max_by(value, "month").alias("_last"))
    return targets.join(old, [*keys, "month"], "left").join(last, list(keys), "left").withColumn("naive", F.coalesce("_old", "_last", F.lit(0.0))).drop("_old", "_last")


def mase_scale(df: DataFrame, keys: tuple[str, ...], value: str = "y", month: str = "ds", season: int = 12) -> DataFrame:
    """keys, scale: the mean error of the seasonal naive forecast within the series; of the naive one for ``season`` + 1 rows or fewer."""
    w = by_month(keys, month)
    d = df.select(*keys, F.abs(F.col(value) - F.lag(value, season).over(w)).alias("far"), F.abs(F.col(value) - F.lag(value, 1).over(w)).alias("near"))
    return d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > season + 1, F.sum("far") / F.count("far")).otherwise(F.try_divide(F.sum("near"), F.count("near"))).alias("scale"))


def acf(df: DataFrame, keys: tuple[str, ...], lag: int = 12, value: str = "units", month: str = "month") -> DataFrame:
    """keys, acf: the autocorrelation at ``lag``; null for series of fewer than ``lag`` + 6 rows or without variance."""
    all_rows = Window.partitionBy(*keys)
    centred = df.withColumn("_d", F.col(value) - F.sum(value).over(all_rows) / F.count(value).over(all_rows))
    both = centred.withColumn("_l", F.lag("_d", lag).over(by_month(keys, month)))
    ratio = F.try_divide(F.sum(F.col("_d") * F.col("_l")), F.sum(F.col("_d") * F.col("_d")))
    return both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= lag + 6, ratio).alias("acf"))


def driver_correlation(df: DataFrame, drivers: tuple[str, ...], keys: tuple[str, ...], value: str = "units", month: str = "month", lags: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """keys, exog: the greatest absolute correlation between the changes of demand and the earlier changes of a driver; 0 with fewer than 12 rows or no variance."""
    w = by_month(keys, month)
    diff = df.withColumns({f"_d_{c}": F.col(c).cast("double") - F.lag(c, 1).over(w) for c in (value, *drivers)})
    shifted = diff.withColumns({f"_x_{c}_{k}": F.lag(f"_d_{c}", k).over(w) for c in drivers for k in lags})

    def strength(c: str, k: int) -> Column:
        x, y = F.col(f"_x_{c}_{k}"), F.col(f"_d_{value}")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return F.when((F.count(x) > 6) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.abs(F.corr(x, y))).otherwise(0.0)

    found = [strength(c, k) for c in drivers for k in lags]
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return shifted.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 12, best).otherwise(0.0).alias("exog"))


def rolling_features(df: DataFrame, keys: tuple[str, ...], value: str = "units", month: str = "month") -> DataFrame:
    """keys, month and what a model may know at that month: lags, means, spreads, share of zeros, slope, extremes, all over ``scale`` (the mean of the last 12 months)."""
    w = by_month(keys, month)
    y = F.col(value).cast("double")
    long, half, short = w.rowsBetween(-11, 0), w.rowsBetween(-5, 0), w.rowsBetween(-2, 0)
    mean = lambda frame: F.sum(y).over(frame) / F.count(y).over(frame)

    def spread(frame) -> Column:
        n, s, q = F.count(y).over(frame), F.sum(y).over(frame), F.sum(y * y).over(frame)
        return F.sqrt(F.greatest(n * q - s * s, F.lit(0.0))) / n

    rows = df.withColumn("_t", F.row_number().over(w))
    t = F.col("_t").cast("double")
    n, st, sy, stt, sty = (F.sum(x).over(long) for x in (F.lit(1.0), t, y, t * t, t * y))
    slope = F.when(n > 2, F.try_divide(n * sty - st * sy, n * stt - st * st)).otherwise(0.0)
    scale = mean(long)
    rows = rows.withColumns({"scale": F.when(scale > 1e-9, scale).otherwise(1.0), "_all": mean(w.rowsBetween(Window.unboundedPreceding, 0))})
    s = F.col("scale")
    return rows.select(
        *keys,
        month,
        "scale",
        *((F.lag(y, k).over(w) / s if k else y / s).alias(f"lag{k}") for k in range(LAGS)),
        (mean(short) / s).alias("mean3"),
        (mean(half) / s).alias("mean6"),
        (spread(half) / s).alias("sd6"),
        (spread(long) / s).alias("sd12"),
        (F.sum(F.when(y <= 1e-9, 1.0).otherwise(0.0)).over(long) / n).alias("zero_share"),
        (slope / s).alias("slope"),
        (F.max(y).over(long) / s).alias("max12"),
        (F.min(y).over(long) / s).alias("min12"),
        (s / F.greatest(F.col("_all"), F.lit(1e-9))).alias("hist_ratio"),
        F.log1p(s).alias("log_scale"),
    )


def horizon_features(h: Column, month: Column) -> list[Column]:
    """The horizon and the target month's place in the year."""
    m = F.month(month)
    turn = 2 * math.pi / 12
    return [h.cast("double").alias("h"), m.cast("double").alias("m"), F.sin(m * turn).alias("sin_m"), F.cos(m * turn).alias("cos_m"), (m % 3 == 0).cast("double").alias("qtr_end")]


def latest(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (which must leave no ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_month_ratio(df: DataFrame, value: str = "units", month: str = "month") -> DataFrame:
    """One row: the last month's sum over the mean of the three months before it."""
    months = df.groupBy(month).agg(F.sum(value).alias("v"))
    top = months.agg(F.max(month).alias("hi"))
    recent = months.join(F.broadcast(top), F.col(month) >= F.add_months("hi", -3))
    return recent.agg(F.sum(F.when(F.col(month) == F.col("hi"), F.col("v"))).alias("last"), F.avg(F.when(F.col(month) < F.col("hi"), F.col("v"))).alias("before")).select(
        F.try_divide("last", "before").alias("ratio")
    )


def monotone(df: DataFrame, quantiles: tuple[str, ...]) -> DataFrame:
    """Quantile columns, lowest first, without negative values and never falling."""
    out = [F.greatest(F.col(q), F.lit(0.0)) for q in quantiles]
    for i in range(1, len(out)):
        out[i] = F.greatest(out[i - 1], out[i])
    return df.withColumns(dict(zip(quantiles, out, strict=True)))


def horizon_of(ds: Column, origin: Column | date) -> Column:
    return months_between(ds, origin if isinstance(origin, Column) else F.lit(origin))
