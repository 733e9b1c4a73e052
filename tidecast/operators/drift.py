"""Drift of demand and of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.quantiles import exact_quantiles

BINS = 8
PSI_ALERT, ERROR_ALERT = 0.25, 1.30
RECENT = 12


def psi(df: DataFrame, keys: tuple[str, ...], value: str, recent: str, bins: int = BINS) -> DataFrame:
    """keys, psi: the population stability index of rows where ``recent`` holds against the others.

    Bins are cut at the others' quantiles; with fewer than 8 others or 4 recent rows, or without two bins, the index is zero. An empty bin counts as a ten-thousandth."""
    old = df.filter(~F.col(recent))
    edges = exact_quantiles(old, keys, value, [F.lit(i / bins) for i in range(bins + 1)], "_q")
    inner = F.filter(F.array_distinct("_q"), lambda e: (e > F.col("_q")[0]) & (e < F.col("_q")[bins]))
    edges = edges.select(*keys, inner.alias("_edges"))
    placed = df.join(F.broadcast(edges) if not keys else edges, list(keys)).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    counts = placed.groupBy(*keys, "_bin", F.size("_edges").alias("_cuts")).agg(F.count_if(F.col(recent)).alias("c"), F.count_if(~F.col(recent)).alias("r"))
    all_bins = Window.partitionBy(*keys)
    counts = counts.withColumns({"_c": F.sum("c").over(all_bins), "_r": F.sum("r").over(all_bins)})
    share = lambda k: F.greatest(F.try_divide(F.col(k), F.col(f"_{k}")), F.lit(1e-4))
    c, r = share("c"), share("r")
    total = F.when((F.max("_r") >= 8) & (F.max("_c") >= 4) & (F.max("_cuts") > 0), F.sum((c - r) * F.log(c / r))).otherwise(0.0)
    return counts.groupBy(*keys).agg(total.alias("psi"))


def feature_drift(panel: DataFrame, by: str = "product", series: tuple[str, ...] = ("oem", "region", "product"), value: str = "units", recent: int = RECENT) -> DataFrame:
    """``by``, psi, breached: recent months against earlier ones, each series scaled by its own mean."""
    own = Window.partitionBy(*series)
    last = panel.agg(F.max("month").alias("_last"))
    rows = panel.withColumn("_scaled", F.col(value) / F.greatest(F.sum(value).over(own) / F.count(value).over(own), F.lit(1e-9))).crossJoin(F.broadcast(last))  # one row
    rows = rows.select(by, "_scaled", (F.col("month") > F.add_months("_last", -recent)).alias("_recent"))
    return psi(rows, (by,), "_scaled", "_recent").withColumn("breached", F.col("psi") > PSI_ALERT)


def error_drift(live: Column, backtest: Column) -> list[Column]:
    """ratio, breached of a live error against the backtest's; null if either is missing or zero."""
    ratio = F.when((live > 0) & (backtest > 0), live / backtest)
    return [ratio.alias("ratio"), (ratio > ERROR_ALERT).alias("breached")]
