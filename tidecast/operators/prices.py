"""Average selling prices: history, forecast, contracts and revenue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import months_between
from tidecast.functions.metrics import steady_mean, steady_sum
from tidecast.operators.hierarchy import DIMS
from tidecast.operators.models import _months, ets
from tidecast.operators.windows import bounded_fill

LEAST, TAIL, SHORT_SIGMA = 12, 6, 0.12


def asp_history(panel: DataFrame, limit: int = 6) -> DataFrame:
    """oem, region, product, month, units, asp: revenue over units; months without units take the price of at most ``limit`` months before, then after."""
    asp = F.when(F.col("units") > 1e-9, F.col("revenue") / F.col("units"))
    return bounded_fill(panel.select(*DIMS, "month", "units", asp.alias("asp")), "asp", DIMS, limit)


def trailing_price(history: DataFrame, tail: int = TAIL) -> DataFrame:
    """oem, region, product, n, asp: the mean of the last ``tail`` known prices, the forecast of series with fewer than twelve."""
    w = Window.partitionBy(*DIMS).orderBy(F.col("month").desc())
    rows = history.filter("asp is not null").withColumn("_k", F.row_number().over(w))
    return rows.groupBy(*DIMS).agg(F.count(F.lit(1)).alias("n"), steady_mean(F.when(F.col("_k") <= tail, F.col("asp"))).alias("asp"))


def price_forecast(history: DataFrame, horizon: int = 12, until: str | None = None) -> DataFrame:
    """oem, region, product, month, h, asp, sigma. Logarithms are smoothed without a season; sigma is the spread of one-step errors, growing by 0.12 of itself a month, threefold at most."""
    if until is not None:
        history = history.filter(F.col("month") <= F.lit(until).cast("date"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        known = rows["asp"].dropna().to_numpy(float)
        h = np.arange(1, horizon + 1)
        if len(known) >= LEAST:
            y = np.log(np.maximum(known, 1e-6))
            mean, _, fitted = ets(y, horizon, 1)
            sd = max(float(np.std(y - fitted, ddof=1)), 0.01)
            value, sigma = np.exp(mean), np.minimum(sd * (1 + 0.12 * (h - 1)), 3 * sd)
        else:
            value, sigma = np.full(horizon, known[-TAIL:].mean() if len(known) else np.nan), np.full(horizon, SHORT_SIGMA)
        out = pd.DataFrame({"month": _months(rows["month"].iloc[-1], horizon), "h": h, "asp": value, "sigma": sigma})
        for d, v in zip(DIMS, key, strict=True):
            out[d] = v
        return out[[*DIMS, "month", "h", "asp", "sigma"]]

    out = history.select(*DIMS, "month", "asp").groupBy(*DIMS).applyInPandas(run, "oem string, region string, product string, month date, h int, asp double, sigma double")
    return out.withColumn("asp", F.nanvl("asp", F.lit(None).cast("double")))


def contract_prices(contracts: DataFrame, mapping: DataFrame, rates: DataFrame, months: Column) -> DataFrame:
    """oem, region, product, month, price (US dollars), committed: contracts of the months in the array ``months``.

    ``contracts`` has account_id, product, start_month, end_month, committed_units, price, currency, annual_change; ``mapping`` account_id, oem, region, pct; ``rates`` month, currency, rate.
    Prices step once a year from the start. Commitments add up; where contracts overlap, the price is that of the latest start, then the greatest account."""
    rows = contracts.withColumn("month", F.explode(F.filter(months, lambda m: (F.col("start_month") <= m) & (m <= F.col("end_month")))))
    years = F.floor(F.greatest(months_between(F.col("month"), F.col("start_month")), F.lit(0)) / 12)
    rows = rows.join(rates, ["month", "currency"]).withColumn("_p", F.col("price") * F.pow(1 + F.col("annual_change"), years.cast("double")) * F.col("rate").cast("double"))
    rows = rows.join(mapping.select("account_id", "oem", "region", F.col("pct").cast("double").alias("pct")), "account_id")
    return rows.groupBy("oem", "region", "product", "month").agg(F.max_by("_p", F.struct("start_month", "account_id")).alias("price"), steady_sum(F.col("committed_units") * F.col("pct")).alias("committed"))


def blend(forecast: DataFrame, contracts: DataFrame, baseline: DataFrame) -> DataFrame:
    """``forecast`` with weight: the share of ``baseline`` units (oem, region, product, month, units) under contract, which takes the contract's price and three tenths of the risk."""
    keys = [*DIMS, "month"]
    rows = forecast.join(contracts, keys, "left").join(baseline.select(*keys, F.col("units").alias("_b")), keys, "left")
    share = F.greatest(F.least(F.col("committed") / F.greatest("_b", F.lit(1e-6)), F.lit(1.0)), F.lit(0.0))
    w = F.when(F.col("price").isNotNull(), F.coalesce(share, F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("weight", w)
    asp = F.when(F.col("price").isNotNull(), F.col("weight") * F.col("price") + (1 - F.col("weight")) * F.col("asp")).otherwise(F.col("asp"))
    return rows.withColumns({"asp": asp, "sigma": F.col("sigma") * (1 - 0.7 * F.col("weight"))}).select(*forecast.columns, "weight")


def price_error(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """h, wmape of forecast prices against prices that came, by units."""
    real = history.filter("asp is not null and units > 0").select(*DIMS, "month", "units", F.col("asp").alias("real"))
    rows = forecast.join(real, [*DIMS, "month"])
    return rows.groupBy("h").agg((F.sum(F.col("units") * F.abs(F.col("real") - F.col("asp"))) / F.sum(F.col("units") * F.col("real"))).alias("wmape"))


def revenue(units: DataFrame, prices: DataFrame) -> DataFrame:
    """``units`` (oem, region, product, month, units) with asp and revenue."""
    return units.join(prices.select(*DIMS, "month", "asp"), [*DIMS, "month"], "left").withColumn("revenue", F.col("units") * F.coalesce("asp", F.lit(0.0)))
