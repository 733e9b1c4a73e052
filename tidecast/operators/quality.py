"""Checks of the planning tables. Each is one aggregate; a table that is missing or empty gives a note, not a failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import DEFAULT, UNMAPPED, EngineConfig
from tidecast.functions.quantiles import exact_quantile
from tidecast.operators.windows import latest_month_ratio

UNMAPPED_WARN, UNMAPPED_ERROR = 0.03, 0.10
LEAST_MONTHS, GOOD_MONTHS = 18, 30
RATIO = (0.5, 1.6)
#: Prices further than this from their product's median, as a logarithm, stand out.
FAR = 1.0


def _result(df: DataFrame, name: str, severity: Column | str, passed: Column, metric: Column, threshold: float | None = None) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        metric.cast("double").alias("metric"),
        F.lit(threshold).cast("double").alias("threshold"),
    )


def mapped_series_present(series: DataFrame) -> DataFrame:
    n = F.col("n")
    return _result(series.agg(F.count(F.lit(1)).alias("n")), "mapped_series_present", "ERROR", n > 0, n)


def unmapped_share(series: DataFrame) -> DataFrame:
    one = series.agg(F.sum("units").alias("t"), F.coalesce(F.sum(F.when(F.col("oem") == UNMAPPED, F.col("units"))), F.lit(0.0)).alias("u"))
    share = F.coalesce(F.try_divide("u", "t"), F.lit(0.0))
    return _result(one, "unmapped_share", F.when(share > UNMAPPED_ERROR, "ERROR").otherwise("WARN"), share <= UNMAPPED_WARN, share, UNMAPPED_WARN)


def pending_reviews(mapping: DataFrame) -> DataFrame:
    n = F.col("n")
    return _result(mapping.agg(F.count_if(F.col("status") == "PENDING_REVIEW").alias("n")), "pending_mapping_reviews", "INFO", n == 0, n)


def allocation_sums(mapping: DataFrame) -> DataFrame:
    """Open shares of an account that don't sum to one."""
    by = mapping.filter("status = 'ACTIVE' and valid_to is null").groupBy("account_id").agg(F.sum("pct").cast("double").alias("s"))
    n = F.col("n")
    return _result(by.agg(F.count_if(F.abs(F.col("s") - 1) > 1e-4).alias("n")), "allocation_sums", "ERROR", n == 0, n, 0.0)


def history_length(series: DataFrame) -> DataFrame:
    n = F.col("n")
    one = series.filter(F.col("oem") != UNMAPPED).agg(F.count_distinct("month").alias("n"))
    return _result(one, "history_length", F.when(n < LEAST_MONTHS, "ERROR").otherwise("WARN"), n >= GOOD_MONTHS, n, float(GOOD_MONTHS))


def latest_month_complete(series: DataFrame) -> DataFrame:
    one = latest_month_ratio(series.filter(F.col("oem") != UNMAPPED))
    return _result(one, "latest_month_complete", "WARN", F.col("ratio").between(*RATIO), F.col("ratio"), RATIO[0])


def negative_values(sales: DataFrame) -> DataFrame:
    """``sales`` are rows, or sums of rows that tell in ``n_negative`` how many of them are negative."""
    n = F.col("n")
    found = F.coalesce(F.sum("n_negative"), F.lit(0)) if "n_negative" in sales.columns else F.count_if((F.col("units") < 0) | (F.col("revenue") < 0))
    return _result(sales.agg(found.alias("n")), "negative_values", "WARN", n == 0, n, 0.0)


def fx_coverage(sales: DataFrame, series: DataFrame, fx: DataFrame) -> DataFrame:
    """Months of a currency without a rate."""
    months = series.filter(F.col("oem") != UNMAPPED).select("month").distinct()
    wanted = sales.filter("currency <> 'USD'").select("currency").distinct().crossJoin(F.broadcast(months))  # currencies and months are few
    n = F.col("n")
    return _result(wanted.join(fx.select("currency", "month"), ["currency", "month"], "left_anti").agg(F.count(F.lit(1)).alias("n")), "fx_coverage", "ERROR", n == 0, n, 0.0)


def asp_outliers(series: DataFrame) -> DataFrame:
    rows = series.filter((F.col("oem") != UNMAPPED) & (F.col("units") > 0)).select("product", (F.col("revenue") / F.col("units")).alias("asp"))
    middle = exact_quantile(rows, ("product",), "asp", F.lit(0.5), "middle")
    off = F.abs(F.log(F.greatest(F.col("asp") / F.col("middle"), F.lit(1e-6))))
    n = F.col("n_off")
    return _result(rows.join(middle.select("product", "middle"), "product").agg(F.count_if(off > FAR).alias("n_off")), "asp_outliers", "WARN", n == 0, n, 0.0)


def snapshot_current(snaps: DataFrame, cycle: Column, name: str) -> DataFrame:
    """Whether a table of snapshots has the cycle month's."""
    one = snaps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("snapshot_month") == cycle).alias("now"))
    empty = F.col("n") == 0
    return _result(one, name, F.when(empty, "INFO").otherwise("WARN"), empty | (F.col("now") > 0), F.when(~empty, F.col("now")), 1.0)


def capacity_coverage(capacity: DataFrame, cycle: Column, horizon: int = 12) -> DataFrame:
    """Forecast months for which capacity is given."""
    inside = F.col("month").between(F.add_months(cycle, 1), F.add_months(cycle, horizon))
    one = capacity.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(inside, F.col("month"))).alias("have"))
    empty = F.col("n") == 0
    return _result(one, "capacity_coverage", F.when(empty, "INFO").otherwise("WARN"), empty | (F.col("have") >= horizon), F.when(~empty, F.col("have")), float(horizon))


def run_checks(series: DataFrame, sales: DataFrame, mapping: DataFrame, fx: DataFrame, crm: DataFrame, backlog: DataFrame, capacity: DataFrame, cycle: Column, horizon: int = DEFAULT.horizon) -> DataFrame:
    """check_name, severity, passed, metric, threshold of all checks, of series until the cycle month."""
    known = series.filter(F.col("month") <= cycle)
    parts = [
        mapped_series_present(known), unmapped_share(known), pending_reviews(mapping), allocation_sums(mapping), history_length(known), latest_month_complete(known), negative_values(sales),
        fx_coverage(sales, known, fx), asp_outliers(known), snapshot_current(crm, cycle, "crm_snapshot_current"), snapshot_current(backlog, cycle, "backlog_snapshot_current"), capacity_coverage(capacity, cycle, horizon),
    ]
    return reduce(DataFrame.unionByName, parts)


def blocking(checks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Failed checks that stop a forecast."""
    return checks.filter(F.lit(config.dq_block) & (F.col("severity") == "ERROR") & ~F.col("passed"))
