"""A made-up estate for demonstrations: the same rows for the same seed, whatever the partitioning. Every number is a hash of its row's keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OEMS, REGIONS, PRODUCTS = ("ALPHA", "BETA", "GAMMA", "DELTA", "EPSILON", "ZETA"), ("AMER", "EMEA", "APAC", "CHINA"), ("P10", "P20", "P30", "P40", "P50")
PATTERNS = ("smooth", "seasonal", "trend", "intermittent", "lumpy")
CURRENCIES = {"AMER": "USD", "EMEA": "EUR", "APAC": "JPY", "CHINA": "CNY"}


def even(*keys: Column | str | int) -> Column:
    """A number between 0 and 1 that only its keys decide."""
    columns = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def series(spark: SparkSession, seed: int = 7) -> DataFrame:
    """oem, region, product, pattern, base (monthly units)."""
    dims = [F.explode(F.array(*(F.lit(v) for v in values))).alias(name) for name, values in (("oem", OEMS), ("region", REGIONS), ("product", PRODUCTS))]
    rows = spark.range(1)
    for d in dims:
        rows = rows.select("*", d)
    pattern = F.element_at(F.array(*(F.lit(p) for p in PATTERNS)), (F.floor(even("oem", "region", "product", seed) * len(PATTERNS)) + 1).cast("int"))
    return rows.select("oem", "region", "product", pattern.alias("pattern"), F.round(20 + 400 * F.pow(even("oem", "region", "product", seed + 1), 2)).alias("base"))


def sales(spark: SparkSession, last: date, months: int = 36, seed: int = 7, rows_per_month: int = 4) -> DataFrame:
    """month, account_id, end_account_id, oem, region, product, units, revenue, currency: source rows of ``months`` months up to ``last``.

    An account is one of three of an oem and region, the third a distributor's; a fifth of a distributor's rows names its end customer."""
    s = series(spark, seed).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).withColumn("month", F.add_months(F.lit(last), (F.col("k") - (months - 1)).cast("int")))
    t = F.col("k")
    shape = (
        F.when(F.col("pattern") == "seasonal", 1 + 0.5 * F.sin(F.month("month") * (2 * 3.141592653589793 / 12)))
        .when(F.col("pattern") == "trend", 1 + t / months)
        .when(F.col("pattern") == "intermittent", F.when(t % 3 == 0, 2.0).otherwise(0.0))
        .when(F.col("pattern") == "lumpy", F.when(even("oem", "region", "product", "k", seed) < 0.3, 4 * even("oem", "region", "product", "k", seed + 1)).otherwise(0.0))
        .otherwise(1.0)
    )
    r = s.withColumn("mean", F.col("base") * shape).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows_per_month - 1))))
    noise = 0.8 + 0.4 * even("oem", "region", "product", "k", "row", seed + 2)
    units = F.round(F.col("mean") * noise / rows_per_month)
    place = F.xxhash64("oem", "region")
    kind = (F.floor(even("oem", "region", "product", "row", seed + 3) * 3)).cast("int")
    account = F.pmod(place, F.lit(1_000_000)) * 10 + kind
    end = F.when((kind == 2) & (even("oem", "region", "product", "k", "row", seed + 4) < 0.2), F.pmod(place, F.lit(1_000_000)) * 10)
    price = F.round(8 + 30 * even("product", seed + 5) + even("product", "region", seed + 6), 2)
    currency = F.coalesce(*(F.when(F.col("region") == g, c) for g, c in CURRENCIES.items()))
    return r.select("month", account.alias("account_id"), end.alias("end_account_id"), "oem", "region", "product", units.alias("units"), F.round(units * price, 2).alias("revenue"), currency.alias("currency")).filter("units > 0")


def account_mapping(rows: DataFrame) -> DataFrame:
    """The truth about the accounts of ``rows``, as a mapping: distributors are shared with the first oem."""
    a = rows.select("account_id", "oem", "region").distinct()
    own = F.struct(F.col("oem").alias("o"), F.lit(1.0).alias("p"))
    shared = F.array(F.struct(F.col("oem").alias("o"), F.lit(0.75).alias("p")), F.struct(F.lit("RESALE").alias("o"), F.lit(0.25).alias("p")))
    parts = a.select("account_id", "region", F.explode(F.when(F.col("account_id") % 10 == 2, shared).otherwise(F.array(own))).alias("x"))
    return parts.select("account_id", F.col("x.o").alias("oem"), "region", F.col("x.p").alias("pct"), F.to_date(F.lit("1900-01-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def numbered(df: DataFrame, by: str, name: str, ranges: int = 200) -> DataFrame:
    """``df`` with a row's number, from 1, in the order of the distinct values ``by``."""
    cuts = df.agg(F.percentile_approx(by, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    rows = df.withColumn("_range", F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(by))) if cuts else F.lit(0))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c")).select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return rows.join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + within).drop("_range", "_begin")


def steward_replay(pending: DataFrame, truth: DataFrame, every: int = 9) -> DataFrame:
    """``pending`` (mapping_id, account_id, oem) with approve: whether it meets the truth (account_id, oem). Every ninth in order of ids is left for the steward.

    Rows are numbered within ranges of ids, whose sizes give where each range begins."""
    right = truth.select("account_id", "oem").distinct().withColumn("_right", F.lit(True))
    rows = numbered(pending, "mapping_id", "_n").join(right, ["account_id", "oem"], "left")
    return rows.filter(F.col("_n") % every != 0).select("mapping_id", "account_id", "oem", F.coalesce("_right", F.lit(False)).alias("approve"))


def simulate_overrides(plan: DataFrame, actuals: DataFrame | None = None, share: float = 0.15, max_horizon: int = 6, seed: int = 7) -> DataFrame:
    """override_id, oem, region, product, month, override_units, reason_code, user_id: biased representatives, who know a part of what comes if ``actuals`` (y) are given."""
    keys = ("oem", "region", "product", "month")
    rows = plan.filter(F.col("horizon") <= max_horizon).filter(even(*keys, seed) < share)
    bias = 1 + 0.25 * (even("oem", "region", seed + 1) - 0.3)
    guess = F.col("ai_units")
    if actuals is not None:
        rows = rows.join(actuals.select(*keys, F.col("y").alias("_y")), list(keys), "left")
        guess = 0.5 * guess + 0.5 * F.coalesce("_y", guess)
    reason = F.element_at(F.array(F.lit("PROMOTION"), F.lit("LOST_DEAL"), F.lit("MARKET_SHIFT")), (F.floor(even(*keys, seed + 2) * 3) + 1).cast("int"))
    user = F.concat(F.lit("rep"), F.floor(even("oem", "region", seed + 3) * 5).cast("string"))
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).alias("override_id"), *keys, F.round(guess * bias, 1).alias("override_units"), reason.alias("reason_code"), user.alias("user_id"))
