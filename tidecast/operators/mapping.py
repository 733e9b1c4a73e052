"""From source rows to planning series: effective-dated mappings with splits, and currencies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import OPEN_START, UNKNOWN, UNMAPPED
from tidecast.functions.metrics import exact_sum


def valid_at(month: Column, begin: Column, end: Column) -> Column:
    """Whether a month lies within [begin, end); an open end is null."""
    return (begin <= month) & (end.isNull() | (month < end))


def map_facts(facts: DataFrame, mapping: DataFrame, values: tuple[str, ...], month: str = "month", account: str = "account_id", end: str | None = "end_account_id") -> DataFrame:
    """``facts`` with oem, region and pct; values are multiplied by pct.

    ``mapping`` has account_id, oem, region, pct, valid_from, valid_to. A row whose end customer has a valid mapping uses that one alone,
    others use the sold-to account's; rows with neither are kept as unmapped, so totals are conserved. Splits give a row for each part.
    Two outer joins on the account, of which the second takes only rows that the first left open; no row ids are needed."""
    m = mapping.select("account_id", "oem", "region", "pct", "valid_from", "valid_to")

    def side(prefix: str) -> DataFrame:
        return m.select(*(F.col(c).alias(f"{prefix}{c}") for c in m.columns))

    drop = [c for c in ("oem", "region", "pct") if c in facts.columns]
    out = facts.drop(*drop)
    if end is not None:
        e = side("_e_")
        out = out.join(e, (F.col(end) == F.col("_e_account_id")) & valid_at(F.col(month), F.col("_e_valid_from"), F.col("_e_valid_to")), "left")
    else:
        out = out.withColumns({f"_e_{c}": F.lit(None).cast(m.schema[c].dataType) for c in m.columns})
    s = side("_s_")
    open_row = F.when(F.col("_e_account_id").isNull(), F.col(account))  # null never joins
    out = out.join(s, (open_row == F.col("_s_account_id")) & valid_at(F.col(month), F.col("_s_valid_from"), F.col("_s_valid_to")), "left")
    pct = F.coalesce("_e_pct", "_s_pct", F.lit(1).cast(m.schema["pct"].dataType))
    return out.select(
        *(((F.col(c) * pct).alias(c)) if c in values else F.col(c) for c in facts.columns if c not in drop),
        F.coalesce("_e_oem", "_s_oem", F.lit(UNMAPPED)).alias("oem"),
        F.coalesce("_e_region", "_s_region", F.lit(UNKNOWN)).alias("region"),
        pct.alias("pct"),
    )


def rate_ends(rows: DataFrame, month: str = "month", currency: str = "currency") -> DataFrame:
    """One row: whether all rows are in dollars, and their last month."""
    return rows.agg(F.coalesce(F.bool_and(F.col(currency) == "USD"), F.lit(False)).alias("_usd"), F.max(month).alias("_last"))


def with_rate(rows: DataFrame, fx: DataFrame, policy: str = "constant", base_month: date | None = None, month: str = "month", currency: str = "currency", ends: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rate`` to US dollars. ``fx`` has month, currency, rate.

    constant: all months at the rates of the last month with rates at or before ``base_month`` (by default the last month of ``rows``). actual: each month's own.
    A missing rate is null, but 1 if all rows are in dollars. ``ends`` are the ``rate_ends`` of ``rows`` where they are known; without them the rows are read twice."""
    only_usd = F.broadcast(rate_ends(rows, month, currency) if ends is None else ends)  # one row
    if policy == "constant":
        target = F.lit(base_month) if base_month is not None else F.col("_last")
        base = fx.select(F.col("month").alias("_fxm")).distinct().join(only_usd, F.col("_fxm") <= target).agg(F.max("_fxm").alias("month"))
        rates = fx.join(F.broadcast(base), "month").select(F.col("currency").alias("_ccy"), F.col("rate").alias("_rate"))
        out = rows.join(rates, F.col(currency) == F.col("_ccy"), "left")
    elif policy == "actual":
        rates = fx.select(F.col("month").alias("_fxm"), F.col("currency").alias("_ccy"), F.col("rate").alias("_rate"))
        out = rows.join(rates, (F.col(currency) == F.col("_ccy")) & (F.col(month) == F.col("_fxm")), "left")
    else:
        raise ValueError(f"unknown policy {policy}")
    rate = F.coalesce("_rate", F.when(F.col("_usd"), F.lit(1)))
    return out.crossJoin(only_usd.select("_usd")).withColumn("rate", rate).select(*rows.columns, "rate")


def in_usd(value: Column, rate: str = "rate") -> Column:
    """Money times its rate, without rounding before the fourth place."""
    return value.cast("decimal(20,8)") * F.col(rate).cast("decimal(9,4)")


def mapped_series(sales: DataFrame, mapping: DataFrame, fx: DataFrame, policy: str = "constant", base_month: date | None = None, ends: DataFrame | None = None) -> DataFrame:
    """month, oem, region, product, units, revenue (US dollars) of source rows with month, account_id, end_account_id, product, units, revenue, currency.

    Source rows are summed before they meet the mapping, so the joins read one row for each account, product and month."""
    keys = ["month", "account_id", "end_account_id", "product", "currency"]
    sales = sales.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    mapped = with_rate(map_facts(sales, mapping, ("units", "revenue")), fx, policy, base_month, ends=ends)
    return mapped.groupBy("month", "oem", "region", "product").agg(exact_sum(F.col("units")).alias("units"), exact_sum(in_usd(F.col("revenue"))).alias("revenue"))


def future_rates(fx: DataFrame, months: DataFrame, policy: str = "constant", base_month: date | None = None) -> DataFrame:
    """month, currency, rate for coming months: the base month's rates, or the last ones held flat."""
    known = fx if policy != "constant" or base_month is None else fx.filter(F.col("month") <= F.lit(base_month))
    last = known.groupBy("currency").agg(F.max_by("rate", "month").alias("rate"))
    return months.select("month").crossJoin(F.broadcast(last))  # currencies are few


# ---------------------------------------------------------------- keeping the mapping


def allocation_errors(changes: DataFrame, accounts: DataFrame, oems: DataFrame) -> DataFrame:
    """account_id, error: why a change (account_id, oem, region, pct) cannot be taken; the first reason that holds. Sound changes have no row."""
    by = changes.join(oems.select(F.col("oem").alias("_known")).distinct(), F.col("oem") == F.col("_known"), "left").groupBy("account_id").agg(
        F.sum("pct").cast("double").alias("total"),
        F.min("pct").cast("double").alias("least"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("oem", "region").alias("different"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
    )
    by = by.join(accounts.select("account_id", "account_type"), "account_id", "left")
    error = (
        F.when(F.abs(F.col("total") - 1) > 1e-6, "shares must sum to 1")
        .when(F.col("least") <= 0, "shares must be positive")
        .when(F.col("different") < F.col("n"), "an oem and region twice")
        .when(F.col("account_type").isNull(), "unknown account")
        .when((F.col("account_type") != "DISTRIBUTOR") & (F.col("n") > 1), "only distributors may be split")
        .when(F.col("unknown") > 0, "unknown oem")
    )
    return by.select("account_id", error.alias("error")).filter("error is not null")


def close_active(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """The mapping rows after ``changes`` (account_id, new_from) close what was active: rows that begin at or after the change are superseded
    with no length, others end where the change begins; rows that wait for review are superseded."""
    new = changes.groupBy("account_id").agg(F.min("new_from").alias("_new"))
    out = mapping.join(new, "account_id", "left")
    active = (F.col("status") == "ACTIVE") & F.col("_new").isNotNull()
    late = active & (F.col("valid_from") >= F.col("_new"))
    ends = active & ~late & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_new")))
    waits = (F.col("status") == "PENDING_REVIEW") & F.col("_new").isNotNull()
    return out.withColumns(
        {
            "valid_to": F.when(late, F.col("valid_from")).when(ends, F.col("_new")).otherwise(F.col("valid_to")),
            "status": F.when(late | waits, "SUPERSEDED").otherwise(F.col("status")),
        }
    ).select(mapping.columns)


def set_mapping(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """The mapping after sound ``changes`` (account_id, oem, region, pct, valid_from; a null start means from the beginning)."""
    new = changes.withColumn("valid_from", F.coalesce("valid_from", F.lit(OPEN_START)))
    closed = close_active(mapping, new.select("account_id", F.col("valid_from").alias("new_from")))
    rows = {"status": F.lit("ACTIVE"), "source": F.lit("MANUAL"), "confidence": F.lit(1.0), "valid_to": F.lit(None).cast("date")}
    columns = [F.col(c) if c in changes.columns else rows.get(c, F.lit(None)).cast(mapping.schema[c].dataType).alias(c) for c in mapping.columns]
    return closed.unionByName(new.select(*columns))


def review(mapping: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mapping after ``decisions`` (mapping_id, approve, oem, region, valid_from; the last three may be null) on rows that wait for review."""
    d = decisions.select("mapping_id", "approve", F.col("oem").alias("_oem"), F.col("region").alias("_region"), F.col("valid_from").alias("_from"))
    waiting = mapping.filter(F.col("status") == "PENDING_REVIEW").join(d, "mapping_id")
    changed = waiting.select(
        *(
            {
                "oem": F.when(F.col("approve"), F.coalesce("_oem", "oem")).otherwise(F.col("oem")).alias("oem"),
                "region": F.when(F.col("approve"), F.coalesce("_region", "region")).otherwise(F.col("region")).alias("region"),
                "valid_from": F.when(F.col("approve"), F.coalesce("_from", "valid_from")).otherwise(F.col("valid_from")).alias("valid_from"),
                "status": F.when(F.col("approve"), "ACTIVE").otherwise("REJECTED").alias("status"),
            }.get(c, F.col(c))
            for c in mapping.columns
        )
    )
    rest = mapping.join(changed.select("mapping_id"), "mapping_id", "left_anti").select(mapping.columns)
    approved = changed.filter(F.col("status") == "ACTIVE").select("account_id", F.col("valid_from").alias("new_from"))
    # other rows that wait stay: a review closes only what was active
    waits = rest.filter(F.col("status") == "PENDING_REVIEW")
    return close_active(rest.filter(F.col("status") != "PENDING_REVIEW"), approved).unionByName(waits).unionByName(changed)
