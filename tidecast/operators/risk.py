"""Risks: thin backlog, short capacity, uplift that hangs on one opportunity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import months_between
from tidecast.functions.metrics import steady_sum
from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators.hierarchy import DIMS

HIGH, MEDIUM = 1_000_000.0, 250_000.0
COVERAGE_MONTHS, DEPTH, COVERAGE_CAP = 3, 17, 1.5
# What holds where no threshold is set.
DEFAULTS = {"min_coverage": 0.60, "use_history": True, "concentration": 0.70, "max_stage": 3, "min_uplift_share": 0.05}


def severity(impact: Column) -> Column:
    return F.when(impact >= HIGH, "HIGH").when(impact >= MEDIUM, "MEDIUM").otherwise("LOW")


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``rows`` (product, region) with the settings of the best match: product and region, then product, then region, then neither, then the defaults.

    ``thresholds`` has threshold_id, product, region (null: any) and the settings. Four lookups by equal keys, no comparison of all with all."""
    settings = list(DEFAULTS)
    first = Window.partitionBy("product", "region").orderBy("threshold_id")
    t = thresholds.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("product", "region", F.struct(*settings).alias("_s"))
    kinds = (
        (t.filter("product is not null and region is not null"), ["product", "region"]),
        (t.filter("product is not null and region is null").drop("region"), ["product"]),
        (t.filter("product is null and region is not null").drop("product"), ["region"]),
    )
    out = rows
    for k, (some, keys) in enumerate(kinds):
        out = out.join(some.withColumnRenamed("_s", f"_s{k}"), keys, "left")
    rest = t.filter("product is null and region is null").agg(F.first("_s").alias("_s3"))
    out = out.crossJoin(F.broadcast(rest))  # one row
    base = F.struct(*(F.lit(v).cast(thresholds.schema[c].dataType).alias(c) for c, v in DEFAULTS.items()))
    best = F.coalesce("_s0", "_s1", "_s2", "_s3", base)
    return out.withColumn("_best", best).select(*rows.columns, *(F.col("_best")[c].alias(c) for c in settings))


def historical_coverage(backlog: DataFrame, actuals: DataFrame, cycle: Column, depth: int = DEPTH) -> DataFrame:
    """product, h, p10, median, n of backlog over what was shipped, by months ahead, in the ``depth`` months before ``cycle``. Ratios are cut at 1.5.

    ``backlog`` has snapshot_month, month, oem, region, product, units; ``actuals`` has month, oem, region, product, y."""
    seen = backlog.filter((F.col("snapshot_month") < cycle) & (F.col("snapshot_month") >= F.add_months(cycle, -depth)) & (F.col("month") <= cycle) & (F.col("oem") != "UNMAPPED"))
    seen = seen.groupBy("snapshot_month", "month", *DIMS).agg(F.sum("units").alias("units"))
    rows = seen.join(actuals.filter("y > 0"), ["month", *DIMS]).withColumn("h", months_between(F.col("month"), F.col("snapshot_month")))
    rows = rows.filter(F.col("h").between(1, COVERAGE_MONTHS)).withColumn("cov", F.greatest(F.least(F.col("units") / F.col("y"), F.lit(COVERAGE_CAP)), F.lit(0.0)))
    q = exact_quantiles(rows, ("product", "h"), "cov", [F.lit(0.1), F.lit(0.5)])
    return q.select("product", "h", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), "n")


def coverage_table(consensus: DataFrame, backlog: DataFrame, thresholds: DataFrame, history: DataFrame) -> DataFrame:
    """The next three months of ``consensus`` (oem, region, product, month, horizon, consensus_units, asp) with bl_units, bl_value, coverage (null for zero plans), threshold and
    configured_floor. ``backlog`` (month, oem, region, product, units, value) is the current snapshot's. The threshold is the floor, or the tenth percentile of history if that is lower and used."""
    b = backlog.groupBy("month", *DIMS).agg(F.sum("units").alias("bl_units"), F.sum("value").alias("bl_value"))
    t = consensus.filter(F.col("horizon") <= COVERAGE_MONTHS).join(b, ["month", *DIMS], "left").fillna(0.0, ["bl_units", "bl_value"])
    t = t.withColumn("coverage", F.when(F.col("consensus_units") > 1e-9, F.col("bl_units") / F.col("consensus_units")))
    t = with_thresholds(t, thresholds).join(history.select("product", F.col("h").alias("horizon"), "p10"), ["product", "horizon"], "left")
    limit = F.when(F.col("use_history") & F.col("p10").isNotNull(), F.least("min_coverage", "p10")).otherwise(F.col("min_coverage"))
    return t.withColumn("threshold", limit).withColumn("configured_floor", F.col("min_coverage")).select(*consensus.columns, "bl_units", "bl_value", "coverage", "threshold", "configured_floor")


def revenue_gaps(coverage: DataFrame) -> DataFrame:
    """oem, region, product, first_month, last_month, n_months, impact, severity: what the plan has beyond the backlog in months whose coverage is below the threshold."""
    plan = F.col("consensus_units") * F.col("asp")
    bad = coverage.filter((F.col("coverage") < F.col("threshold")) & (plan > 0))
    by = bad.groupBy(*DIMS).agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months"), steady_sum(F.greatest(plan - F.col("bl_value"), F.lit(0.0))).alias("impact"))
    return by.filter("impact > 0").withColumn("severity", severity(F.col("impact")))


def supply_bottlenecks(consensus: DataFrame, capacity: DataFrame) -> DataFrame:
    """region, product, first_month, last_month, n_months, peak, impact, severity: units beyond capacity (month, region, product, capacity), at the mean price; only where capacity is given."""
    by = consensus.groupBy("month", "region", "product").agg(F.sum("consensus_units").alias("units"), steady_sum(F.col("consensus_units") * F.col("asp")).alias("rev"))
    over = by.join(capacity, ["month", "region", "product"]).withColumn("excess", F.greatest(F.col("units") - F.col("capacity"), F.lit(0.0))).filter("excess > 1e-6")
    price = F.when(F.col("units") > 0, F.col("rev") / F.col("units")).otherwise(0.0)
    out = over.groupBy("region", "product").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months"), F.max("excess").alias("peak"), steady_sum(F.col("excess") * price).alias("impact")
    )
    return out.withColumn("severity", severity(F.col("impact")))


def top_share(uplift: DataFrame) -> DataFrame:
    """oem, region, product, top (the opportunity that brings most, of equals the greatest id), share, n."""
    per = uplift.groupBy(*DIMS, "opportunity_id").agg(steady_sum(F.col("expected_units")).alias("e"))
    return per.groupBy(*DIMS).agg(F.max_by("opportunity_id", F.struct("e", "opportunity_id")).alias("top"), (F.max("e") / steady_sum(F.col("e"))).alias("share"), F.count(F.lit(1)).alias("n"))


def pipeline_risks(uplift: DataFrame, points: DataFrame, thresholds: DataFrame) -> DataFrame:
    """oem, region, product, top, stage, share, impact, severity of leaves whose net uplift matters and hangs on one early opportunity.

    ``points`` has oem, region, product, units, uplift (net), gross, asp of the forecast."""
    top = top_share(uplift).filter("share is not null")
    stage = uplift.groupBy(*DIMS, F.col("opportunity_id").alias("top")).agg(F.max("stage").alias("stage"), steady_sum(F.col("expected_units")).alias("e"))
    f = points.groupBy(*DIMS).agg(
        F.sum("uplift").alias("net"), F.sum("gross").alias("gross"), F.sum("units").alias("units"), (F.sum(F.col("asp") * F.col("units")) / F.greatest(F.sum("units"), F.lit(1e-9))).alias("price")
    )
    rows = with_thresholds(top.join(stage, [*DIMS, "top"]).join(f, list(DIMS)), thresholds).filter("gross > 1e-9 and net > 1e-9 and units > 0")
    rows = rows.filter("share >= concentration and stage <= max_stage and net / units >= min_uplift_share")
    impact = F.col("e") * F.col("net") / F.col("gross") * F.col("price")
    return rows.select(*DIMS, "top", "stage", "share", impact.alias("impact"), severity(impact).alias("severity"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """alert_type, n, impact of alerts that aren't resolved."""
    return alerts.filter("status <> 'RESOLVED'").groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"), steady_sum(F.col("impact")).alias("impact"))


def set_thresholds(thresholds: DataFrame, changes: DataFrame) -> DataFrame:
    """``thresholds`` after ``changes`` (threshold_id, product, region and the settings): the last change, by threshold_id, of a product and region (null: any) takes the place of what was set for them, and keeps its id."""
    key = F.struct(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c) for c in ("product", "region")))
    both = thresholds.withColumn("_new", F.lit(0)).unionByName(changes.select(thresholds.columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct("product", "region", *DEFAULTS), F.struct("_new", "threshold_id")).alias("_s")
    by = both.groupBy(key.alias("_key")).agg(F.min_by("threshold_id", F.struct("_new", "threshold_id")).alias("threshold_id"), last)
    return by.select("threshold_id", "_s.*").select(thresholds.columns)


def patch_alerts(alerts: DataFrame, patches: DataFrame, fields: tuple[str, ...] = ("status", "owner", "note")) -> DataFrame:
    """``alerts`` after ``patches`` (alert_id, seq and fields; null leaves a field as it is): of each field the last one given counts."""
    last = patches.groupBy("alert_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields))
    out = alerts.join(last, "alert_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    return out.select(alerts.columns)
