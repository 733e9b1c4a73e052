"""What the planners' pages show, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import ALL
from tidecast.functions.metrics import steady_sum, wmape
from tidecast.operators.hierarchy import DIMS, at_node, overlaps


def node_history(panel: DataFrame, oem: str = ALL, region: str = ALL, product: str = ALL) -> DataFrame:
    """month, units, revenue, asp of a node."""
    by = at_node(panel, oem, region, product).groupBy("month").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    return by.withColumn("asp", F.when(F.col("units") > 0, F.col("revenue") / F.col("units")))


def explorer(panel: DataFrame, plan: DataFrame, backlog: DataFrame, capacity: DataFrame, cycle: Column, oem: str = ALL, region: str = ALL, product: str = ALL) -> DataFrame:
    """month, kind (history or forecast), units, consensus_units, bl_units, capacity of a node; capacity is known for all oems only."""
    none = F.lit(None).cast("double")
    past = node_history(panel.filter(F.col("month") <= cycle), oem, region, product).select("month", F.lit("history").alias("kind"), "units", none.alias("consensus_units"), none.alias("bl_units"), none.alias("capacity"))
    coming = at_node(plan, oem, region, product).groupBy("month").agg(F.sum("ai_units").alias("units"), F.sum("consensus_units").alias("consensus_units"))
    waiting = at_node(backlog, oem, region, product).groupBy("month").agg(F.sum("units").alias("bl_units"))
    out = coming.join(waiting, "month", "left")
    if oem == ALL:
        out = out.join(at_node(capacity, ALL, region, product).groupBy("month").agg(F.sum("capacity").alias("capacity")), "month", "left")
    else:
        out = out.withColumn("capacity", none)
    return past.unionByName(out.withColumn("kind", F.lit("forecast")))


def node_opportunities(uplift: DataFrame, oem: str = ALL, region: str = ALL, product: str = ALL, top: int = 40) -> DataFrame:
    """The opportunities that bring a node most, with their share of its uplift."""
    by = at_node(uplift, oem, region, product).groupBy("opportunity_id", *DIMS, "stage").agg(
        F.max("win_prob").alias("win_prob"), steady_sum(F.col("expected_units")).alias("expected_units"), steady_sum(F.col("unweighted_units")).alias("unweighted_units")
    )
    total = by.agg(steady_sum(F.col("expected_units")).alias("_t"))
    rows = by.crossJoin(F.broadcast(total)).withColumn("share_of_uplift", F.try_divide("expected_units", "_t")).drop("_t")  # one row
    return rows.orderBy(F.col("expected_units").desc(), "opportunity_id").limit(top)


def node_overrides(overrides: DataFrame, oem: str = ALL, region: str = ALL, product: str = ALL, top: int = 50) -> DataFrame:
    """The newest overrides of nodes that overlap a node."""
    under = overlaps([F.col(d) for d in DIMS], [F.lit(x) for x in (oem, region, product)])
    return overrides.filter(under).orderBy(F.col("override_id").desc()).limit(top)


def dashboard(plan: DataFrame, actuals: DataFrame) -> DataFrame:
    """One row: revenues of the plan, and how near the frozen forecasts came in months that have actuals."""
    money = plan.agg(steady_sum(F.col("consensus_units") * F.col("asp")).alias("consensus_revenue"), steady_sum(F.col("ai_units") * F.col("asp")).alias("ai_revenue"), F.count_if("overridden").alias("n_overridden"))
    rows = plan.drop("y").join(actuals, ["month", *DIMS])
    y = F.col("y")
    real = rows.agg(wmape(y, F.col("ai_units")).alias("ai_wmape"), wmape(y, F.col("consensus_units")).alias("consensus_wmape"), F.count_if(F.col("horizon") == 1).alias("n_first"))
    return money.crossJoin(real)  # a row each


def filter_lists(series: DataFrame) -> DataFrame:
    """dim, value: what each dimension may be."""
    return reduce(DataFrame.unionByName, (series.select(F.lit(d).alias("dim"), F.col(d).alias("value")).distinct() for d in DIMS))


def benchmark_rows(scores: DataFrame, status: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scores with each model's status and whether it is a champion; models that could not run have a row of their own. An endless score is 9999."""
    best = chosen.select("segment", "model").distinct().withColumn("is_champion", F.lit(True))
    finite = [F.when(F.col(c).isNull() | F.isnan(c), None).when(F.abs(F.col(c)) == float("inf"), 9999.0).otherwise(F.col(c)).alias(c) for c in ("wmape", "mae", "mase", "bias", "pinball", "coverage80")]
    rows = scores.select("model", "segment", "h", *finite, "n").join(best, ["segment", "model"], "left").withColumn("is_champion", F.coalesce("is_champion", F.lit(False)))
    return rows.join(status, "model", "full")
