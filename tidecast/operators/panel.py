"""Dense monthly panels of series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import UNMAPPED
from tidecast.functions.dates import month_range
from tidecast.operators.hierarchy import DIMS, node_id


def dense(series: DataFrame, values: tuple[str, ...] = ("units", "revenue"), until: date | None = None, keys: tuple[str, ...] = DIMS) -> DataFrame:
    """Each series with every month from the first month of any to ``until`` (the last month of any); months without a row are zero. Unmapped rows are left out.

    The months come with each key as an array, so no row meets rows of other keys; repeated rows of a month are summed."""
    if "oem" in keys:
        series = series.filter(F.col("oem") != UNMAPPED)
    if until is not None:
        series = series.filter(F.col("month") <= F.lit(until))
    ends = series.agg(F.min("month").alias("lo"), (F.lit(until) if until is not None else F.max("month")).alias("hi"))
    summed = series.groupBy(*keys, "month").agg(*(F.sum(v).alias(v) for v in values))
    grid = summed.select(*keys).distinct().crossJoin(F.broadcast(ends))  # one row of bounds
    grid = grid.select(*keys, F.explode(month_range(F.col("lo"), F.col("hi"))).alias("month"))
    return grid.join(summed, [*keys, "month"], "left").fillna(0.0, list(values))


def long(panel: DataFrame, value: str = "units") -> DataFrame:
    """unique_id, ds, y."""
    return panel.select(node_id(*(F.col(d) for d in DIMS)).alias("unique_id"), F.col("month").alias("ds"), F.col(value).cast("double").alias("y"))


def data_hash(panel: DataFrame) -> DataFrame:
    """One row: a hash of all rows that does not depend on their order."""
    return panel.agg(F.sum(F.xxhash64(*panel.columns).cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n")).select(
        F.sha2(F.concat_ws("|", F.col("total").cast("string"), F.col("n").cast("string")), 256).alias("data_hash")
    )
