"""An extension: monthly sales kept up to date from a stream of source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_sales(rows: DataFrame, day: str = "ship_ts", late: str = "45 days") -> DataFrame:
    """month, oem, region, product, units, revenue of a stream of rows with a timestamp; rows later than ``late`` are not counted any more."""
    days = rows.withWatermark(day, late).groupBy(F.window(day, "1 day").alias("_w"), "oem", "region", "product")
    sums = days.agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    return sums.select(F.trunc(F.col("_w.start").cast("date"), "MM").alias("month"), F.col("_w.start").cast("date").alias("day"), "oem", "region", "product", "units", "revenue")


def write_monthly(stream: DataFrame, path: str, checkpoint: str):
    """Appends finished days to a table by month; readers sum the days of a month."""
    return stream.writeStream.outputMode("append").format("parquet").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
