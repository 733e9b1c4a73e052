"""Exact quantiles of groups of any size, with linear interpolation.

A sketch cuts each group into ``BINS`` bins; counts tell the bins of the wanted ranks, and only those bins' values are ordered. So no task holds a group.
The input is read twice: for the sketch, and for the counts of equal values, which are checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.sources.tables import checkpointed

BINS = 256


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, levels: list[Column], name: str = "q") -> DataFrame:
    """keys, n, ``name``: the quantiles of ``value`` (nulls left out) as an array, in the order of ``levels``, which are expressions of ``n`` (the group's count) between 0 and 1."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    cuts = F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], 2000)
    groups = checkpointed(rows.groupBy(*keys).agg(cuts.alias("_cuts"), F.count(F.lit(1)).alias("n")))
    # equal values are counted before anything is ordered
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).join(groups.select(*keys, "_cuts"), list(keys))
    counted = checkpointed(counted.withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"))
    before = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))  # BINS rows a group
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_in")).withColumn("_before", F.coalesce(before, F.lit(0)))
    at = groups.select(*keys, "n", F.posexplode(F.array(*(((F.col("n") - 1) * x).cast("double") for x in levels))).alias("_k", "_at"))
    at = at.withColumns({"_lo": F.floor("_at").cast("long"), "_hi": F.ceil("_at").cast("long")})
    wanted = bins.join(at, list(keys)).filter("_before <= _hi and _before + _in > _lo")
    some = counted.join(wanted.select(*keys, "_bin", "_before").distinct(), [*keys, "_bin"])
    to = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    some = some.withColumn("_to", to).join(at, list(keys)).filter("_to > _lo and _to - _c <= _hi")
    rank = lambda r: F.min(F.when(F.col("_to") > F.col(r), F.col("_v")))
    ends = some.groupBy(*keys, "n", "_k", "_at", "_lo", "_hi").agg(rank("_lo").alias("_low"), rank("_hi").alias("_high"))
    q = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.col("_lo"))
    return ends.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", q.alias("q")))), lambda s: s["q"]).alias(name))  # an entry for each level


def exact_quantile(df: DataFrame, keys: tuple[str, ...], value: str, level: Column, name: str = "q") -> DataFrame:
    """keys, n, ``name``: one quantile."""
    return exact_quantiles(df, keys, value, [level], name).withColumn(name, F.col(name)[0])
