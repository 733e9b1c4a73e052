"""Rolling-origin backtests, scores, champions and conformal calibration of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import DEFAULT
from tidecast.functions import metrics
from tidecast.functions.quantiles import exact_quantile
from tidecast.sources.tables import checkpointed

FIRST, STEP, HORIZON = 18, 3, 12
EXACT_HORIZONS = (1, 3, 6, 12)
#: The standard normal's 90 % point.
Z90 = 1.2815515655446004
EXCLUDED = ("Naive",)
FALLBACK = "AutoETS"
COLUMNS = ("model", "unique_id", "origin", "h", "ds", "y", "mean", "q10", "q50", "q90", "scale")


def bucket_of(h: Column) -> Column:
    """1 for three months or fewer, 2 for six or fewer, else 3."""
    return F.when(h <= 3, 1).when(h <= 6, 2).otherwise(3)


def steps(panel: DataFrame, season: int = 12) -> DataFrame:
    """``panel`` (unique_id, ds, y) with t, n and what is known at each month: scale, and the spread of one-step errors of both naive models."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    so_far = Window.partitionBy("unique_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.select("unique_id", "ds", "y", F.row_number().over(w).alias("t"), (F.col("y") - F.lag("y", 1).over(w)).alias("d1"), (F.col("y") - F.lag("y", season).over(w)).alias("ds_"))
    mean = lambda v, c: F.sum(v).over(so_far) / F.count(c).over(so_far)
    near, far = F.col("d1"), F.col("ds_")
    scale = F.when(F.col("t") > season + 1, mean(F.abs(far), far)).otherwise(mean(F.abs(near), near))
    return rows.select("unique_id", "ds", "y", "t", scale.alias("scale"), F.sqrt(mean(near * near, near)).alias("s1"), F.sqrt(mean(far * far, far)).alias("s12"))


def origins(rows: DataFrame, first: int = FIRST, step: int = STEP) -> DataFrame:
    """The months after which a backtest starts: training sizes first, first + step and so on."""
    return rows.filter((F.col("t") >= first) & ((F.col("t") - first) % step == 0))


def inside(mean: Column, spread: Column) -> list[Column]:
    """q10, q50, q90 of a normal band around a mean that is cut at zero."""
    return [F.least(F.greatest(mean - Z90 * spread, F.lit(0.0)), mean).alias("q10"), mean.alias("q50"), F.greatest(mean + Z90 * spread, mean).alias("q90")]


def naive_backtest(panel: DataFrame, horizon: int = HORIZON, first: int = FIRST, step: int = STEP, season: int = 12) -> DataFrame:
    """Backtest rows of the models Naive and SeasonalNaive, as joins of each origin with the months after it and with the months a season before those."""
    rows = steps(panel, season)
    o = origins(rows, first, step).select("unique_id", F.col("ds").alias("origin"), F.col("t").alias("t0"), F.col("y").alias("last"), "scale", "s1", "s12")
    o = o.withColumn("t", F.explode(F.sequence(F.col("t0") + 1, F.col("t0") + horizon)))
    at = o.join(rows.select("unique_id", "t", "ds", "y"), ["unique_id", "t"])
    at = at.join(rows.select("unique_id", (F.col("t") + season).alias("t"), F.col("y").alias("old")), ["unique_id", "t"], "left").withColumn("h", (F.col("t") - F.col("t0")).cast("int"))
    kinds = F.array(
        F.struct(F.lit("Naive").alias("model"), F.col("last").alias("mean"), (F.col("s1") * F.sqrt(F.col("h").cast("double"))).alias("s")),
        F.struct(F.lit("SeasonalNaive").alias("model"), F.col("old").alias("mean"), (F.col("s12") * F.sqrt(F.floor((F.col("h") - 1) / season).cast("double") + 1)).alias("s")),
    )
    both = at.select("unique_id", "origin", "h", "ds", "y", "scale", F.explode(kinds).alias("k")).filter("k.mean is not null")
    return both.select("k.model", "unique_id", "origin", "h", "ds", "y", F.col("k.mean").alias("mean"), *inside(F.col("k.mean"), F.col("k.s")), "scale")


def with_actuals(forecasts: DataFrame, panel: DataFrame, season: int = 12) -> DataFrame:
    """Backtest rows of forecasts (model, unique_id, origin, h, ds, mean, q10, q50, q90), with what came and the scale at the origin."""
    rows = steps(panel, season)
    out = forecasts.join(rows.select("unique_id", "ds", "y"), ["unique_id", "ds"])
    return out.join(rows.select("unique_id", F.col("ds").alias("origin"), "scale"), ["unique_id", "origin"]).select(*COLUMNS)


def add_ensemble(bt: DataFrame, members: int = 3, name: str = "Ensemble") -> DataFrame:
    """``bt`` and, if two models or more aren't naive, the mean of the ``members`` best of these by pooled error."""
    candidates = bt.filter(~F.col("model").isin("Naive", "SeasonalNaive", name))
    ranked = candidates.groupBy("model").agg(metrics.wmape(F.col("y"), F.col("mean")).alias("e")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))  # a row for each model
    best = ranked.withColumn("k", F.row_number().over(Window.orderBy(F.col("e").asc_nulls_last(), "model"))).filter((F.col("k") <= members) & (F.col("n") >= 2))
    pooled = candidates.join(F.broadcast(best.select("model")), "model").groupBy("unique_id", "origin", "h", "ds", "y")
    return bt.unionByName(pooled.agg(*(F.avg(c).alias(c) for c in ("mean", "q10", "q50", "q90", "scale"))).withColumn("model", F.lit(name)))


def measures() -> list[Column]:
    y, mean = F.col("y"), F.col("mean")
    pinball = sum((metrics.pinball(y, F.col(c), q) for c, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))), F.lit(0.0)) / 3
    return [
        metrics.wmape(y, mean).alias("wmape"),
        metrics.mae(y, mean).alias("mae"),
        metrics.mase(y, mean, F.col("scale")).alias("mase"),
        metrics.bias(y, mean).alias("bias"),
        (pinball / F.greatest(F.sum(F.abs(y)) / F.count(y), F.lit(1e-9))).alias("pinball"),
        metrics.coverage(y, F.col("q10"), F.col("q90")).alias("coverage80"),
        F.count(F.lit(1)).alias("n"),
    ]


def _scores(bt: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    rows = bt.join(segments.select("unique_id", "segment"), "unique_id", "left")
    sets = [[F.col("model"), F.col(key)], [F.col("model"), F.col("segment"), F.col(key)]]
    out = rows.groupingSets(sets, F.col("model"), F.col("segment"), F.col(key)).agg(F.grouping("segment").alias("_g"), *measures())
    return out.filter("_g = 1 or segment is not null").withColumn("segment", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("segment"))).drop("_g")


def score_horizons(bt: DataFrame, segments: DataFrame) -> DataFrame:
    """model, segment (ALL too), h and measures at exactly 1, 3, 6 and 12 months."""
    return _scores(bt.filter(F.col("h").isin(*EXACT_HORIZONS)), segments, "h")


def score_buckets(bt: DataFrame, segments: DataFrame) -> DataFrame:
    """model, segment (ALL too), bucket and measures of months 1-3, 4-6 and 7-12."""
    return _scores(bt.withColumn("bucket", bucket_of(F.col("h"))), segments, "bucket")


def champions(scores: DataFrame, priors: DataFrame, tolerance: float = DEFAULT.champion_tolerance) -> DataFrame:
    """segment, bucket, model, wmape, n, best_model, best_wmape, prior_agrees.

    The least error wins (of equals the first name), unless models that suit the segment come within ``tolerance`` of it: then the most suitable of these.
    ``priors`` has segment, model, place."""
    rows = scores.filter(~F.col("model").isin(*EXCLUDED) & F.col("wmape").isNotNull()).join(F.broadcast(priors), ["segment", "model"], "left")  # a few names for each segment
    w = Window.partitionBy("segment", "bucket")
    rows = rows.withColumn("_best", F.first(F.struct("wmape", "model")).over(w.orderBy("wmape", "model")))
    near = F.when((F.col("wmape") <= F.col("_best.wmape") * (1 + tolerance)) & F.col("place").isNotNull(), F.col("place"))
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(near.asc_nulls_last(), "wmape", "model"))).filter("_n = 1")
    return rows.select("segment", "bucket", "model", "wmape", "n", F.col("_best.model").alias("best_model"), F.col("_best.wmape").alias("best_wmape"), F.col("place").isNotNull().alias("prior_agrees"))


def with_champion(rows: DataFrame, segments: DataFrame, chosen: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """``rows`` (unique_id, h) with segment, bucket and champion: the segment's, else that of all, else ``fallback``."""
    own = chosen.select("segment", "bucket", F.col("model").alias("_own"))
    every = chosen.filter("segment = 'ALL'").select("bucket", F.col("model").alias("_all"))
    out = rows.join(segments.select("unique_id", "segment"), "unique_id", "left").withColumn("bucket", bucket_of(F.col("h")))
    out = out.join(F.broadcast(own), ["segment", "bucket"], "left").join(F.broadcast(every), "bucket", "left")  # a row for each segment and bucket
    return out.withColumn("champion", F.coalesce("_own", "_all", F.lit(fallback))).drop("_own", "_all")


def champion_rows(bt: DataFrame, segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """What would have been shipped: of each series and horizon the champion's rows."""
    return with_champion(bt, segments, chosen).filter("model = champion")


def fit_conformal(rows: DataFrame, target: float = 0.8, least: int = 30) -> DataFrame:
    """segment (ALL too), bucket, n, q, raw_coverage: by how many widths the band must grow (or shrink) to hold ``target`` of what came.

    ``rows`` are the champions' backtest rows with segment and bucket; a row's width is its mean, but at least a twentieth of the series' mean demand."""
    own = rows.groupBy("unique_id").agg((F.sum("y") / F.count("y")).alias("_avg"))
    rows = rows.join(own, "unique_id")
    width = F.greatest(F.col("mean"), 0.05 * F.greatest("_avg", F.lit(1e-9)))
    rows = rows.select("segment", "bucket", "y", "q10", "q90", (F.greatest(F.col("q10") - F.col("y"), F.col("y") - F.col("q90")) / width).alias("s"))
    rows = checkpointed(rows)
    both = rows.filter("segment is not null and segment <> 'ALL'").unionByName(rows.withColumn("segment", F.lit("ALL")))
    level = F.least(F.lit(1.0), target * (1 + 1 / F.col("n")))
    q = exact_quantile(both, ("segment", "bucket"), "s", level)
    covered = both.groupBy("segment", "bucket").agg(metrics.coverage(F.col("y"), F.col("q10"), F.col("q90")).alias("raw_coverage"))
    return q.join(covered, ["segment", "bucket"]).filter(F.col("n") >= least)


def apply_conformal(rows: DataFrame, segments: DataFrame, calibration: DataFrame) -> DataFrame:
    """``rows`` (unique_id, h, mean, q10, q90) with bands grown by their segment's calibration, else by that of all, else as they are."""
    own = calibration.select("segment", "bucket", F.col("q").alias("_own"))
    every = calibration.filter("segment = 'ALL'").select("bucket", F.col("q").alias("_all"))
    out = rows.drop("segment", "bucket").join(segments.select("unique_id", "segment"), "unique_id", "left").withColumn("bucket", bucket_of(F.col("h")))
    out = out.join(F.broadcast(own), ["segment", "bucket"], "left").join(F.broadcast(every), "bucket", "left")
    grow = F.coalesce("_own", "_all", F.lit(0.0)) * F.greatest("mean", F.lit(1e-6))
    new = {"q10": F.least(F.greatest(F.col("q10") - grow, F.lit(0.0)), F.col("mean")), "q90": F.greatest(F.col("q90") + grow, F.col("mean"))}
    return out.withColumns(new).select(*rows.drop("segment", "bucket").columns, "segment", "bucket")


def priors_table(spark, priors: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(s, m, i) for s, models in priors.items() for i, m in enumerate(models)], "segment string, model string, place int")


