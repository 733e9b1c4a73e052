"""A whole forecast: panel, segments, backtest, champions, calibration, uplift, reconciliation, prices and revenue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import DEFAULT, EngineConfig
from tidecast.operators import backtest, models, prices, reconcile, segments
from tidecast.operators.hierarchy import DIMS, node_id, rollup
from tidecast.sources.tables import checkpointed

FAST = ("SeasonalNaive", "AutoETS", "AutoARIMA", "CrostonSBA", "TSB")
_NODE = ("unique_id",)


@dataclass
class Forecast:
    """What a run gives: points (nodes by month), scores by horizon, champions, calibration, status of models and segments of series."""

    points: DataFrame
    scores: DataFrame
    champions: DataFrame
    calibration: DataFrame
    status: DataFrame
    segments: DataFrame


def node_panel(panel: DataFrame) -> DataFrame:
    """unique_id, ds, y of all nodes."""
    nodes = rollup(panel, {"y": F.sum("units")})
    return nodes.select(node_id(*(F.col(d) for d in DIMS)).alias("unique_id"), F.col("month").alias("ds"), F.col("y").cast("double").alias("y"))


def final_baseline(rows: DataFrame, segment: DataFrame, chosen: DataFrame, members: DataFrame) -> DataFrame:
    """Of each series and horizon the champion's forecast; the ensemble's is the mean of its members', and where the champion has none the fallback's stands."""
    mean = [F.avg(c).alias(c) for c in ("mean", "q10", "q50", "q90")]
    pooled = rows.join(F.broadcast(members), "model").groupBy("unique_id", "origin", "h", "ds").agg(*mean).withColumn("model", F.lit("Ensemble"))
    both = backtest.with_champion(rows.unionByName(pooled.select(rows.columns)), segment, chosen)
    order = F.when(F.col("model") == F.col("champion"), 0).when(F.col("model") == backtest.FALLBACK, 1)
    return both.filter(order.isNotNull()).groupBy("unique_id", "origin", "h", "ds").agg(F.min_by(F.struct("model", "mean", "q10", "q50", "q90"), order).alias("f")).select("unique_id", "h", "ds", "f.*")


def ensemble_members(bt: DataFrame, n: int = 3) -> DataFrame:
    """model: the ``n`` best of those that aren't naive."""
    from tidecast.functions.metrics import wmape

    ranked = bt.filter(~F.col("model").isin("Naive", "SeasonalNaive", "Ensemble")).groupBy("model").agg(wmape(F.col("y"), F.col("mean")).alias("e"))
    return ranked.orderBy(F.col("e").asc_nulls_last(), "model").limit(n).select("model")


def run(panel: DataFrame, names: tuple[str, ...] = FAST, uplift: DataFrame | None = None, config: EngineConfig = DEFAULT) -> Forecast:
    """A forecast of dense leaves (oem, region, product, month, units, revenue). ``uplift`` (oem, region, product, month, units) is net and is added to leaves before their sums.

    The panel and the backtest are written once and read again, as later stages each need them."""
    spark = panel.sparkSession
    nodes = checkpointed(node_panel(panel))
    segment = segments.segment(nodes.withColumnsRenamed({"ds": "month", "y": "units"}), _NODE, (), config).select("unique_id", "segment")
    segment = checkpointed(segment)
    # fitting costs most: what models give is written before anything reads it twice
    own = checkpointed(models.forecast(nodes, tuple(n for n in names if n != "SeasonalNaive"), config.horizon, first=backtest.FIRST))
    own = backtest.with_actuals(own, nodes)
    bt = checkpointed(backtest.add_ensemble(backtest.naive_backtest(nodes, config.horizon).unionByName(own)))
    priors = backtest.priors_table(spark, segments.PRIORS)
    chosen = checkpointed(backtest.champions(backtest.score_buckets(bt, segment), priors, config.champion_tolerance))
    calibration = checkpointed(backtest.fit_conformal(backtest.champion_rows(bt, segment, chosen)))
    ahead = checkpointed(models.forecast(nodes, (*names, "Naive"), config.horizon))
    base = backtest.apply_conformal(final_baseline(ahead, segment, chosen, ensemble_members(bt)), segment, calibration)
    if uplift is not None:
        more = rollup(uplift, {"_u": F.sum("units")}).select(node_id(*(F.col(d) for d in DIMS)).alias("unique_id"), F.col("month").alias("ds"), "_u")
        base = base.join(more, ["unique_id", "ds"], "left").withColumns({c: F.col(c) + F.coalesce("_u", F.lit(0.0)) for c in ("mean", "q10", "q50", "q90")}).drop("_u")
    base = checkpointed(base)
    leaves = panel.select(*DIMS).distinct()
    resid = checkpointed(models.residuals(nodes))
    paths = reconcile.sample_paths(base, leaves, resid, config.reconciliation, config.samples, config.seed)
    bands = reconcile.sample_quantiles(paths)
    point = reconcile.reconcile(base, leaves, resid, config.reconciliation)
    points = point.join(bands, ["unique_id", "ds"])
    parts = F.split("unique_id", r"\|")
    points = points.select(*(parts[i].alias(d) for i, d in enumerate(DIMS)), F.col("ds").alias("month"), "h", F.col("mean").alias("units"), F.least("q10", "mean").alias("units_p10"), F.greatest("q90", "mean").alias("units_p90"))
    price = prices.price_forecast(prices.asp_history(panel), config.horizon)
    leaf = " and ".join(f"{d} <> 'ALL'" for d in DIMS)
    money = prices.revenue(points.filter(leaf).select(*DIMS, "month", "units"), price)
    revenue = rollup(money, {"revenue": F.sum("revenue")}).drop("level")
    points = points.join(revenue, [*DIMS, "month"]).withColumn("asp", F.try_divide("revenue", "units"))
    status = models.model_status(ahead)
    return Forecast(points, backtest.score_horizons(bt, segment), chosen, calibration, status, segment)
