"""Queries on models, prices and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import backtest, forecast_run, mapping, models, panel, prices, reconcile
from tidecast.plans import estate
from tidecast.plans.registry import query
from tidecast.sources.tables import checkpointed

KEYS = ("oem", "region", "product")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return panel.long(estate.panel(spark, sf))


@query()
def ets_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return models.forecast(_long(spark, sf), ("AutoETS",))


@query()
def arima_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return models.forecast(_long(spark, sf), ("AutoARIMA",))


@query()
def croston_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return models.forecast(_long(spark, sf), ("CrostonSBA", "TSB"))


@query()
def gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return models.boosted(_long(spark, sf))


@query()
def model_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all models of single series, with the ensemble."""
    facts = estate.facts(spark, sf)
    long = panel.long(estate.panel(spark, sf, facts))
    own = backtest.with_actuals(models.forecast(long, ("AutoETS", "AutoARIMA", "CrostonSBA", "TSB"), first=backtest.FIRST), long)
    bt = backtest.add_ensemble(checkpointed(backtest.naive_backtest(long).unionByName(own)))
    segment = estate.series(spark, sf, facts).select(F.concat_ws("|", *KEYS).alias("unique_id"), F.lit("smooth").alias("segment")).distinct()
    return backtest.score_horizons(bt, segment)


@query()
def model_status(spark: SparkSession, sf: str) -> DataFrame:
    return models.model_status(models.forecast(_long(spark, sf), tuple(models.MODELS)))


_BACK = """holes AS (SELECT *, CASE WHEN units > 1e-9 THEN revenue / units END AS a FROM panel),
back AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY oem, region, product ORDER BY month ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS b FROM holes),
hist AS (SELECT oem, region, product, month, units, first_value(b IGNORE NULLS) OVER (PARTITION BY oem, region, product ORDER BY month ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS asp FROM back)"""


@query(estate.with_views("panel", f"{_BACK} SELECT * FROM hist"))
def asp_history(spark: SparkSession, sf: str) -> DataFrame:
    return prices.asp_history(estate.panel(spark, sf))


_TRAIL = """trail AS (SELECT oem, region, product, count(*) AS n, CAST(sum(CAST(floor(asp * 1e9::DOUBLE) AS HUGEINT)) FILTER (k <= 6) AS DOUBLE) / 1e9::DOUBLE / count(*) FILTER (k <= 6) AS asp
  FROM (SELECT *, row_number() OVER (PARTITION BY oem, region, product ORDER BY month DESC) AS k FROM hist WHERE asp IS NOT NULL) GROUP BY ALL)"""


@query(estate.with_views("panel", f"{_BACK}, {_TRAIL} SELECT * FROM trail"))
def asp_trailing(spark: SparkSession, sf: str) -> DataFrame:
    return prices.trailing_price(prices.asp_history(estate.panel(spark, sf)))


@query()
def asp_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return prices.price_forecast(prices.asp_history(estate.panel(spark, sf)))


@query()
def asp_backtest(spark: SparkSession, sf: str) -> DataFrame:
    h = prices.asp_history(estate.panel(spark, sf))
    return prices.price_error(prices.price_forecast(h, 6, "2000-06-01"), h)


def _contract_prices(spark: SparkSession, sf: str) -> DataFrame:
    c = estate.table(spark, sf, "customer").join(estate.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(estate.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    month = lambda n: F.add_months(F.lit(estate.CYCLE), n.cast("int"))
    currency = F.coalesce(*(F.when(F.col("r_name") == r, x) for r, x in estate.CURRENCY.items()))
    contracts = c.select(
        k.alias("account_id"), F.when(k % 2 == 0, "SMALL").otherwise("LARGE").alias("product"), month(-(k % 30)).alias("start_month"), month(k % 9).alias("end_month"), (k % 40 + 1).cast("double").alias("committed_units"),
        (k % 100 + 900).cast("double").alias("price"), currency.alias("currency"), F.lit(0.25).alias("annual_change"),
    )
    months = F.sequence(F.add_months(F.lit(estate.CYCLE), 1), F.add_months(F.lit(estate.CYCLE), 6), F.expr("interval 1 month"))
    coming = spark.range(1).select(F.explode(months).alias("month"))
    rates = mapping.future_rates(estate.fx(spark, sf), coming, "constant", estate.CYCLE)
    active = estate.mapping(spark, sf).filter(mapping.valid_at(F.lit(estate.CYCLE), F.col("valid_from"), F.col("valid_to")))
    return prices.contract_prices(contracts, active, rates, months)


_CONTRACTS = f"""ahead AS (SELECT CAST(unnest(generate_series(CAST({estate.CYCLE_SQL} + INTERVAL 1 MONTH AS DATE), CAST({estate.CYCLE_SQL} + INTERVAL 6 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month),
c AS (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END AS product, CAST({estate.CYCLE_SQL} - to_months(CAST(c_custkey % 30 AS INTEGER)) AS DATE) AS s, CAST({estate.CYCLE_SQL} + to_months(CAST(c_custkey % 9 AS INTEGER)) AS DATE) AS e,
  CAST(c_custkey % 40 + 1 AS DOUBLE) AS committed, CAST(c_custkey % 100 + 900 AS DOUBLE) AS price, CASE r_name {" ".join(f"WHEN '{r}' THEN '{x}'" for r, x in estate.CURRENCY.items())} END AS currency FROM customer JOIN places ON c_nationkey = n_nationkey),
p AS (SELECT c.*, a.month, c.price * pow(1.25::DOUBLE, floor(greatest(datediff('month', s, a.month), 0) / 12)) * CAST(f.rate AS DOUBLE) AS usd, m.oem, m.region, CAST(m.pct AS DOUBLE) AS pct FROM c JOIN ahead a ON s <= a.month AND a.month <= e
  JOIN (SELECT currency, max_by(rate, month) AS rate FROM fx WHERE month <= {estate.CYCLE_SQL} GROUP BY currency) f ON f.currency = c.currency JOIN mapping m ON m.account_id = c.account_id AND m.valid_from <= {estate.CYCLE_SQL} AND (m.valid_to IS NULL OR {estate.CYCLE_SQL} < m.valid_to)),
priced AS (SELECT oem, region, product, month, usd AS price FROM p QUALIFY row_number() OVER (PARTITION BY oem, region, product, month ORDER BY s DESC, account_id DESC) = 1),
held AS (SELECT oem, region, product, month, CAST(sum(CAST(floor((committed * pct) * 1e9::DOUBLE) AS HUGEINT)) AS DOUBLE) / 1e9::DOUBLE AS committed FROM p GROUP BY ALL),
contract AS (SELECT q.oem, q.region, q.product, q.month, q.price, h.committed FROM priced q JOIN held h ON h.oem = q.oem AND h.region = q.region AND h.product = q.product AND h.month = q.month)"""


@query(estate.with_views("mapping fx", f"{_CONTRACTS} SELECT * FROM contract"))
def contract_price_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _contract_prices(spark, sf)


@query(
    estate.with_views(
        "panel plan mapping fx",
        f"""{_BACK}, {_TRAIL}, {_CONTRACTS},
f AS (SELECT p.oem, p.region, p.product, p.month, t.asp, 0.12::DOUBLE AS sigma, p.ai_units, c.price, CASE WHEN c.price IS NOT NULL THEN greatest(least(c.committed / greatest(p.ai_units, 1e-6::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS weight
  FROM plan p JOIN trail t ON t.oem = p.oem AND t.region = p.region AND t.product = p.product LEFT JOIN contract c ON c.oem = p.oem AND c.region = p.region AND c.product = p.product AND c.month = p.month)
SELECT oem, region, product, month, CASE WHEN price IS NOT NULL THEN weight * price + (1 - weight) * asp ELSE asp END AS asp, sigma * (1 - 0.7::DOUBLE * weight) AS sigma, weight FROM f""",
    )
)
def asp_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing prices of the plan's months under contracts."""
    facts = estate.facts(spark, sf)
    plan = estate.plan(spark, sf, facts)
    stat = prices.trailing_price(prices.asp_history(estate.panel(spark, sf, facts))).select(*KEYS, "asp", F.lit(0.12).alias("sigma"))
    rows = plan.select(*KEYS, "month").join(stat, list(KEYS)).select(*KEYS, "month", "asp", "sigma")
    return prices.blend(rows, _contract_prices(spark, sf), plan.select(*KEYS, "month", F.col("ai_units").alias("units")))


@query(
    estate.with_views(
        "plan",
        """n AS (SELECT *, unnest(['ALL|ALL|ALL', 'ALL|' || region || '|ALL', oem || '|ALL|ALL', 'ALL|ALL|' || product, oem || '|' || region || '|ALL', oem || '|' || region || '|' || product]) AS unique_id FROM plan) SELECT unique_id, month AS ds, sum(ai_units) AS mean FROM n GROUP BY ALL""",
    )
)
def bottom_up(spark: SparkSession, sf: str) -> DataFrame:
    plan = estate.plan(spark, sf)
    rows = plan.select(F.concat_ws("|", *KEYS).alias("unique_id"), F.col("month").alias("ds"), F.col("ai_units").alias("mean"))
    return reconcile.reconciled_structural(rows, plan.select(*KEYS))


@query()
def mint_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    p = estate.panel(spark, sf)
    nodes = forecast_run.node_panel(p)
    return reconcile.reconcile(models.forecast(nodes, ("SeasonalNaive",)), p.select(*KEYS), models.residuals(nodes, "SeasonalNaive"))


@query(
    estate.with_views(
        "panel",
        """o AS (SELECT oem, month, sum(units) AS units FROM panel GROUP BY ALL), a AS (SELECT month, sum(units) AS units FROM panel GROUP BY ALL),
y AS (SELECT oem, CAST(max(units) AS DOUBLE) AS y FROM o WHERE month > (SELECT CAST(max(month) - INTERVAL 12 MONTH AS DATE) FROM panel) GROUP BY oem),
t AS (SELECT CAST(max(units) AS DOUBLE) AS y FROM a WHERE month > (SELECT CAST(max(month) - INTERVAL 12 MONTH AS DATE) FROM panel)),
n AS (SELECT count(*) AS n, sum(y) AS s FROM y),
b AS (SELECT oem, greatest(y.y + (t.y - s) / (2 * n), 0) AS b FROM y, t, n)
SELECT oem AS unique_id, round(b, 4) AS mean FROM b UNION ALL SELECT 'ALL', round(sum(b), 4) FROM b""",
    )
)
def struct_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """The highest month of the last year of each oem and of all, made coherent with variances by the number of leaves: of n oems each takes 1 / 2n of what the total lacks."""
    p = estate.panel(spark, sf)
    last = p.agg(F.add_months(F.max("month"), -12)).first()[0]
    year = p.filter(F.col("month") > last)
    top = lambda df, node: df.groupBy("month").agg(F.sum("units").alias("units")) if node is None else df.groupBy(node, "month").agg(F.sum("units").alias("units"))
    own = top(year, "oem").groupBy(F.col("oem").alias("unique_id")).agg(F.max("units").alias("mean"))
    whole = top(year, None).agg(F.lit("ALL").alias("unique_id"), F.max("units").alias("mean"))
    forecasts = own.unionByName(whole).withColumn("ds", F.lit(estate.CYCLE))
    up = p.select("oem").distinct().select(F.explode(F.array(F.lit("ALL"), "oem")).alias("node"), F.col("oem").alias("leaf"))
    return reconcile.reconcile(forecasts, p, None, "wls_struct", up=up).select("unique_id", F.round("mean", 4).alias("mean"))


@query()
def sample_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = estate.panel(spark, sf)
    nodes = forecast_run.node_panel(p)
    paths = reconcile.sample_paths(models.forecast(nodes, ("SeasonalNaive",)), p.select(*KEYS), models.residuals(nodes, "SeasonalNaive"))
    return reconcile.sample_quantiles(paths)


@query()
def forecast_points(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run with all fast models."""
    return forecast_run.run(estate.panel(spark, sf), ("SeasonalNaive", "AutoETS", "AutoARIMA", "CrostonSBA", "TSB")).points


@query()
def benchmark_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the naive models with every model's status and champions."""
    from tidecast.operators import views

    long = _long(spark, sf)
    bt = backtest.naive_backtest(long)
    segment = long.select("unique_id", F.lit("smooth").alias("segment")).distinct()
    chosen = backtest.champions(backtest.score_buckets(bt, segment), backtest.priors_table(spark, {"smooth": ["SeasonalNaive"]}))
    return views.benchmark_rows(backtest.score_horizons(bt, segment), models.model_status(bt), chosen)
