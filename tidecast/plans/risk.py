"""Queries on coverage, alerts and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import quality, risk, views
from tidecast.plans import estate
from tidecast.plans.registry import SQL, query
from tidecast.sources.tables import checkpointed


def _actuals(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    return estate.series(spark, sf, facts).select("month", "oem", "region", "product", F.col("units").alias("y"))


def _thresholds(spark: SparkSession) -> DataFrame:
    rows = [(1, None, None, 0.6, True, 0.7, 3, 0.05), (2, "SMALL", None, 0.4, True, 0.7, 3, 0.05), (3, "SMALL", "ASIA", 0.2, True, 0.7, 3, 0.05), (4, None, "EUROPE", 0.9, False, 0.5, 4, 0.01)]
    return spark.createDataFrame(rows, "threshold_id int, product string, region string, min_coverage double, use_history boolean, concentration double, max_stage int, min_uplift_share double")


_FLOOR = "CASE WHEN {p} = 'SMALL' AND {r} = 'ASIA' THEN 0.2::DOUBLE WHEN {p} = 'SMALL' THEN 0.4::DOUBLE WHEN {r} = 'EUROPE' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END"
_HISTORY = f"""cov AS (SELECT b.product, datediff('month', b.snapshot_month, b.month)::INTEGER AS h, greatest(least(b.units / s.units, 1.5::DOUBLE), 0.0::DOUBLE) AS c FROM backlog b JOIN series s ON s.month = b.month AND s.oem = b.oem AND s.region = b.region AND s.product = b.product
  WHERE s.units > 0 AND b.snapshot_month < {estate.CYCLE_SQL} AND b.snapshot_month >= CAST({estate.CYCLE_SQL} - INTERVAL 17 MONTH AS DATE) AND b.month <= {estate.CYCLE_SQL}),
rk AS (SELECT product, h, c, row_number() OVER w - 1 AS k, (count(*) OVER n - 1) * 0.1::DOUBLE AS p, (count(*) OVER n - 1) * 0.5::DOUBLE AS m FROM cov WHERE h BETWEEN 1 AND 3 WINDOW w AS (PARTITION BY product, h ORDER BY c), n AS (PARTITION BY product, h)),
history AS (SELECT product, h, min(c) FILTER (k = floor(p)) + (min(c) FILTER (k = ceil(p)) - min(c) FILTER (k = floor(p))) * (min(p) - floor(min(p))) AS p10,
  min(c) FILTER (k = floor(m)) + (min(c) FILTER (k = ceil(m)) - min(c) FILTER (k = floor(m))) * (min(m) - floor(min(m))) AS median, count(*) AS n FROM rk GROUP BY product, h)"""
_COVERAGE = f"""{_HISTORY}, now_ AS (SELECT month, oem, region, product, units, value FROM backlog WHERE snapshot_month = {estate.CYCLE_SQL}),
coverage AS (SELECT p.*, coalesce(b.units, 0.0::DOUBLE) AS bl_units, coalesce(b.value, 0.0::DOUBLE) AS bl_value, CASE WHEN consensus_units > 1e-9 THEN coalesce(b.units, 0.0::DOUBLE) / consensus_units END AS coverage,
  {_FLOOR.format(p='p.product', r='p.region')} AS configured_floor, CASE WHEN p10 IS NOT NULL AND NOT (p.region = 'EUROPE' AND p.product <> 'SMALL') THEN least({_FLOOR.format(p='p.product', r='p.region')}, p10) ELSE {_FLOOR.format(p='p.product', r='p.region')} END AS threshold
  FROM plan p LEFT JOIN now_ b ON b.month = p.month AND b.oem = p.oem AND b.region = p.region AND b.product = p.product LEFT JOIN history h ON h.product = p.product AND h.h = p.horizon WHERE p.horizon <= 3)"""


@query(f"SELECT DISTINCT p_type AS product, r_name AS region, {_FLOOR.format(p='p_type', r='r_name')} AS min_coverage FROM part, region")
def threshold_best_match(spark: SparkSession, sf: str) -> DataFrame:
    pairs = estate.table(spark, sf, "part").select(F.col("p_type").alias("product")).distinct().crossJoin(estate.table(spark, sf, "region").select(F.col("r_name").alias("region")))  # 30 rows
    return risk.with_thresholds(pairs, _thresholds(spark)).select("product", "region", "min_coverage")


def _history(spark: SparkSession, sf: str, facts: DataFrame, backlog: DataFrame) -> DataFrame:
    return risk.historical_coverage(backlog, _actuals(spark, sf, facts), F.lit(estate.CYCLE))


@query(estate.with_views("series backlog", f"{_HISTORY} SELECT * FROM history"))
def historical_p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    return _history(spark, sf, facts, estate.backlog(spark, sf, facts))


def _coverage(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    backlog = estate.backlog(spark, sf, facts)
    now = backlog.filter(F.col("snapshot_month") == F.lit(estate.CYCLE)).drop("snapshot_month")
    return risk.coverage_table(estate.plan(spark, sf, facts), now, _thresholds(spark), _history(spark, sf, facts, backlog))


@query(estate.with_views("plan backlog series", f"{_COVERAGE} SELECT oem, region, product, month, bl_units, bl_value, coverage, threshold, configured_floor FROM coverage"))
def coverage_table(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf, estate.facts(spark, sf)).select("oem", "region", "product", "month", "bl_units", "bl_value", "coverage", "threshold", "configured_floor")


_STEADY = lambda x: f"CAST(sum(CAST(floor(({x}) * 1e9::DOUBLE) AS HUGEINT)) AS DOUBLE) / 1e9::DOUBLE"
_SEVERITY = "CASE WHEN impact >= 1000000 THEN 'HIGH' WHEN impact >= 250000 THEN 'MEDIUM' ELSE 'LOW' END AS severity"


@query(
    estate.with_views(
        "plan backlog series",
        f"""{_COVERAGE}, gaps AS (SELECT oem, region, product, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months, {_STEADY('greatest(consensus_units * asp - bl_value, 0.0::DOUBLE)')} AS impact FROM coverage WHERE coverage < threshold AND consensus_units * asp > 0 GROUP BY ALL)
SELECT *, {_SEVERITY} FROM gaps WHERE impact > 0""",
    )
)
def revenue_gap(spark: SparkSession, sf: str) -> DataFrame:
    return risk.revenue_gaps(_coverage(spark, sf, estate.facts(spark, sf)))


_BOTTLENECK = f"""rp AS (SELECT month, region, product, sum(consensus_units) AS units, {_STEADY('consensus_units * asp')} AS rev FROM plan GROUP BY ALL),
over_ AS (SELECT r.*, greatest(units - capacity, 0.0::DOUBLE) AS excess FROM rp r JOIN capacity c ON c.month = r.month AND c.region = r.region AND c.product = r.product),
short AS (SELECT region, product, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months, max(excess) AS peak, {_STEADY('excess * CASE WHEN units > 0 THEN rev / units ELSE 0.0::DOUBLE END')} AS impact FROM over_ WHERE excess > 1e-6 GROUP BY region, product)"""


@query(estate.with_views("plan capacity", f"{_BOTTLENECK} SELECT *, {_SEVERITY} FROM short"))
def supply_bottleneck(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    return risk.supply_bottlenecks(estate.plan(spark, sf, facts), estate.capacity(spark, sf, facts))


@query()
def pipeline_vulnerability(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.plans.commercial import uplift_rows

    up = uplift_rows(spark, sf)
    points = up.groupBy("oem", "region", "product").agg(F.sum("expected_units").alias("gross")).select("oem", "region", "product", (F.col("gross") / 2).alias("uplift"), "gross", (F.col("gross") * 4).alias("units"), F.lit(100.0).alias("asp"))
    some = _thresholds(spark).filter("threshold_id = 1").withColumn("concentration", F.lit(0.25))
    return risk.pipeline_risks(up, points, some)


@query(
    estate.with_views(
        "plan capacity backlog series",
        f"""{_COVERAGE}, gaps AS (SELECT {_STEADY('greatest(consensus_units * asp - bl_value, 0.0::DOUBLE)')} AS impact FROM coverage WHERE coverage < threshold AND consensus_units * asp > 0 GROUP BY oem, region, product), {_BOTTLENECK}
SELECT 'REVENUE_GAP' AS alert_type, count(*) AS n, {_STEADY('impact')} AS impact FROM gaps WHERE impact > 0 UNION ALL SELECT 'SUPPLY_BOTTLENECK', count(*), {_STEADY('impact')} FROM short""",
    )
)
def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    gaps = risk.revenue_gaps(_coverage(spark, sf, facts)).select(F.lit("REVENUE_GAP").alias("alert_type"), "impact", F.lit("OPEN").alias("status"))
    short = risk.supply_bottlenecks(estate.plan(spark, sf, facts), estate.capacity(spark, sf, facts)).select(F.lit("SUPPLY_BOTTLENECK").alias("alert_type"), "impact", F.lit("OPEN").alias("status"))
    return risk.alert_summary(gaps.unionByName(short))


@query(
    estate.with_views(
        "mapped fx backlog capacity",
        f"""m AS (SELECT m.month, m.oem, m.region, m.product, CAST(sum(CAST(m.units AS DECIMAL(18,4))) AS DOUBLE) AS units, CAST(sum(CAST(CAST(m.revenue AS DECIMAL(20,8)) * f.rate AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM mapped m LEFT JOIN fx f ON f.currency = m.currency AND f.month = (SELECT max(month) FROM source) GROUP BY ALL),
k AS (SELECT * FROM m WHERE month <= {estate.CYCLE_SQL}), own AS (SELECT * FROM k WHERE oem <> 'UNMAPPED'), by_month AS (SELECT month, sum(units) AS u FROM own GROUP BY month), top AS (SELECT max(month) AS hi FROM own),
ratio AS (SELECT sum(u) FILTER (month = hi) / avg(u) FILTER (month < hi) AS r FROM by_month, top WHERE month >= CAST(hi - INTERVAL 3 MONTH AS DATE)),
share AS (SELECT coalesce(sum(units) FILTER (oem = 'UNMAPPED'), 0) / sum(units) AS s FROM k), sums AS (SELECT account_id, sum(pct) AS s FROM mapping WHERE valid_to IS NULL GROUP BY account_id),
asp AS (SELECT product, revenue / units AS a, median(revenue / units) OVER (PARTITION BY product) AS mid FROM own WHERE units > 0),
found AS (SELECT 'mapped_series_present' AS check_name, 'ERROR' AS severity, count(*) > 0 AS passed, count(*)::DOUBLE AS metric, NULL::DOUBLE AS threshold FROM k
UNION ALL SELECT 'unmapped_share', CASE WHEN s > 0.1 THEN 'ERROR' ELSE 'WARN' END, s <= 0.03, s, 0.03 FROM share UNION ALL SELECT 'pending_mapping_reviews', 'INFO', true, 0, NULL
UNION ALL SELECT 'allocation_sums', 'ERROR', count(*) = 0, count(*), 0 FROM sums WHERE abs(CAST(s AS DOUBLE) - 1) > 1e-4
UNION ALL SELECT 'history_length', 'WARN', count(DISTINCT month) >= 30, count(DISTINCT month), 30 FROM own UNION ALL SELECT 'latest_month_complete', 'WARN', coalesce(r BETWEEN 0.5 AND 1.6, false), r, 0.5 FROM ratio
UNION ALL SELECT 'negative_values', 'WARN', count(*) = 0, count(*), 0 FROM sales WHERE units < 0 OR revenue < 0 UNION ALL SELECT 'fx_coverage', 'ERROR', true, 0, 0
UNION ALL SELECT 'asp_outliers', 'WARN', count(*) = 0, count(*), 0 FROM asp WHERE abs(ln(greatest(a / mid, 1e-6))) > 1 UNION ALL SELECT 'crm_snapshot_current', 'INFO', true, NULL, 1
UNION ALL SELECT 'backlog_snapshot_current', 'WARN', count(*) > 0, count(*), 1 FROM backlog WHERE snapshot_month = {estate.CYCLE_SQL} UNION ALL SELECT 'capacity_coverage', 'WARN', count(DISTINCT month) >= 12, count(DISTINCT month), 12 FROM capacity)
SELECT check_name, severity, passed, floor(metric * 1000000 + 0.5) / 1000000 AS metric, threshold FROM found""",
    )
)
def dq_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators import mapping

    sales = estate.sales(spark, sf)
    rows = estate.mapping(spark, sf).withColumn("status", F.lit("ACTIVE"))
    facts = estate.facts(spark, sf)
    series = checkpointed(mapping.mapped_series(sales.withColumn("units", F.col("units").cast("decimal(18,2)")), estate.mapping(spark, sf), estate.fx(spark, sf), ends=mapping.rate_ends(facts)))
    backlog = estate.backlog(spark, sf, facts)
    out = quality.run_checks(series, facts, rows, estate.fx(spark, sf), backlog.filter("false"), backlog, estate.capacity(spark, sf, facts), F.lit(estate.CYCLE))
    return out.withColumn("metric", F.floor(F.col("metric") * 1000000 + 0.5) / 1000000)


# ---------------------------------------------------------------- views


@query(
    estate.with_views(
        "plan panel capacity backlog",
        f"""h AS (SELECT month, 'history' AS kind, sum(units) AS units, CAST(NULL AS DOUBLE) AS consensus_units, CAST(NULL AS DOUBLE) AS bl_units, CAST(NULL AS DOUBLE) AS capacity FROM panel WHERE month <= {estate.CYCLE_SQL} AND region = 'ASIA' AND product = 'SMALL' GROUP BY month),
f AS (SELECT month, 'forecast' AS kind, sum(ai_units) AS units, sum(consensus_units) AS consensus_units FROM plan WHERE region = 'ASIA' AND product = 'SMALL' GROUP BY month)
SELECT * FROM h UNION ALL SELECT f.month, f.kind, f.units, f.consensus_units, b.u, c.c FROM f LEFT JOIN (SELECT month, sum(units) AS u FROM backlog WHERE snapshot_month = {estate.CYCLE_SQL} AND region = 'ASIA' AND product = 'SMALL' GROUP BY month) b ON b.month = f.month
LEFT JOIN (SELECT month, sum(capacity) AS c FROM capacity WHERE region = 'ASIA' AND product = 'SMALL' GROUP BY month) c ON c.month = f.month""",
    )
)
def explorer(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    now = estate.backlog(spark, sf, facts).filter(F.col("snapshot_month") == F.lit(estate.CYCLE))
    return views.explorer(estate.panel(spark, sf, facts), estate.plan(spark, sf, facts), now, estate.capacity(spark, sf, facts), F.lit(estate.CYCLE), region="ASIA", product="SMALL")


@query(
    estate.with_views(
        "plan",
        f"""j AS (SELECT * FROM plan), one AS (SELECT * FROM j WHERE horizon = 1)
SELECT (SELECT {_STEADY('consensus_units * asp')} FROM plan) AS consensus_revenue, (SELECT {_STEADY('ai_units * asp')} FROM plan) AS ai_revenue, (SELECT sum(abs(ai_units - y)) / sum(abs(y)) FROM j) AS ai_wmape, (SELECT sum(abs(consensus_units - y)) / sum(abs(y)) FROM j) AS consensus_wmape,
  (SELECT count(*) FROM one) AS n_first, (SELECT count(*) FROM plan WHERE overridden) AS n_overridden""",
    )
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    p = checkpointed(estate.plan(spark, sf))
    return views.dashboard(p, p.select("month", "oem", "region", "product", "y"))


@query(
    f"""{estate.with_views("series", "SELECT 'oem' AS dim, oem AS value FROM (SELECT DISTINCT oem FROM series) UNION ALL SELECT 'region', region FROM (SELECT DISTINCT region FROM series) UNION ALL SELECT 'product', product FROM (SELECT DISTINCT product FROM series)")}"""
)
def filter_lists(spark: SparkSession, sf: str) -> DataFrame:
    return views.filter_lists(estate.series(spark, sf))


# ---------------------------------------------------------------- edits


@query(
    f"""WITH t AS (SELECT p_type, r_name, {_FLOOR.format(p='p_type', r='r_name')} AS floor_ FROM (SELECT DISTINCT p_type FROM part), region)
SELECT p_type AS product, r_name AS region, CASE WHEN p_type = 'SMALL' AND r_name = 'ASIA' THEN 0.3::DOUBLE WHEN p_type = 'LARGE' THEN 0.1::DOUBLE ELSE floor_ END AS min_coverage FROM t"""
)
def threshold_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Floors after three changes, of which one takes the place of what was set and two are for one product."""
    old = _thresholds(spark)
    rows = [(11, "SMALL", "ASIA", 0.3, True, 0.7, 3, 0.05), (12, "LARGE", None, 0.5, True, 0.7, 3, 0.05), (13, "LARGE", None, 0.1, True, 0.7, 3, 0.05)]
    pairs = estate.table(spark, sf, "part").select(F.col("p_type").alias("product")).distinct().crossJoin(estate.table(spark, sf, "region").select(F.col("r_name").alias("region")))  # 30 rows
    return risk.with_thresholds(pairs, risk.set_thresholds(old, spark.createDataFrame(rows, old.schema))).select("product", "region", "min_coverage")


@query(
    """SELECT o_orderkey AS alert_id, CASE WHEN o_orderkey % 3 = 0 THEN 'RESOLVED' WHEN o_orderkey % 3 = 1 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN 'u1' ELSE 'u0' END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'done' END AS note FROM orders"""
)
def alert_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts after two patches each for a third and one for another third."""
    k = F.col("o_orderkey")
    alerts = estate.table(spark, sf, "orders").select(k.alias("alert_id"), F.lit("OPEN").alias("status"), F.lit("u0").alias("owner"), F.lit(None).cast("string").alias("note"))
    first = alerts.select("alert_id", F.lit(1).alias("seq"), F.when(F.col("alert_id") % 3 < 2, "ACKNOWLEDGED").alias("status"), F.when(F.col("alert_id") % 3 < 2, "u1").alias("owner"), "note")
    second = alerts.select("alert_id", F.lit(2).alias("seq"), F.when(F.col("alert_id") % 3 == 0, "RESOLVED").alias("status"), F.lit(None).cast("string").alias("owner"), F.when(F.col("alert_id") % 3 == 0, "done").alias("note"))
    return risk.patch_alerts(alerts, first.unionByName(second))


@query(estate.with_views("series", f"SELECT k.*, CAST({estate.CYCLE_SQL} + to_months(CAST(h AS INTEGER)) AS DATE) AS month, 0.0::DOUBLE AS units FROM (SELECT DISTINCT oem, region, product FROM series) k, range(1, 13) r(h)"))
def uplift_without_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators.commercial import no_uplift

    return no_uplift(estate.series(spark, sf), F.lit(estate.CYCLE))


@query(
    """WITH p AS (SELECT o_orderkey AS mapping_id, o_custkey AS account_id, o_orderpriority AS oem, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT mapping_id, account_id, oem, EXISTS (SELECT 1 FROM orders t WHERE t.o_orderstatus = 'F' AND t.o_custkey = p.account_id AND t.o_orderpriority = p.oem) AS approve FROM p WHERE n % 9 <> 0"""
)
def steward_replay(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.sources import synthetic

    o = estate.table(spark, sf, "orders")
    pending = o.select(F.col("o_orderkey").alias("mapping_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("oem"))
    return synthetic.steward_replay(pending, o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("oem")))


@query(f"SELECT * FROM ({SQL['dq_checks']}) WHERE severity = 'ERROR' AND NOT passed")
def blocking_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of the data checks those that stop a forecast."""
    from tidecast.operators import quality

    return quality.blocking(dq_checks(spark, sf))
