"""Queries on the commercial signal. Users of the event stream stand for opportunities, its days for months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import commercial
from tidecast.plans import estate
from tidecast.plans.registry import query

ASOF = date(2025, 9, 1)
#: Event types as open stages.
_STAGES = {"view": 1, "click": 2, "error": 3, "purchase": 4, "signup": 5}


def _snaps(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot for each user and month (day d of the stream is month d from 2024 on), until an opportunity closes in its own month."""
    e = estate.table(spark, sf, "events").select("user_id", (F.dayofmonth("ts") - 1).alias("d"), "event_id", "event_type", "value")
    last = e.groupBy("user_id", "d").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x"))
    close = F.col("user_id") % 17 + 8
    stage = F.when(F.col("d") == close, F.when(F.col("user_id") % 3 == 0, 7).otherwise(6)).otherwise(F.coalesce(*(F.when(F.col("x.event_type") == t, s) for t, s in _STAGES.items())))
    rows = last.filter((F.col("d") < close) | ((F.col("d") == close) & (F.col("user_id") % 5 != 0)) | (F.col("user_id") % 5 == 0))
    stage = F.when(F.col("user_id") % 5 == 0, F.coalesce(*(F.when(F.col("x.event_type") == t, s) for t, s in _STAGES.items()))).otherwise(stage)
    month = lambda d: F.add_months(F.lit(date(2024, 1, 1)), d.cast("int"))
    return rows.select(
        F.col("user_id").alias("opportunity_id"), month(F.col("d")).alias("snapshot_month"), stage.cast("int").alias("stage"), (F.floor("x.value") + 1).cast("double").alias("quantity_units"),
        month(F.when(F.col("user_id") % 5 == 0, F.col("d") + 2).otherwise(close - F.col("d") % 3 + 1)).alias("expected_close_month"), (F.col("d") % 4).cast("int").alias("months_in_stage"), (F.col("d") % 3).cast("int").alias("push_count"),
        ((F.col("user_id") % 8 + 1) / 16).alias("rep_probability"), (F.col("d") % 2 == 0).alias("quote_issued"),
    )


def _opps(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    users = estate.table(spark, sf, "events").select("user_id").distinct()
    month = lambda d: F.add_months(F.lit(date(2024, 1, 1)), d.cast("int"))
    return users.select(
        u.alias("id"), F.concat(F.lit("P"), (u % 4).cast("string")).alias("product"), (u % 9).alias("rep_id"), F.lit(date(2023, 10, 1)).alias("created_month"), (u % 3 + 1).cast("int").alias("ramp_months"),
        (u % 50 + 5).cast("double").alias("quantity_units"), F.when(u % 3 != 0, month(u % 17 + 8 + u % 5)).alias("first_delivery_month"),
    )


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    part = lambda o, p: F.struct(F.lit(o).alias("oem"), F.lit(p).alias("pct"))
    rows = estate.table(spark, sf, "events").select("user_id").distinct().select("user_id", F.explode(F.when(u % 4 == 0, F.array(part("A", 0.75), part("B", 0.25))).otherwise(F.array(part("A", 1.0)))).alias("p"))
    return rows.select(u.alias("opportunity_id"), "p.oem", F.concat(F.lit("R"), (u % 2).cast("string")).alias("region"), "p.pct")


_BASE = """snaps AS (SELECT user_id AS opportunity_id, CAST(DATE '2024-01-01' + to_months(CAST(d AS INTEGER)) AS DATE) AS snapshot_month, CASE WHEN user_id % 5 <> 0 AND d = cl THEN CASE WHEN user_id % 3 = 0 THEN 7 ELSE 6 END
    ELSE CASE t WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END END AS stage, CAST(floor(v) + 1 AS DOUBLE) AS quantity_units,
    CAST(DATE '2024-01-01' + to_months(CAST(CASE WHEN user_id % 5 = 0 THEN d + 2 ELSE cl - d % 3 + 1 END AS INTEGER)) AS DATE) AS expected_close_month, (user_id % 8 + 1) / 16.0::DOUBLE AS rep_probability
  FROM (SELECT user_id, day(ts) - 1 AS d, user_id % 17 + 8 AS cl, max_by(event_type, event_id) AS t, max_by(value, event_id) AS v FROM events GROUP BY ALL) WHERE user_id % 5 = 0 OR d <= cl),
opps AS (SELECT user_id AS id, 'P' || (user_id % 4) AS product, user_id % 9 AS rep_id, user_id % 3 + 1 AS ramp_months, CAST(user_id % 50 + 5 AS DOUBLE) AS quantity_units,
  CASE WHEN user_id % 3 <> 0 THEN CAST(DATE '2024-01-01' + to_months(CAST(user_id % 17 + 8 + user_id % 5 AS INTEGER)) AS DATE) END AS first_delivery_month FROM (SELECT DISTINCT user_id FROM events)),
closed AS (SELECT opportunity_id, snapshot_month AS closed_month, CASE WHEN stage = 6 THEN 1 ELSE 0 END AS won FROM snaps WHERE stage >= 6),
last_open AS (SELECT opportunity_id, max_by(rep_probability, snapshot_month) AS p, max_by(quantity_units, snapshot_month) AS q FROM snaps WHERE stage <= 5 GROUP BY ALL)"""
_REPS = """by_month AS (SELECT rep_id, closed_month AS month, count(*) AS n, sum(won) AS w, sum(p) AS p FROM closed c JOIN opps ON id = c.opportunity_id LEFT JOIN last_open l ON l.opportunity_id = c.opportunity_id GROUP BY ALL),
spine AS (SELECT * FROM (SELECT DISTINCT rep_id FROM by_month) CROSS JOIN (SELECT DISTINCT snapshot_month AS month FROM snaps)),
run AS (SELECT s.rep_id, s.month, coalesce(sum(n) OVER w, 0)::DOUBLE AS n, coalesce(sum(b.w) OVER w, 0)::DOUBLE AS w, coalesce(sum(p) OVER w, 0.0::DOUBLE) AS p FROM spine s LEFT JOIN by_month b ON b.rep_id = s.rep_id AND b.month = s.month
  WINDOW w AS (PARTITION BY s.rep_id ORDER BY s.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reps AS (SELECT rep_id, month, (w + 0.3::DOUBLE * 6) / (n + 6) AS rep_win_rate, (p + 0.3::DOUBLE * 6) / (n + 6) - (w + 0.3::DOUBLE * 6) / (n + 6) AS rep_gap, n AS rep_n_closed FROM run)"""
_SLIPS = """late AS (SELECT stage, greatest(least(datediff('month', expected_close_month, closed_month), 8), -3) AS pos FROM snaps s JOIN closed c ON c.opportunity_id = s.opportunity_id WHERE stage <= 5 AND won = 1),
slips AS (SELECT CAST(g.stage AS INTEGER) AS stage, CAST(g.pos AS INTEGER) AS pos, CASE WHEN t.n IS NULL THEN 1.0::DOUBLE / 12 ELSE (coalesce(k.c, 0) + 0.5::DOUBLE) / (t.n + 6.0::DOUBLE) END AS p
  FROM (SELECT * FROM range(1, 6) a(stage), range(-3, 9) b(pos)) g LEFT JOIN (SELECT stage, count(*) AS n FROM late GROUP BY stage) t ON t.stage = g.stage LEFT JOIN (SELECT stage, pos, count(*) AS c FROM late GROUP BY ALL) k ON k.stage = g.stage AND k.pos = g.pos)"""
_DONE = """done AS (SELECT o.*, c.closed_month FROM opps o JOIN closed c ON c.opportunity_id = o.id WHERE won = 1 AND closed_month <= DATE '2025-03-01' AND first_delivery_month <= DATE '2025-09-01'),
waits AS (SELECT product, greatest(least(datediff('month', closed_month, first_delivery_month), 6), 0) AS pos FROM done),
delays AS (SELECT g.product, CAST(g.pos AS INTEGER) AS pos, CASE WHEN t.n >= 10 THEN (coalesce(k.c, 0) + 0.5::DOUBLE) / (t.n + 3.5::DOUBLE) WHEN a.n > 0 THEN (coalesce(pk.c, 0) + 0.5::DOUBLE) / (a.n + 3.5::DOUBLE) ELSE 1.0::DOUBLE / 7 END AS p
  FROM (SELECT DISTINCT product, pos FROM opps, range(0, 7) b(pos)) g LEFT JOIN (SELECT product, count(*) AS n FROM waits GROUP BY product) t ON t.product = g.product LEFT JOIN (SELECT product, pos, count(*) AS c FROM waits GROUP BY ALL) k ON k.product = g.product AND k.pos = g.pos
  LEFT JOIN (SELECT pos, count(*) AS c FROM waits GROUP BY pos) pk ON pk.pos = g.pos CROSS JOIN (SELECT count(*) AS n FROM waits) a),
factors AS (SELECT rep_id, (CAST(sum(CAST(floor(quantity_units / q * 1e9::DOUBLE) AS HUGEINT)) AS DOUBLE) / 1e9::DOUBLE + 3.0::DOUBLE) / (count(*) + 3.0::DOUBLE) AS factor
  FROM done JOIN last_open ON opportunity_id = id WHERE first_delivery_month + CAST(ramp_months * 30 AS INTEGER) <= DATE '2025-09-01' GROUP BY rep_id)"""


@query(f"WITH {_BASE}, {_REPS} SELECT * FROM reps")
def rep_stats(spark: SparkSession, sf: str) -> DataFrame:
    return commercial.rep_stats(_opps(spark, sf), _snaps(spark, sf))


@query(f"WITH {_BASE}, {_SLIPS} SELECT stage, pos, p FROM slips")
def slip_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return commercial.slips(_snaps(spark, sf)).withColumnRenamed("at", "pos")


@query(f"WITH {_BASE}, {_DONE} SELECT product, pos, p FROM delays")
def delay_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return commercial.delays(_opps(spark, sf), _snaps(spark, sf), F.lit(ASOF)).withColumnRenamed("at", "pos")


@query(f"WITH {_BASE}, {_DONE} SELECT rep_id, factor FROM factors")
def quantity_factors(spark: SparkSession, sf: str) -> DataFrame:
    return commercial.quantity_factors(_opps(spark, sf), _snaps(spark, sf), F.lit(ASOF))


@query(
    f"""WITH {_BASE}, {_REPS} SELECT s.opportunity_id, s.snapshot_month, s.stage, datediff('month', DATE '2023-10-01', s.snapshot_month)::INTEGER AS age, datediff('month', s.snapshot_month, expected_close_month)::INTEGER AS months_to_close,
  s.quantity_units / first_value(s.quantity_units) OVER (PARTITION BY s.opportunity_id ORDER BY s.snapshot_month) AS qty_vs_first, coalesce(rep_win_rate, 0.3::DOUBLE) AS rep_win_rate, coalesce(rep_gap, 0.0::DOUBLE) AS rep_gap, coalesce(rep_n_closed, 0.0::DOUBLE) AS rep_n_closed
FROM snaps s JOIN opps o ON o.id = s.opportunity_id LEFT JOIN reps r ON r.rep_id = o.rep_id AND r.month = s.snapshot_month"""
)
def commercial_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = commercial.features(_opps(spark, sf), _snaps(spark, sf))
    return rows.select("opportunity_id", "snapshot_month", "stage", "age", "months_to_close", "qty_vs_first", "rep_win_rate", "rep_gap", "rep_n_closed")


_STEADY = lambda x: f"CAST(sum(CAST(floor(({x}) * 1e9::DOUBLE) AS HUGEINT)) AS DOUBLE) / 1e9::DOUBLE"
_KNOWN = _BASE.replace("WHERE user_id % 5 = 0 OR d <= cl)", "WHERE (user_id % 5 = 0 OR d <= cl) AND d <= 20)")
_UPLIFT = f"""WITH {_KNOWN}, {_SLIPS}, {_DONE},
pipe AS (SELECT s.opportunity_id, product, s.stage, s.rep_probability, s.quantity_units * coalesce(factor, 1.0::DOUBLE) AS qty, ramp_months AS ramp, datediff('month', DATE '2025-09-01', expected_close_month) AS due,
  CASE s.stage WHEN 1 THEN 0.10::DOUBLE WHEN 2 THEN 0.18::DOUBLE WHEN 3 THEN 0.30::DOUBLE WHEN 4 THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END AS win_prob
  FROM snaps s JOIN opps o ON o.id = s.opportunity_id LEFT JOIN factors f ON f.rep_id = o.rep_id WHERE snapshot_month = DATE '2025-09-01' AND s.stage <= 5),
chance AS (SELECT opportunity_id, greatest(due + s.pos, 1) + d.pos AS k, {_STEADY('s.p * d.p')} AS p FROM pipe JOIN slips s ON s.stage = pipe.stage JOIN delays d ON d.product = pipe.product GROUP BY ALL),
monthly AS (SELECT p.opportunity_id, CAST(unnest(generate_series(k, least(k + ramp - 1, 12))) AS INTEGER) AS j, c.p / ramp AS s FROM chance c JOIN pipe p ON p.opportunity_id = c.opportunity_id WHERE k <= 12),
share AS (SELECT opportunity_id, j, {_STEADY('s')} AS share FROM monthly GROUP BY ALL),
nodes AS (SELECT opportunity_id, unnest(CASE WHEN opportunity_id % 4 = 0 THEN ['A', 'B'] ELSE ['A'] END) AS oem, unnest(CASE WHEN opportunity_id % 4 = 0 THEN [0.75::DOUBLE, 0.25::DOUBLE] ELSE [1.0::DOUBLE] END) AS pct, 'R' || (opportunity_id % 2) AS region FROM pipe),
uplift AS (SELECT p.opportunity_id, oem, region, product, CAST(DATE '2025-09-01' + to_months(j) AS DATE) AS month, stage, win_prob, rep_probability, win_prob * (qty * pct * share) AS expected_units, qty * pct * share AS unweighted_units
  FROM share s JOIN pipe p ON p.opportunity_id = s.opportunity_id JOIN nodes n ON n.opportunity_id = s.opportunity_id)"""


def uplift_rows(spark: SparkSession, sf: str) -> DataFrame:
    opps, snaps, asof = _opps(spark, sf), _snaps(spark, sf), F.lit(ASOF)
    known = snaps.filter(F.col("snapshot_month") <= asof)
    return commercial.uplift(commercial.open_pipeline(opps, snaps, asof), _nodes(spark, sf), commercial.slips(known), commercial.delays(opps, known, asof), asof)


@query(f"{_UPLIFT} SELECT * FROM uplift")
def uplift_expectation(spark: SparkSession, sf: str) -> DataFrame:
    return uplift_rows(spark, sf)


@query(
    f"""{_UPLIFT}, per AS (SELECT oem, region, product, opportunity_id, {_STEADY('expected_units')} AS e FROM uplift GROUP BY ALL)
SELECT oem, region, product, arg_max(opportunity_id, e + opportunity_id * 1e-12::DOUBLE) AS top, max(e) / ({_STEADY('e')}) AS share, count(*) AS n FROM per GROUP BY ALL"""
)
def pipeline_top1(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators.risk import top_share

    return top_share(uplift_rows(spark, sf))


@query(
    estate.with_views(
        "bt",
        f"""d AS (SELECT CASE WHEN h <= 3 THEN 1 WHEN h <= 6 THEN 2 ELSE 3 END AS bucket, y, mean, CASE WHEN length(unique_id) % 2 = 0 THEN y * 0.125::DOUBLE ELSE 0.0::DOUBLE END AS g FROM bt WHERE model = 'Naive'),
pool AS (SELECT CASE WHEN count(*) FILTER (g > 0) >= 80 THEN greatest(least(({_STEADY('g * (y - mean)')}) / greatest({_STEADY('g * g')}, 1e-9::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS p FROM d),
b AS (SELECT bucket, count(*) FILTER (g > 0) AS n, greatest(least(({_STEADY('g * (y - mean)')}) / greatest({_STEADY('g * g')}, 1e-9::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS s FROM d GROUP BY bucket),
beta AS (SELECT bucket, n, CASE WHEN n >= 80 THEN s * n / (n + 40) + p * 40 / (n + 40) ELSE p END AS beta FROM b, pool),
e AS (SELECT 1 - ({_STEADY('abs(y - mean - beta * g)')}) / ({_STEADY('abs(y - mean)')}) AS improvement FROM d JOIN beta USING (bucket))
SELECT bucket, CASE WHEN improvement > 0 THEN beta ELSE 0.0::DOUBLE END AS beta, n, improvement FROM beta, e""",
    )
)
def net_beta(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the series get an uplift that is an eighth of what came."""
    from tidecast.operators import backtest, panel

    bt = backtest.naive_backtest(panel.long(estate.panel(spark, sf))).filter("model = 'Naive'")
    gross = F.when(F.length("unique_id") % 2 == 0, F.col("y") * 0.125).otherwise(0.0)
    return commercial.net_factors(bt.withColumn("gross", gross))


@query()
def win_model(spark: SparkSession, sf: str) -> DataFrame:
    out = commercial.win_chances(_opps(spark, sf), _snaps(spark, sf), F.lit(ASOF), trees=10)
    return out if out is not None else spark.createDataFrame([], "opportunity_id long, win_prob double")


@query()
def uplift_samples(spark: SparkSession, sf: str) -> DataFrame:
    opps, snaps, asof = _opps(spark, sf), _snaps(spark, sf), F.lit(ASOF)
    known = snaps.filter(F.col("snapshot_month") <= asof)
    return commercial.uplift_samples(commercial.open_pipeline(opps, snaps, asof), _nodes(spark, sf), commercial.slips(known), commercial.delays(opps, known, asof), asof)


@query(
    f"""WITH {_BASE}, n AS (SELECT opportunity_id, unnest(CASE WHEN opportunity_id % 4 = 0 THEN ['A', 'B'] ELSE ['A'] END) AS oem, unnest(CASE WHEN opportunity_id % 4 = 0 THEN [0.75::DOUBLE, 0.25::DOUBLE] ELSE [1.0::DOUBLE] END) AS pct FROM (SELECT DISTINCT opportunity_id FROM snaps))
SELECT oem, 'R' || (s.opportunity_id % 2) AS region, 'P' || (s.opportunity_id % 4) AS product, snapshot_month AS month, coalesce(sum(quantity_units * pct) FILTER (stage <= 5), 0.0::DOUBLE) AS pipeline_open, coalesce(sum(quantity_units * pct) FILTER (stage = 6), 0.0::DOUBLE) AS won_qty FROM snaps s JOIN n ON n.opportunity_id = s.opportunity_id GROUP BY ALL"""
)
def pipeline_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return commercial.drivers(_opps(spark, sf), _snaps(spark, sf), _nodes(spark, sf))


@query(
    f"""{_UPLIFT}, per AS (SELECT opportunity_id, oem, region, product, stage, max(win_prob) AS win_prob, {_STEADY('expected_units')} AS expected_units, {_STEADY('unweighted_units')} AS unweighted_units FROM uplift WHERE oem = 'A' AND region = 'R1' GROUP BY ALL)
SELECT *, expected_units / (SELECT {_STEADY('expected_units')} FROM per) AS share_of_uplift FROM per ORDER BY expected_units DESC, opportunity_id LIMIT 40"""
)
def node_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.operators import views

    return views.node_opportunities(uplift_rows(spark, sf), oem="A", region="R1")
