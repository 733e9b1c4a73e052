"""Queries on backtests, champions, calibration and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.quantiles import exact_quantile
from tidecast.operators import backtest, drift, panel
from tidecast.plans import estate
from tidecast.plans.registry import query
from tidecast.sources.tables import checkpointed


def _bt(spark: SparkSession, sf: str, facts: DataFrame | None = None) -> DataFrame:
    return checkpointed(backtest.naive_backtest(panel.long(estate.panel(spark, sf, facts))))


def _segments(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    s = estate.series(spark, sf, facts).select("oem", "region", "product").distinct()
    return s.select(F.concat_ws("|", "oem", "region", "product").alias("unique_id"), F.when(F.length("product") % 2 == 0, "smooth").otherwise("erratic").alias("segment"))


def _contest(spark: SparkSession, sf: str, facts: DataFrame) -> DataFrame:
    """The backtest with the naive model under a name that may win."""
    return _bt(spark, sf, facts).withColumn("model", F.when(F.col("model") == "Naive", "AutoETS").otherwise(F.col("model")))


_SEGMENT = "CASE WHEN length(split_part(unique_id, '|', 3)) % 2 = 0 THEN 'smooth' ELSE 'erratic' END"
_STEADY = lambda x: f"CAST(sum(CAST(floor({x} * 1e9::DOUBLE) AS HUGEINT)) AS DOUBLE) / 1e9::DOUBLE / count({x})"
_PINBALL = lambda c, q: _STEADY(f"greatest({q}::DOUBLE * (y - {c}), ({q}::DOUBLE - 1) * (y - {c}))")
_MEASURES = f"""sum(abs(y - mean)) / sum(abs(y)) AS wmape, sum(abs(y - mean)) / count(*) AS mae, {_STEADY('(CASE WHEN scale > 0 THEN abs(y - mean) / scale END)')} AS mase, sum(y - mean) / sum(y) AS bias,
  ({_PINBALL('q10', 0.1)} + {_PINBALL('q50', 0.5)} + {_PINBALL('q90', 0.9)}) / 3 / greatest(sum(abs(y)) / count(*), 1e-9::DOUBLE) AS pinball,
  CAST(count(*) FILTER (y >= q10 AND y <= q90) AS DOUBLE) / count(*) AS coverage80, count(*) AS n"""
_BUCKET = "CASE WHEN h <= 3 THEN 1 WHEN h <= 6 THEN 2 ELSE 3 END"


@query(estate.with_views("bt", "SELECT * FROM bt"))
def rolling_origin_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _bt(spark, sf)


@query(
    estate.with_views(
        "bt",
        f"rows AS (SELECT *, {_SEGMENT} AS segment FROM bt WHERE h IN (1, 3, 6, 12)) SELECT model, CASE WHEN grouping(segment) = 1 THEN 'ALL' ELSE segment END AS segment, h, {_MEASURES} FROM rows GROUP BY GROUPING SETS ((model, h), (model, segment, h))",
    )
)
def metric_grid(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    return backtest.score_horizons(_bt(spark, sf, facts), _segments(spark, sf, facts))


_SCORES = f"""rows AS (SELECT * REPLACE (CASE WHEN model = 'Naive' THEN 'AutoETS' ELSE model END AS model), {_SEGMENT} AS segment, {_BUCKET} AS bucket FROM bt),
scores AS (SELECT model, CASE WHEN grouping(segment) = 1 THEN 'ALL' ELSE segment END AS segment, bucket, {_MEASURES} FROM rows GROUP BY GROUPING SETS ((model, bucket), (model, segment, bucket))),
priors AS (SELECT * FROM (VALUES ('smooth', 'AutoETS', 0), ('erratic', 'SeasonalNaive', 0)) p(segment, model, place)),
chosen AS (SELECT segment, bucket, model, wmape, n, best_model, best_wmape, place IS NOT NULL AS prior_agrees FROM (SELECT s.*, p.place, first_value(s.model) OVER w AS best_model, first_value(s.wmape) OVER w AS best_wmape
  FROM scores s LEFT JOIN priors p ON p.segment = s.segment AND p.model = s.model WINDOW w AS (PARTITION BY s.segment, bucket ORDER BY wmape, s.model))
  QUALIFY row_number() OVER (PARTITION BY segment, bucket ORDER BY CASE WHEN wmape <= best_wmape * 1.4::DOUBLE THEN place END NULLS LAST, wmape, model) = 1)"""
_PRIORS = {"smooth": ["AutoETS"], "erratic": ["SeasonalNaive"]}
_TOLERANCE = 0.4


def _chosen(spark: SparkSession, bt: DataFrame, segments: DataFrame) -> DataFrame:
    return backtest.champions(backtest.score_buckets(bt, segments), backtest.priors_table(spark, _PRIORS), _TOLERANCE)


@query(estate.with_views("bt", f"{_SCORES} SELECT * FROM chosen"))
def champion_pick(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    return _chosen(spark, _contest(spark, sf, facts), _segments(spark, sf, facts))


_SHIPPED = f"""{_SCORES}, shipped AS (SELECT r.* FROM rows r JOIN chosen c ON c.segment = r.segment AND c.bucket = r.bucket AND c.model = r.model)"""


def _shipped(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    bt, segments = _contest(spark, sf, facts), _segments(spark, sf, facts)
    return backtest.champion_rows(bt, segments, _chosen(spark, bt, segments))


@query(estate.with_views("bt", f"{_SHIPPED} SELECT segment, bucket, model, count(*) AS n, sum(y) AS y FROM shipped GROUP BY ALL"))
def champion_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shipped(spark, sf)
    return rows.groupBy("segment", "bucket", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


_CALIBRATION = """widths AS (SELECT *, greatest(q10 - y, y - q90) / greatest(mean, 0.05::DOUBLE * greatest(sum(y) OVER (PARTITION BY unique_id) / count(*) OVER (PARTITION BY unique_id), 1e-9::DOUBLE)) AS s FROM {rows}),
both_ AS (SELECT segment, bucket, s, y, q10, q90 FROM widths UNION ALL SELECT 'ALL', bucket, s, y, q10, q90 FROM widths),
ranked AS (SELECT *, row_number() OVER (PARTITION BY segment, bucket ORDER BY s) - 1 AS k, (count(*) OVER (PARTITION BY segment, bucket) - 1) * least(1.0::DOUBLE, 0.8::DOUBLE * (1 + 1.0::DOUBLE / count(*) OVER (PARTITION BY segment, bucket))) AS pos FROM both_),
calibration AS (SELECT segment, bucket, count(*) AS n, min(s) FILTER (k = floor(pos)) + (min(s) FILTER (k = ceil(pos)) - min(s) FILTER (k = floor(pos))) * (min(pos) - floor(min(pos))) AS q,
  CAST(count(*) FILTER (y >= q10 AND y <= q90) AS DOUBLE) / count(*) AS raw_coverage FROM ranked GROUP BY segment, bucket HAVING count(*) >= 30)"""


@query(estate.with_views("bt", f"{_SHIPPED}, {_CALIBRATION.format(rows='shipped')} SELECT * FROM calibration"))
def conformal_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.fit_conformal(_shipped(spark, sf))


@query(
    estate.with_views(
        "bt",
        f"""rows AS (SELECT *, {_SEGMENT} AS segment, {_BUCKET} AS bucket FROM bt WHERE model = 'SeasonalNaive'), {_CALIBRATION.format(rows='rows')}
SELECT r.unique_id, r.origin, r.h, r.mean, least(greatest(r.q10 - c.q * greatest(r.mean, 1e-6::DOUBLE), 0.0::DOUBLE), r.mean) AS q10, greatest(r.q90 + c.q * greatest(r.mean, 1e-6::DOUBLE), r.mean) AS q90
FROM rows r JOIN calibration c ON c.segment = r.segment AND c.bucket = r.bucket""",
    )
)
def conformal_applied(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    bt, segments = _bt(spark, sf, facts).filter("model = 'SeasonalNaive'"), _segments(spark, sf, facts)
    rows = bt.join(segments, "unique_id").withColumn("bucket", backtest.bucket_of(F.col("h")))
    out = backtest.apply_conformal(bt, segments, backtest.fit_conformal(rows))
    return out.select("unique_id", "origin", "h", "mean", "q10", "q90")


@query(
    estate.with_views(
        "panel",
        """scaled AS (SELECT product, month > CAST((SELECT max(month) FROM panel) - INTERVAL 12 MONTH AS DATE) AS recent, units / greatest(sum(units) OVER s / count(*) OVER s, 1e-9::DOUBLE) AS v FROM panel WINDOW s AS (PARTITION BY oem, region, product)),
edges AS (SELECT product, quantile_cont(v, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS q FROM scaled WHERE NOT recent GROUP BY product),
cuts AS (SELECT product, list_distinct([x FOR x IN q IF x > q[1] AND x < q[9]]) AS e FROM edges),
placed AS (SELECT s.product, recent, len([x FOR x IN e IF x <= v]) AS bin FROM scaled s JOIN cuts c ON c.product = s.product),
counts AS (SELECT product, bin, count(*) FILTER (recent) AS c, count(*) FILTER (NOT recent) AS r FROM placed GROUP BY ALL),
shares AS (SELECT product, greatest(CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY product), 1e-4::DOUBLE) AS c, greatest(CAST(r AS DOUBLE) / sum(r) OVER (PARTITION BY product), 1e-4::DOUBLE) AS r FROM counts)
SELECT product, floor(sum((c - r) * ln(c / r)) * 1000000 + 0.5) / 1000000 AS psi, sum((c - r) * ln(c / r)) > 0.25 AS breached FROM shares GROUP BY product""",
    )
)
def psi_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.feature_drift(estate.panel(spark, sf))
    return out.withColumn("psi", F.floor(F.col("psi") * 1000000 + 0.5) / 1000000)


@query(
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY ALL"""
)
def group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = estate.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    low = exact_quantile(rows, ("flag", "status"), "l_quantity", F.lit(0.1), "p10")
    return low.join(exact_quantile(rows, ("flag", "status"), "l_quantity", F.lit(0.5), "median").drop("n"), ["flag", "status"])


@query(
    estate.with_views(
        "bt",
        f"""live AS (SELECT sum(abs(y - naive_units)) / sum(abs(y)) AS live FROM plan WHERE horizon <= 3), back AS (SELECT sum(abs(y - mean)) / sum(abs(y)) AS backtest FROM bt WHERE model = 'Naive')
SELECT live, backtest, live / backtest AS ratio, live / backtest > 1.3 AS breached FROM live, back""".replace("live AS (", f"plan AS ({estate.VIEWS['plan']}), live AS (", 1),
    )
)
def error_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The frozen plan's error on months that came since against the backtest's."""
    from tidecast.functions.metrics import wmape

    facts = estate.facts(spark, sf)
    live = estate.plan(spark, sf, facts).filter("horizon <= 3").agg(wmape(F.col("y"), F.col("naive_units")).alias("live"))
    back = _bt(spark, sf, facts).filter("model = 'Naive'").agg(wmape(F.col("y"), F.col("mean")).alias("backtest"))
    both = live.crossJoin(back)  # a row each
    return both.select("live", "backtest", *drift.error_drift(F.col("live"), F.col("backtest")))
