"""Queries on panels and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.operators import hierarchy, panel, segments, windows
from tidecast.plans import estate
from tidecast.plans.registry import query
from tidecast.sources.tables import checkpointed

KEYS = ("oem", "region", "product")


@query(
    estate.with_views(
        "panel",
        """holes AS (SELECT *, CASE WHEN units > 0 AND (month(month) + length(product)) % 9 <> 0 THEN revenue / units END AS asp FROM panel),
back AS (SELECT *, last_value(asp IGNORE NULLS) OVER (PARTITION BY oem, region, product ORDER BY month ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS b FROM holes)
SELECT oem, region, product, month, first_value(b IGNORE NULLS) OVER (PARTITION BY oem, region, product ORDER BY month ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS asp FROM back""",
    )
)
def bounded_fill(spark: SparkSession, sf: str) -> DataFrame:
    p = estate.panel(spark, sf)
    asp = F.when((F.col("units") > 0) & ((F.month("month") + F.length("product")) % 9 != 0), F.col("revenue") / F.col("units"))
    return windows.bounded_fill(p.select(*KEYS, "month", asp.alias("asp")), "asp", KEYS)


@query(
    estate.with_views(
        "panel",
        """last AS (SELECT oem, region, product, max_by(units, month) AS u FROM panel GROUP BY ALL), target AS (SELECT oem, region, product, CAST(month + INTERVAL 6 MONTH AS DATE) AS month FROM panel)
SELECT t.*, coalesce(p.units, l.u, 0.0::DOUBLE) AS naive FROM target t LEFT JOIN panel p ON p.oem = t.oem AND p.region = t.region AND p.product = t.product AND CAST(p.month + INTERVAL 12 MONTH AS DATE) = t.month
LEFT JOIN last l ON l.oem = t.oem AND l.region = t.region AND l.product = t.product""",
    )
)
def lag12_naive(spark: SparkSession, sf: str) -> DataFrame:
    p = estate.panel(spark, sf)
    return windows.seasonal_naive(p.select(*KEYS, "month", "units"), p.select(*KEYS, F.add_months("month", 6).alias("month")), KEYS)


_SPREAD = "sqrt(greatest(count(*) OVER {w} * sum(units * units) OVER {w} - sum(units) OVER {w} * sum(units) OVER {w}, 0.0::DOUBLE)) / count(*) OVER {w} / scale AS {n}"


@query(
    estate.with_views(
        "panel",
        f"""base AS (SELECT *, row_number() OVER o AS t, CASE WHEN sum(units) OVER w / count(*) OVER w > 1e-9 THEN sum(units) OVER w / count(*) OVER w ELSE 1.0::DOUBLE END AS scale, sum(units) OVER a / count(*) OVER a AS hist
  FROM panel WINDOW o AS (PARTITION BY oem, region, product ORDER BY month), w AS (PARTITION BY oem, region, product ORDER BY month ROWS 11 PRECEDING), a AS (PARTITION BY oem, region, product ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT oem, region, product, month, scale, units / scale AS lag0, {', '.join(f'lag(units, {k}) OVER o / scale AS lag{k}' for k in range(1, 12))},
  sum(units) OVER w3 / count(*) OVER w3 / scale AS mean3, sum(units) OVER w6 / count(*) OVER w6 / scale AS mean6, {_SPREAD.format(w='w6', n='sd6')}, {_SPREAD.format(w='w', n='sd12')},
  sum(CASE WHEN units <= 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w / count(*) OVER w AS zero_share,
  CASE WHEN count(*) OVER w > 2 THEN (count(*) OVER w * sum(t * units) OVER w - sum(t::DOUBLE) OVER w * sum(units) OVER w) / (count(*) OVER w * sum(t::DOUBLE * t) OVER w - sum(t::DOUBLE) OVER w * sum(t::DOUBLE) OVER w) ELSE 0.0::DOUBLE END / scale AS slope,
  max(units) OVER w / scale AS max12, min(units) OVER w / scale AS min12, scale / greatest(hist, 1e-9::DOUBLE) AS hist_ratio
FROM base WINDOW o AS (PARTITION BY oem, region, product ORDER BY month), w AS (PARTITION BY oem, region, product ORDER BY month ROWS 11 PRECEDING),
  w3 AS (PARTITION BY oem, region, product ORDER BY month ROWS 2 PRECEDING), w6 AS (PARTITION BY oem, region, product ORDER BY month ROWS 5 PRECEDING)""",
    )
)
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rolling_features(estate.panel(spark, sf), KEYS).drop("log_scale")  # a logarithm's last digit depends on the library


@query(
    estate.with_views(
        "panel",
        """d AS (SELECT *, units - sum(units) OVER k / count(*) OVER k AS d FROM panel WINDOW k AS (PARTITION BY oem, region, product)),
l AS (SELECT *, lag(d, 12) OVER (PARTITION BY oem, region, product ORDER BY month) AS l FROM d)
SELECT oem, region, product, floor(sum(d * l) / sum(d * d) * 1000000 + 0.5) / 1000000 AS acf FROM l GROUP BY ALL""",
    )
)
def acf12(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.acf(estate.panel(spark, sf), KEYS)
    return out.select(*KEYS, (F.floor(F.col("acf") * 1000000 + 0.5) / 1000000).alias("acf"))


@query(
    estate.with_views(
        "panel",
        """stats AS (SELECT oem, region, product, count(*) AS n_obs, CAST(count(*) AS DOUBLE) / nullif(count(*) FILTER (units > 0), 0) AS adi,
  CASE WHEN count(*) FILTER (units > 0) > 1 THEN (count(*) FILTER (units > 0) * sum(units * units) - sum(units) * sum(units)) / (sum(units) * sum(units)) WHEN count(*) FILTER (units > 0) = 1 THEN 0.0::DOUBLE END AS cv2 FROM panel GROUP BY ALL)
SELECT *, CASE WHEN (adi IS NULL OR adi >= 1.32) AND (cv2 IS NULL OR cv2 >= 0.49) THEN 'lumpy' WHEN adi IS NULL OR adi >= 1.32 THEN 'intermittent' WHEN cv2 IS NULL OR cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS segment FROM stats""",
    )
)
def adi_cv2_segment(spark: SparkSession, sf: str) -> DataFrame:
    stats = segments.adi_cv2(estate.panel(spark, sf), KEYS)
    none = F.lit(None).cast("double")
    return stats.withColumn("segment", segments.classify(F.col("adi"), F.col("cv2"), F.lit(0.0), none, F.lit(0.0), F.col("n_obs")))


@query(
    estate.with_views(
        "panel",
        """SELECT oem, region, product, month, coalesce(sum(units) OVER (PARTITION BY oem, region, product ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS units_before FROM panel""",
    )
)
def strict_prior_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.strictly_before(estate.panel(spark, sf), ("units",), KEYS).select(*KEYS, "month", "units_before")


@query(
    estate.with_views(
        "panel",
        """d AS (SELECT *, units - lag(units) OVER o AS dy, revenue - lag(revenue) OVER o AS dx FROM panel WINDOW o AS (PARTITION BY oem, region, product ORDER BY month)),
l AS (SELECT *, lag(dx) OVER o AS dx1, lag(dx, 2) OVER o AS dx2 FROM d WINDOW o AS (PARTITION BY oem, region, product ORDER BY month))
SELECT oem, region, product, floor(greatest(abs(corr(dy, dx)), abs(corr(dy, dx1)), abs(corr(dy, dx2))) * 10000 + 0.5) / 10000 AS exog FROM l GROUP BY ALL""",
    )
)
def driver_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of units against changes of revenue, at most two months before."""
    out = windows.driver_correlation(estate.panel(spark, sf), ("revenue",), KEYS)
    return out.select(*KEYS, (F.floor(F.col("exog") * 10000 + 0.5) / 10000).alias("exog"))


@query(
    estate.with_views(
        "panel",
        """l AS (SELECT *, abs(units - lag(units, 12) OVER (PARTITION BY oem, region, product ORDER BY month)) AS d FROM panel)
SELECT oem, region, product, sum(d) / count(d) AS scale FROM l GROUP BY ALL""",
    )
)
def mase_scales(spark: SparkSession, sf: str) -> DataFrame:
    return windows.mase_scale(estate.panel(spark, sf), KEYS, "units", "month")


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    e = estate.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return windows.latest(e, ("user_id",), F.col("ts").desc(), F.col("event_id").desc()).drop("ts")


@query(estate.with_views("panel", "SELECT oem || '|' || region || '|' || product AS unique_id, month AS ds, units AS y FROM panel"))
def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.long(estate.panel(spark, sf))


@query(
    estate.with_views(
        "panel",
        """SELECT oem, region, product, month, units, CAST(row_number() OVER (PARTITION BY oem, region, product ORDER BY month) AS BIGINT) AS h FROM panel WHERE oem = 'MACHINERY' AND product = 'SMALL'""",
    )
)
def node_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = hierarchy.at_node(estate.panel(spark, sf), oem="MACHINERY", product="SMALL")
    return rows.select(*KEYS, "month", "units", F.row_number().over(Window.partitionBy(*KEYS).orderBy("month")).cast("long").alias("h"))


@query()
def segment_series(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment(estate.panel(spark, sf), KEYS, ("revenue",))


@query()
def panel_hash(spark: SparkSession, sf: str) -> DataFrame:
    return panel.data_hash(estate.panel(spark, sf))


@query(
    estate.with_views(
        "panel",
        """l AS (SELECT oem, region, product, month, units, lag(units, 12) OVER w AS lag12, lag(units, 24) OVER w AS lag24, CAST(datediff('month', min(month) OVER (PARTITION BY oem, region, product), month) AS INTEGER) AS h FROM panel WINDOW w AS (PARTITION BY oem, region, product ORDER BY month))
SELECT * FROM l""",
    )
)
def seasonal_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The values of one and two years before, and how many months each row is after its series' first."""
    w = Window.partitionBy(*KEYS)
    p = estate.panel(spark, sf).withColumn("_first", F.min("month").over(w))
    lags = {f"lag{n}": F.lag("units", n).over(w.orderBy("month")) for n in (12, 24)}
    return p.withColumns(lags).select(*KEYS, "month", "units", *lags, windows.horizon_of(F.col("month"), F.col("_first")).cast("int").alias("h"))


@query(
    estate.with_views(
        "panel",
        "SELECT oem, region, product, month, greatest(units - 50, 0.0::DOUBLE) AS q10, greatest(units - 50, 80 - units, 0.0::DOUBLE) AS q50, greatest(units - 50, 80 - units, units - 20, 0.0::DOUBLE) AS q90 FROM panel",
    )
)
def monotone_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Crossing quantiles made to rise."""
    u = F.col("units")
    p = estate.panel(spark, sf).select(*KEYS, "month", (u - 50).alias("q10"), (80 - u).alias("q50"), (u - 20).alias("q90"))
    return windows.monotone(p, ("q10", "q50", "q90"))


@query(estate.with_views("panel", "SELECT CASE WHEN count(*) > 0 THEN 7.0::DOUBLE END AS error FROM panel"))
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest incoherence of nodes of which one kind was made greater by 7."""
    nodes = checkpointed(hierarchy.rollup(estate.panel(spark, sf), {"units": F.sum("units")}))
    return hierarchy.coherence_error(nodes.withColumn("units", F.col("units") + F.when(F.col("level") == "REGION", 7.0).otherwise(0.0)), "units")


@query(
    estate.with_views(
        "panel",
        """s AS (SELECT oem, region, product, count(*) AS n_obs, count(*)::DOUBLE / nullif(count(*) FILTER (units > 0), 0) AS adi, count(*) FILTER (units > 0) AS k, sum(units) FILTER (units > 0) AS s, sum(units * units) FILTER (units > 0) AS q FROM panel GROUP BY ALL),
v AS (SELECT *, CASE WHEN k > 1 THEN (k * q - s * s) / (s * s) WHEN k = 1 THEN 0.0::DOUBLE END AS cv2, (length(oem) % 3 = 0)::INT * 0.8::DOUBLE AS strength, (length(region) % 4 = 0)::INT * 0.6::DOUBLE AS exog FROM s),
w AS (SELECT *, adi IS NULL OR adi >= 1.32::DOUBLE AS rare, cv2 IS NULL OR cv2 >= 0.49::DOUBLE AS wild FROM v)
SELECT oem, region, product, CASE WHEN rare AND wild THEN 'lumpy' WHEN rare THEN 'intermittent' WHEN exog >= 0.55 THEN 'complex' WHEN n_obs >= 30 AND strength >= 0.7 THEN 'seasonal' WHEN wild THEN 'erratic' ELSE 'smooth' END AS segment FROM w""",
    )
)
def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Segments by measured intervals and spreads and given strengths of season and drivers."""
    stats = segments.adi_cv2(estate.panel(spark, sf), KEYS)
    strength, exog = F.when(F.length("oem") % 3 == 0, 0.8).otherwise(0.0), F.when(F.length("region") % 4 == 0, 0.6).otherwise(0.0)
    return stats.select(*KEYS, segments.classify(F.col("adi"), F.col("cv2"), strength, F.lit(None).cast("double"), exog, F.col("n_obs")).alias("segment"))
