"""The planning tables, derived from the order tables: the same frames as DataFrames and as SQL, so that queries and oracles share their inputs.

Oem is the market segment, region the region's name, product the part's type; accounts are customers (suppliers, with negative numbers, where goods
came back as end customers'). Units are whole numbers and exact as doubles; money is decimal until it is summed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import to_month
from tidecast.operators import panel as panels
from tidecast.sources.sales_files import drop_partial_month
from tidecast.sources.tables import checkpointed

MONEY = "decimal(12,2)"
#: The last month whose actuals are known when a plan is made, and the month in which mappings change hands.
CYCLE, CHANGE = date(2000, 12, 1), date(1998, 4, 1)
CURRENCY = {"AFRICA": "ZAR", "AMERICA": "USD", "ASIA": "JPY", "EUROPE": "EUR", "MIDDLE EAST": "AED"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their part's product and their order's account, oem, region and currency.

    Lines carry only what is planned on, their revenue already worked out, so that the joins by part and by order move few bytes; places join orders, of which there are fewer."""
    t = lambda n: table(spark, sf, n)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("c_custkey", F.col("c_mktsegment").alias("oem"), F.col("r_name").alias("region"))
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("account_id")).join(places, F.col("account_id") == F.col("c_custkey"))
    parts = t("part").select("p_partkey", F.col("p_type").alias("product"))
    lines = t("lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_suppkey")).alias("end_account_id"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(17,4)").alias("revenue"),
        (F.col("l_linestatus") == "O").alias("is_open"),
    )
    currency = F.coalesce(*(F.when(F.col("region") == r, c) for r, c in CURRENCY.items()))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumns({"month": to_month(F.col("ship_date")), "currency": currency})


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows: ship_date, month, account_id, end_account_id, oem, region, product, units, revenue, currency."""
    return _lines(spark, sf).select("ship_date", "month", "account_id", "end_account_id", "oem", "region", "product", "units", "revenue", "currency")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """month, oem, region, product, currency, wait (months from snapshot to delivery), is_open, units, revenue (decimal), ship_date (the last), n_negative: sums from which series and backlogs are made.

    One pass over the order tables serves all tables of a query: what reads several passes it on. Its rows are as many as months, oems, regions and products allow."""
    # the order's age is folded into one to three months, so that there is a backlog at every month
    wait = (F.col("o_orderkey") % 3 + 1).cast("int").alias("wait")
    by = _lines(spark, sf).groupBy("month", "oem", "region", "product", "currency", wait, "is_open")
    negative = (F.col("units") < 0) | (F.col("revenue") < 0)
    return checkpointed(by.agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.max("ship_date").alias("ship_date"), F.count_if(negative).alias("n_negative")))


def series(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """month, oem, region, product, units, revenue, without the last month, which is incomplete. ``known`` are ``facts`` that are there already, here and below."""
    # a month's last day is past the first if any is, so the facts' last days tell as much as all days
    rows = drop_partial_month(facts(spark, sf) if known is None else known, "ship_date")
    # checkpointed: what is planned on it reads it several times
    return checkpointed(rows.groupBy("month", "oem", "region", "product").agg(F.sum("units").alias("units"), F.sum("revenue").cast("double").alias("revenue")))


def panel(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    return panels.dense(series(spark, sf, known))


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """account_id, oem, region, pct, valid_from, valid_to: of ten customers one has none, two are split, one changes hands; of three suppliers one has one."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    c = table(spark, sf, "customer").join(places, "c_nationkey")
    start, change, never = F.to_date(F.lit("1900-01-01")), F.lit(CHANGE), F.lit(None).cast("date")
    part = lambda oem, pct, lo, hi: F.struct(oem.alias("oem"), F.lit(pct).cast("decimal(5,4)").alias("pct"), lo.alias("valid_from"), hi.alias("valid_to"))
    k, own = F.col("c_custkey") % 10, F.col("c_mktsegment")
    parts = (
        F.when(k == 0, F.array().cast("array<struct<oem: string, pct: decimal(5,4), valid_from: date, valid_to: date>>"))
        .when(k.isin(1, 2), F.array(part(own, "0.7", start, never), part(F.lit("RESALE"), "0.3", start, never)))
        .when(k == 3, F.array(part(own, "1", start, change), part(F.lit("MOVED"), "1", change, never)))
        .otherwise(F.array(part(own, "1", start, never)))
    )
    ours = c.select(F.col("c_custkey").alias("account_id"), "region", F.explode(parts).alias("p")).select("account_id", "p.oem", "region", "p.pct", "p.valid_from", "p.valid_to")
    s = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("c_nationkey")).filter("s_suppkey % 3 = 0 and s_suppkey > 0")
    theirs = s.select((-F.col("s_suppkey")).alias("account_id"), F.concat(F.lit("END-"), (F.col("s_suppkey") % 5).cast("string")).alias("oem"), "region", F.lit("1").cast("decimal(5,4)").alias("pct"), start.alias("valid_from"), never.alias("valid_to"))
    return ours.unionByName(theirs)


def fx(spark: SparkSession, sf: str) -> DataFrame:
    """month, currency, rate (to US dollars), from 1995 to 2002."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(date(1995, 1, 1)), F.lit(date(2002, 12, 1)), F.expr("interval 1 month"))).alias("month"))
    at = (F.year("month") * 12 + F.month("month")) % 7
    rates = F.array(*(F.struct(F.lit(c).alias("currency"), ((F.lit(b) + at * s).cast("decimal(9,4)") / 10000).cast("decimal(9,4)").alias("rate")) for c, b, s in RATES))
    return months.select("month", F.explode(rates).alias("r")).select("month", "r.currency", "r.rate")


#: Currency, rate in ten-thousandths, and what it gains with each step of seven months.
RATES = (("USD", 10000, 0), ("EUR", 11000, 50), ("JPY", 90, 1), ("ZAR", 600, 7), ("AED", 2723, 0))


def backlog(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """snapshot_month, month (of delivery), oem, region, product, units, value: open lines ordered one to three months before they ship."""
    rows = (facts(spark, sf) if known is None else known).filter("is_open")
    by = rows.groupBy(F.add_months("month", -F.col("wait")).alias("snapshot_month"), "month", "oem", "region", "product")
    return checkpointed(by.agg(F.sum("units").alias("units"), F.sum("revenue").cast("double").alias("value")))


def plan(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """A frozen plan: oem, region, product, month, horizon (1 to 6 after the cycle month), ai_units, naive_units, consensus_units, asp, y, overridden, user_id, reason_code.

    The model's forecast is the value of a year before, the sales plan adds a fixed share for some series, the naive forecast is the cycle month's value."""
    p = panel(spark, sf, known)
    lagged = p.select("oem", "region", "product", F.add_months("month", 12).alias("month"), F.col("units").alias("ai_units"), F.col("revenue").alias("ai_revenue"))
    naive = p.filter(F.col("month") == F.lit(CYCLE)).select("oem", "region", "product", F.col("units").alias("naive_units"))
    now = p.select("oem", "region", "product", "month", F.col("units").alias("y"))
    h = ((F.year("month") - CYCLE.year) * 12 + F.month("month") - CYCLE.month).cast("int")
    out = now.withColumn("horizon", h).filter("horizon between 1 and 6").join(lagged, ["oem", "region", "product", "month"]).join(naive, ["oem", "region", "product"])
    rule = (F.length("oem") + F.length("product") + F.col("horizon")) % 3
    more = F.when(rule == 0, F.lit(1.25)).when(rule == 1, F.lit(0.75)).otherwise(F.lit(1.0))
    return out.select(
        "oem",
        "region",
        "product",
        "month",
        "horizon",
        "ai_units",
        "naive_units",
        (F.col("ai_units") * more).alias("consensus_units"),
        F.when(F.col("ai_units") > 0, F.col("ai_revenue") / F.col("ai_units")).otherwise(0.0).alias("asp"),
        "y",
        (rule < 2).alias("overridden"),
        F.when(rule < 2, F.concat(F.lit("rep"), F.length("region").cast("string"))).alias("user_id"),
        F.when(rule == 0, "PROMOTION").when(rule == 1, "LOST_DEAL").alias("reason_code"),
    )


def capacity(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """month, region, product, capacity: the average month's units of a region's product until the cycle, as a whole number, for the six months after it."""
    p = panel(spark, sf, known).filter(F.col("month") <= F.lit(CYCLE)).groupBy("region", "product", "month").agg(F.sum("units").alias("u"))
    mean = p.groupBy("region", "product").agg(F.floor(F.sum("u") / F.count(F.lit(1))).cast("double").alias("capacity"))
    return mean.select("region", "product", "capacity", F.explode(F.sequence(F.add_months(F.lit(CYCLE), 1), F.add_months(F.lit(CYCLE), 6), F.expr("interval 1 month"))).alias("month"))


_CASES = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in CURRENCY.items())
_RATES = ", ".join(f"('{c}', {b}, {s})" for c, b, s in RATES)
_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
_LINES = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""
CYCLE_SQL, CHANGE_SQL = f"DATE '{CYCLE}'", f"DATE '{CHANGE}'"
VIEWS = {
    "sales": f"""SELECT CAST(l_shipdate AS DATE) AS ship_date, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, o_custkey AS account_id,
    CASE WHEN l_returnflag = 'R' THEN -l_suppkey END AS end_account_id, c_mktsegment AS oem, r_name AS region, p_type AS product, l_quantity AS units,
    {_REVENUE} AS revenue, CASE r_name {_CASES} END AS currency FROM {_LINES}""",
    "kept": """SELECT * FROM sales WHERE (SELECT max(ship_date) = last_day(max(ship_date)) OR count(*) FILTER (day(ship_date) <> 1) = 0 FROM sales)
    OR month < (SELECT max(month) FROM sales)""",
    "series": "SELECT month, oem, region, product, sum(units) AS units, CAST(sum(revenue) AS DOUBLE) AS revenue FROM kept GROUP BY ALL",
    "months": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT min(month) AS lo, max(month) AS hi FROM series)",
    "panel": """SELECT k.oem, k.region, k.product, m.month, coalesce(s.units, 0.0::DOUBLE) AS units, coalesce(s.revenue, 0.0::DOUBLE) AS revenue
    FROM (SELECT DISTINCT oem, region, product FROM series) k CROSS JOIN months m LEFT JOIN series s ON s.oem = k.oem AND s.region = k.region AND s.product = k.product AND s.month = m.month""",
    "places": "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "mapping": f"""SELECT c_custkey AS account_id, p.oem AS oem, r_name AS region, CAST(p.pct AS DECIMAL(5,4)) AS pct, p.lo AS valid_from, p.hi AS valid_to
    FROM customer JOIN places ON c_nationkey = n_nationkey, (VALUES (1, 'RESALE', 0.3, DATE '1900-01-01', CAST(NULL AS DATE)), (1, '', 0.7, DATE '1900-01-01', NULL),
      (2, '', 1, DATE '1900-01-01', {CHANGE_SQL}), (2, 'MOVED', 1, {CHANGE_SQL}, NULL), (3, '', 1, DATE '1900-01-01', NULL)) q(kind, name, pct, lo, hi),
      LATERAL (SELECT CASE WHEN q.name = '' THEN c_mktsegment ELSE q.name END AS oem, q.pct AS pct, q.lo AS lo, q.hi AS hi) p
    WHERE q.kind = CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 10 IN (1, 2) THEN 1 WHEN c_custkey % 10 = 3 THEN 2 ELSE 3 END
    UNION ALL SELECT -s_suppkey, 'END-' || (s_suppkey % 5), r_name, CAST(1 AS DECIMAL(5,4)), DATE '1900-01-01', NULL
    FROM supplier JOIN places ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0 AND s_suppkey > 0""",
    "fx": f"""SELECT month, c AS currency, CAST(CAST(b + (year(month) * 12 + month(month)) % 7 * s AS DECIMAL(9,4)) / 10000 AS DECIMAL(9,4)) AS rate
    FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) CROSS JOIN (VALUES {_RATES}) r(c, b, s)""",
    "source": "SELECT row_number() OVER (ORDER BY month, account_id, end_account_id, product) AS rid, * FROM (SELECT month, account_id, end_account_id, product, currency, sum(CAST(units AS DECIMAL(18,2))) AS units, sum(revenue) AS revenue FROM sales GROUP BY ALL)",
    "mapped": """SELECT s.* EXCLUDE (units, revenue), coalesce(g.oem, 'UNMAPPED') AS oem, coalesce(g.region, 'UNK') AS region, coalesce(g.pct, 1) AS pct, s.units * coalesce(g.pct, 1) AS units, s.revenue * coalesce(g.pct, 1) AS revenue
    FROM source s LEFT JOIN (SELECT rid, m.oem, m.region, m.pct FROM source s JOIN mapping m ON s.end_account_id = m.account_id AND m.valid_from <= s.month AND (m.valid_to IS NULL OR s.month < m.valid_to)
      UNION ALL SELECT rid, m.oem, m.region, m.pct FROM source s JOIN mapping m ON s.account_id = m.account_id AND m.valid_from <= s.month AND (m.valid_to IS NULL OR s.month < m.valid_to)
        WHERE NOT EXISTS (SELECT 1 FROM mapping e WHERE s.end_account_id = e.account_id AND e.valid_from <= s.month AND (e.valid_to IS NULL OR s.month < e.valid_to))) g ON g.rid = s.rid""",
    "backlog": f"""SELECT CAST(date_trunc('month', l_shipdate) - to_months(CAST(o_orderkey % 3 + 1 AS INTEGER)) AS DATE) AS snapshot_month, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    c_mktsegment AS oem, r_name AS region, p_type AS product, sum(l_quantity) AS units, CAST(sum({_REVENUE}) AS DOUBLE) AS value FROM {_LINES} WHERE l_linestatus = 'O' GROUP BY ALL""",
    "plan": f"""SELECT * EXCLUDE (rule, ai_revenue), ai_units * CASE rule WHEN 0 THEN 1.25::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS consensus_units,
    CASE WHEN ai_units > 0 THEN ai_revenue / ai_units ELSE 0.0::DOUBLE END AS asp, rule < 2 AS overridden,
    CASE WHEN rule < 2 THEN 'rep' || length(region) END AS user_id, CASE rule WHEN 0 THEN 'PROMOTION' WHEN 1 THEN 'LOST_DEAL' END AS reason_code
    FROM (SELECT *, (length(oem) + length(product) + horizon) % 3 AS rule FROM (SELECT a.oem, a.region, a.product, a.month, CAST(datediff('month', {CYCLE_SQL}, a.month) AS INTEGER) AS horizon, b.units AS ai_units, b.revenue AS ai_revenue,
      c.units AS naive_units, a.units AS y FROM panel a JOIN panel b ON a.oem = b.oem AND a.region = b.region AND a.product = b.product AND a.month = CAST(b.month + INTERVAL 12 MONTH AS DATE)
      JOIN panel c ON a.oem = c.oem AND a.region = c.region AND a.product = c.product AND c.month = {CYCLE_SQL}) WHERE horizon BETWEEN 1 AND 6)""",
    "steps": """SELECT *, count(*) OVER (PARTITION BY unique_id) AS n, coalesce(sum(abs(d12)) OVER w / count(d12) OVER w, 0) AS far, sum(abs(d1)) OVER w / count(d1) OVER w AS near,
      sqrt(sum(d1 * d1) OVER w / count(d1) OVER w) AS s1, sqrt(sum(d12 * d12) OVER w / count(d12) OVER w) AS s12
    FROM (SELECT oem || '|' || region || '|' || product AS unique_id, month AS ds, units AS y, row_number() OVER p AS t, units - lag(units) OVER p AS d1, units - lag(units, 12) OVER p AS d12
      FROM panel WINDOW p AS (PARTITION BY oem, region, product ORDER BY month)) WINDOW w AS (PARTITION BY unique_id ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "bt": """SELECT model, unique_id, origin, h, ds, y, mean, least(greatest(mean - 1.2815515655446004::DOUBLE * s, 0.0::DOUBLE), mean) AS q10, mean AS q50, greatest(mean + 1.2815515655446004::DOUBLE * s, mean) AS q90, scale
    FROM (SELECT 'Naive' AS model, a.unique_id, o.ds AS origin, CAST(a.t - o.t AS INTEGER) AS h, a.ds, a.y, o.y AS mean, o.s1 * sqrt(CAST(a.t - o.t AS DOUBLE)) AS s, o.far AS scale
      FROM steps o JOIN steps a ON a.unique_id = o.unique_id AND a.t > o.t AND a.t <= o.t + 12 WHERE o.t >= 18 AND (o.t - 18) % 3 = 0
      UNION ALL SELECT 'SeasonalNaive', a.unique_id, o.ds, CAST(a.t - o.t AS INTEGER), a.ds, a.y, l.y, o.s12, o.far
      FROM steps o JOIN steps a ON a.unique_id = o.unique_id AND a.t > o.t AND a.t <= o.t + 12 JOIN steps l ON l.unique_id = a.unique_id AND l.t = a.t - 12 WHERE o.t >= 18 AND (o.t - 18) % 3 = 0)""",
    "capacity": f"""SELECT m.month, region, product, capacity FROM (SELECT region, product, floor(sum(u) / count(*)) AS capacity FROM
      (SELECT region, product, month, sum(units) AS u FROM panel WHERE month <= {CYCLE_SQL} GROUP BY ALL) GROUP BY ALL)
    CROSS JOIN (SELECT CAST(unnest(generate_series(CAST({CYCLE_SQL} + INTERVAL 1 MONTH AS DATE), CAST({CYCLE_SQL} + INTERVAL 6 MONTH AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month) m""",
}
#: What each view reads of the others.
_USES = {"kept": ("sales",), "series": ("kept",), "months": ("series",), "panel": ("series", "months"), "mapping": ("places",), "plan": ("panel",), "capacity": ("panel",), "source": ("sales",), "mapped": ("source", "mapping"), "steps": ("panel",), "bt": ("steps",)}


def with_views(names: str, body: str) -> str:
    """``body`` after the views it reads, and those that they read."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _USES.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}{',' if not body.upper().startswith('SELECT') else ''}\n{body}"
