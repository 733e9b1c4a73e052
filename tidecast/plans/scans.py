"""Queries on reading, cleaning and rolling up sales."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import to_month
from tidecast.functions.metrics import exact_sum
from tidecast.functions.text import normalize_name
from tidecast.operators import hierarchy, panel, windows
from tidecast.plans import estate
from tidecast.plans.registry import query
from tidecast.sources import sales_files, tables

_LEVEL = """CASE grouping(oem) * 4 + grouping(region) * 2 + grouping(product) WHEN 7 THEN 'TOTAL' WHEN 5 THEN 'REGION' WHEN 3 THEN 'OEM' WHEN 6 THEN 'PRODUCT' WHEN 1 THEN 'OEM_REGION' ELSE 'BOTTOM' END AS level,
  CASE WHEN grouping(oem) = 1 THEN 'ALL' ELSE oem END AS oem, CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, CASE WHEN grouping(product) = 1 THEN 'ALL' ELSE product END AS product"""
_SETS = lambda *keys: ", ".join(f"({', '.join([*d, *keys])})" for d in hierarchy.LEVELS.values())


@query(
    estate.with_views(
        "kept",
        f"SELECT {_LEVEL}, month, sum(units) AS units, CAST(sum(revenue) AS DOUBLE) AS revenue FROM kept GROUP BY GROUPING SETS ({_SETS('month')})",
    )
)
def canonical_month_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = sales_files.drop_partial_month(estate.sales(spark, sf), "ship_date")
    return hierarchy.rollup(rows, {"units": F.sum("units"), "revenue": exact_sum(F.col("revenue"))})


@query(estate.with_views("kept", "SELECT month, count(*) AS n_rows, sum(units) AS units FROM kept GROUP BY month"))
def drop_partial_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = sales_files.drop_partial_month(estate.sales(spark, sf), "ship_date")
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("units").alias("units"))


@query(
    estate.with_views(
        "series",
        """SELECT oem, region, product, year(month) AS year, 'm' || lpad(CAST(month(month) AS VARCHAR), 2, '0') AS col, sum(units) AS units FROM series GROUP BY ALL""",
    )
)
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    """A table with a column for each month of the year, and back to rows."""
    cols = [f"m{m:02d}" for m in range(1, 13)]
    s = estate.series(spark, sf).select("oem", "region", "product", F.year("month").cast("long").alias("year"), F.date_format("month", "'m'MM").alias("m"), "units")
    wide = s.groupBy("oem", "region", "product", "year").pivot("m", cols).agg(F.sum("units"))
    return wide.unpivot(["oem", "region", "product", "year"], cols, "col", "units").filter("units is not null")


@query(
    estate.with_views(
        "kept",
        """each AS (SELECT count(*) - 1 AS more FROM kept GROUP BY month, account_id, product, region, oem)
SELECT count(*) AS n_rows, count(DISTINCT month) AS n_months, min(month) AS first_month, max(month) AS last_month, count(DISTINCT account_id) AS customers, count(DISTINCT oem) AS oems,
  count(DISTINCT region) AS regions, count(DISTINCT product) AS products, count(DISTINCT oem || '|' || region || '|' || product) AS n_series, sum(units) AS units_total, CAST(sum(revenue) AS DOUBLE) AS revenue_total,
  CAST(count(*) FILTER (revenue <= 0) AS DOUBLE) / count(*) AS share_without_revenue, CAST((SELECT sum(more) FROM each) AS BIGINT) AS duplicates FROM kept""",
    )
)
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"month": "ship_date", "customer": "account_id", "product": "product", "units": "units", "revenue": "revenue", "region": "region", "oem": "oem"}
    return sales_files.summarize_sales(sales_files.canonical_sales(estate.sales(spark, sf), columns))


@query(
    """SELECT 'error' AS level, 'unreadable date' AS issue, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'warn', 'units are no number', count(*) FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'warn', 'negative units', count(*) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0"""
)
def import_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose dates and units are spoiled by rule, and what cleaning says of them."""
    k = F.col("o_orderkey")
    raw = estate.table(spark, sf, "orders").select(
        F.when(k % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.col("o_custkey").cast("string").alias("Client"),
        F.col("o_orderpriority").alias("SKU"),
        F.when(k % 11 == 0, "many").when(k % 13 == 0, "-2").otherwise("3").alias("Qty"),
        F.col("o_totalprice").cast("string").alias("Amount"),
    )
    return sales_files.sales_issues(raw, sales_files.suggest_columns("sales", raw.columns))


@query(estate.with_views("series", "SELECT month, oem, region, product, units FROM series ORDER BY month DESC, oem, region, product LIMIT 50 OFFSET 50"))
def preview_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = estate.series(spark, sf).select("month", "oem", "region", "product", "units")
    return sales_files.preview(rows, 1, 50, F.col("month").desc(), F.col("oem"), F.col("region"), F.col("product"))


@query(estate.with_views("series", "SELECT oem, product, sum(units) AS units, count(DISTINCT region) AS regions, min(month) AS first_month, max(month) AS last_month FROM series GROUP BY oem, product ORDER BY units DESC, oem, product LIMIT 15"))
def overview_top(spark: SparkSession, sf: str) -> DataFrame:
    s = estate.series(spark, sf).groupBy("oem", "product")
    s = s.agg(F.sum("units").alias("units"), F.count_distinct("region").alias("regions"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return s.orderBy(F.col("units").desc(), "oem", "product").limit(15)


@query(
    """SELECT p_brand AS brand, min(p_type) AS family FROM
  (SELECT p_brand, p_type, n, max(n) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE n = top GROUP BY p_brand"""
)
def product_family(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest family of each product, the first by name of equals."""
    return estate.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.expr("mode() WITHIN GROUP (ORDER BY p_type)").alias("family"))


@query(
    estate.with_views(
        "series",
        """SELECT region, oem, u AS units, u / sum(u) OVER (PARTITION BY region) AS pct FROM (SELECT region, oem, sum(units) AS u FROM series GROUP BY ALL)""",
    )
)
def region_share(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = estate.series(spark, sf).groupBy("region", "oem").agg(F.sum("units").alias("units"))
    return s.withColumn("pct", F.col("units") / F.sum("units").over(Window.partitionBy("region")))


@query(
    estate.with_views(
        "series backlog",
        """SELECT 'backlog' AS name, count(*) AS n_rows, min(month) AS first_month, max(month) AS last_month FROM backlog
UNION ALL SELECT 'capacity', 0, NULL, NULL UNION ALL SELECT 'series', count(*), min(month), max(month) FROM series""",
    )
)
def capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """What each table holds; features whose table is empty are off."""
    facts = estate.facts(spark, sf)
    series, out = estate.series(spark, sf, facts), None
    for name, df in (("series", series), ("backlog", estate.backlog(spark, sf, facts)), ("capacity", series.filter("false"))):
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(estate.with_views("panel", "SELECT oem, region, product, month, units, revenue FROM panel"))
def dense_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.dense(estate.series(spark, sf))


@query(
    estate.with_views(
        "panel",
        f"SELECT {_LEVEL}, month, sum(units) AS units FROM panel GROUP BY GROUPING SETS ({_SETS('month')})",
    )
)
def hierarchy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.rollup(estate.panel(spark, sf), {"units": F.sum("units")})


@query(
    estate.with_views(
        "series",
        """leaves AS (SELECT DISTINCT oem, region, product FROM series)
SELECT 'ALL|ALL|ALL' AS node, count(*) AS leaves FROM leaves UNION ALL SELECT 'ALL|' || region || '|ALL', count(*) FROM leaves GROUP BY region
UNION ALL SELECT oem || '|ALL|ALL', count(*) FROM leaves GROUP BY oem UNION ALL SELECT 'ALL|ALL|' || product, count(*) FROM leaves GROUP BY product
UNION ALL SELECT oem || '|' || region || '|ALL', count(*) FROM leaves GROUP BY oem, region UNION ALL SELECT oem || '|' || region || '|' || product, count(*) FROM leaves GROUP BY ALL""",
    )
)
def hierarchy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.edges(estate.series(spark, sf)).groupBy("node").agg(F.count("leaf").alias("leaves"))


@query(
    """WITH l AS (SELECT 'S' || l_suppkey % 7 AS store, 'ST' || l_suppkey % 7 % 3 AS state, l_returnflag || l_linestatus AS item, l_returnflag AS cat, CAST(l_quantity AS BIGINT) AS q, floor(l_extendedprice) AS price,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 70 AS k FROM lineitem),
p AS (SELECT store, item, k // 7 AS week, max(price) AS price FROM l WHERE k // 7 % 4 <> 3 GROUP BY 1, 2, 3)
SELECT CAST(date_trunc('month', DATE '1992-01-01' + CAST(k AS INTEGER)) AS DATE) AS month, l.store AS customer, state AS region, l.item AS product, cat AS family, l.store AS oem, sum(q) AS units, sum(q * coalesce(p.price, 0)) AS revenue
FROM l LEFT JOIN p ON p.store = l.store AND p.item = l.item AND p.week = k // 7 WHERE k < 60 GROUP BY ALL"""
)
def daily_wide_import(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a table with a column for each of 70 days (all dates folded into them), with a calendar and weekly prices, some missing; the last month is incomplete."""
    days, s = 70, F.col("l_suppkey") % 7
    day = F.pmod(F.datediff("l_shipdate", F.lit("1992-01-01")), F.lit(days))
    l = estate.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), s).alias("store_id"), F.concat(F.lit("ST"), s % 3).alias("state_id"), F.concat("l_returnflag", "l_linestatus").alias("item_id"), F.col("l_returnflag").alias("cat_id"),
        F.col("l_quantity").cast("long").alias("q"), F.floor("l_extendedprice").cast("double").alias("price"), day.alias("k"), F.concat(F.lit("d_"), day + 1).alias("d"),
    )
    ids = ("store_id", "state_id", "item_id", "cat_id")
    wide = l.groupBy(*ids).pivot("d", [f"d_{i}" for i in range(1, days + 1)]).agg(F.sum("q"))
    calendar = spark.range(days).select(F.concat(F.lit("d_"), F.col("id") + 1).alias("d"), F.expr("date_add(date'1992-01-01', int(id))").alias("date"), F.floor(F.col("id") / 7).alias("wm_yr_wk"))
    prices = l.groupBy("store_id", "item_id", F.floor(F.col("k") / 7).alias("wm_yr_wk")).agg(F.max("price").alias("sell_price")).filter("wm_yr_wk % 4 <> 3")
    return sales_files.wide_to_long(wide, calendar, prices, ids, "item_id").filter("units is not null")


@query(
    """SELECT n_nationkey AS file, [chr(9), ';', '|', ','][n_nationkey % 4 + 1] AS delimiter, CASE WHEN n_nationkey % 2 = 0 THEN '"' ELSE chr(39) END AS quote, 3 AS fields, 1.0::DOUBLE AS share
FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)"""
)
def file_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as lines of text, a file for each nation with a delimiter and quote of its own; the quoted names hold the delimiter, and balances have decimal commas where commas do not divide."""
    k = F.col("c_nationkey") % 4
    d = F.element_at(F.array(*map(F.lit, "\t;|,")), (k + 1).cast("int"))
    q = F.when(F.col("c_nationkey") % 2 == 0, '"').otherwise("'")
    balance = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    line = F.concat(F.col("c_custkey").cast("string"), d, q, "c_name", d, F.lit("Ltd"), q, d, F.when(k == 3, balance).otherwise(F.replace(balance, F.lit("."), F.lit(","))))
    return sales_files.dialects(estate.table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), line.alias("line")))


@query("SELECT DISTINCT p_name || ' ﬁne Ⅷ' AS given, p_name || ' fine viii' AS name FROM part")
def accented_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with marks on their letters, a ligature, a numeral and a legal form, cleaned."""
    name = F.concat(F.translate("p_name", "aeioucns", "áêïòůçňş"), F.lit(" ﬁne Ⅷ ＧｍｂＨ"))
    return estate.table(spark, sf, "part").select(F.concat("p_name", F.lit(" ﬁne Ⅷ")).alias("given"), normalize_name(name).alias("name")).distinct()


@query(
    """WITH v AS (SELECT DISTINCT c_mktsegment || ['!', ' ', '?'][c_custkey % 3 + 1] || c_nationkey AS name FROM customer),
n AS (SELECT name, upper(regexp_replace(name, '[^A-Za-z0-9]', '_')) AS base, row_number() OVER (PARTITION BY regexp_replace(name, '[^A-Za-z0-9]', '_') ORDER BY name) AS n FROM v)
SELECT name, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS code FROM n"""
)
def stable_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of customers' segments and nations, written in three ways each."""
    mark = F.element_at(F.array(*map(F.lit, "! ?")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return sales_files.stable_codes(estate.table(spark, sf, "customer").select(F.concat("c_mktsegment", mark, F.col("c_nationkey").cast("string")).alias("name")), "name", 20)


@query(
    """SELECT o_orderpriority AS run_id, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE o_custkey END AS account_id FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT '9-NEW', o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2%'"""
)
def replaced_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a table with a partition for each priority: one run is replaced, another appended, and chosen columns of rows with one status are read."""
    path = f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = estate.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_id"), "o_orderkey", F.col("o_custkey").alias("account_id"), "o_orderstatus", "o_totalprice")
    tables.replace(rows, path, ("run_id",))
    tables.replace(rows.filter("run_id like '1%'").withColumn("account_id", F.lit(-1).cast("long")), path, ("run_id",))
    tables.append(rows.filter("run_id like '2%'").withColumn("run_id", F.lit("9-NEW")), path, ("run_id",))
    return tables.read(spark, path, ["run_id", "o_orderkey", "account_id"], "o_orderstatus = 'F'")


@query(
    "SELECT (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS h, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
)
def horizon_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by the months from the order's to the shipment's."""
    rows = estate.table(spark, sf, "lineitem").join(estate.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(windows.horizon_of(to_month(F.col("l_shipdate")), to_month(F.col("o_orderdate"))).alias("h")).agg(F.count(F.lit(1)).alias("n"))
