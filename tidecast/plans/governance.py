"""Queries on overrides, consensus, value added and the audit chain."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import governance, hierarchy
from tidecast.plans import estate
from tidecast.plans.registry import query


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    """One override for each order: of a segment, region and month of the plan by the order's key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    places = estate.table(spark, sf, "customer").join(estate.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(estate.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = estate.table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    month = F.add_months(F.lit(estate.CYCLE), (F.floor(k / 50) % 6 + 1).cast("int"))
    return rows.select(
        k.alias("override_id"), F.col("c_mktsegment").alias("oem"), F.col("r_name").alias("region"), F.lit("ALL").alias("product"), month.alias("month"), (c % 500 + 100).cast("double").alias("override_units"),
        F.lit("PROMOTION").alias("reason_code"), F.concat(F.lit("u"), (c % 7).cast("string")).alias("user_id"),
    )


_OVERRIDES = f"""ovs AS (SELECT o_orderkey AS override_id, c_mktsegment AS oem, r_name AS region, 'ALL' AS product, CAST({estate.CYCLE_SQL} + to_months(CAST(o_orderkey // 50 % 6 + 1 AS INTEGER)) AS DATE) AS month, CAST(o_custkey % 500 + 100 AS DOUBLE) AS override_units,
  'PROMOTION' AS reason_code, 'u' || (o_custkey % 7) AS user_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
revised AS (SELECT *, row_number() OVER w AS revision, lag(override_id) OVER w AS supersedes, CASE WHEN override_id = max(override_id) OVER (PARTITION BY oem, region, product, month) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM ovs WINDOW w AS (PARTITION BY oem, region, product, month ORDER BY override_id))"""


@query(f"WITH {_OVERRIDES} SELECT override_id, oem, region, month, revision, supersedes, status FROM revised")
def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    return governance.revisions(_overrides(spark, sf)).select("override_id", "oem", "region", "month", "revision", "supersedes", "status")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("override_id")
    return _overrides(spark, sf).select("override_id", k.alias("event_id"), F.when(k % 3 != 0, "NOTE").when(F.col("override_id") % 4 == 0, "WITHDRAW").when(F.col("override_id") % 4 == 2, "REJECT").otherwise("APPROVE").alias("action"))


@query(
    f"""WITH {_OVERRIDES} SELECT override_id, revision, CASE WHEN status = 'ACTIVE' AND override_id % 12 = 0 THEN 'WITHDRAWN' ELSE status END AS status,
  CASE WHEN override_id % 3 = 0 AND override_id % 4 = 2 THEN 'REJECTED' WHEN override_id % 3 = 0 AND override_id % 4 <> 0 THEN 'APPROVED' ELSE 'PENDING' END AS approval_status FROM revised"""
)
def override_state(spark: SparkSession, sf: str) -> DataFrame:
    return governance.latest_state(_overrides(spark, sf), _events(spark, sf)).select("override_id", "revision", "status", "approval_status")


def _current(spark: SparkSession, sf: str) -> DataFrame:
    state = governance.latest_state(_overrides(spark, sf), _events(spark, sf).filter("false"))
    return governance.active_overrides(state)


@query(
    estate.with_views(
        "plan",
        _OVERRIDES
        + """, o AS (SELECT * FROM revised WHERE status = 'ACTIVE')
SELECT p.oem, p.region, p.product, p.month, p.ai_units, CASE WHEN o.override_id IS NULL THEN p.ai_units WHEN sum(p.ai_units) OVER n > 1e-12 THEN o.override_units * (p.ai_units / sum(p.ai_units) OVER n) ELSE o.override_units * (1.0::DOUBLE / count(*) OVER n) END AS consensus_units,
  o.override_id IS NOT NULL AS overridden, o.user_id FROM plan p LEFT JOIN o ON o.oem = p.oem AND o.region = p.region AND o.month = p.month WINDOW n AS (PARTITION BY o.override_id)""",
    )
)
def consensus_single_depth(spark: SparkSession, sf: str) -> DataFrame:
    out = governance.consensus_single_level(estate.plan(spark, sf), _current(spark, sf))
    return out.select("oem", "region", "product", "month", "ai_units", "consensus_units", "overridden", "user_id")


@query(
    estate.with_views(
        "plan",
        _OVERRIDES
        + """, o AS (SELECT * FROM revised WHERE status = 'ACTIVE'), fine AS (SELECT *, CASE WHEN horizon = 1 AND product = 'SMALL' THEN 10.0::DOUBLE END AS pinned FROM plan),
n AS (SELECT f.*, o.override_id, o.user_id AS their_user, o.override_units - coalesce(sum(pinned) OVER n, 0.0::DOUBLE) AS rest, sum(ai_units) FILTER (pinned IS NULL) OVER n AS open, count(*) FILTER (pinned IS NULL) OVER n AS free
  FROM fine f LEFT JOIN o ON o.oem = f.oem AND o.region = f.region AND o.month = f.month WINDOW n AS (PARTITION BY o.override_id)),
b AS (SELECT *, pinned IS NULL AND override_id IS NOT NULL AND rest >= -1e-9 AS takes FROM n)
SELECT oem, region, product, month, ai_units, CASE WHEN pinned IS NOT NULL THEN pinned WHEN NOT takes THEN ai_units WHEN open > 1e-12 THEN rest * (ai_units / open) ELSE rest * (1.0::DOUBLE / free) END AS consensus_units,
  pinned IS NOT NULL OR takes AS overridden, CASE WHEN pinned IS NOT NULL THEN 'u9' WHEN takes THEN their_user END AS user_id FROM b""",
    )
)
def consensus_mixed_depth(spark: SparkSession, sf: str) -> DataFrame:
    plan = estate.plan(spark, sf)
    o = _current(spark, sf)
    leaf = plan.filter("horizon = 1 and product = 'SMALL'").select((F.xxhash64("oem", "region") % 1000 + 1_000_000).alias("override_id"), "oem", "region", "product", "month", F.lit(10.0).alias("override_units"), F.lit("LOST_DEAL").alias("reason_code"), F.lit("u9").alias("user_id"))
    out, _ = governance.consensus(plan, o.select(leaf.columns).unionByName(leaf))
    return out.select("oem", "region", "product", "month", "ai_units", "consensus_units", "overridden", "user_id")


@query(
    estate.with_views(
        "plan",
        """rows AS (SELECT *, 'R1' AS run_id FROM plan), each AS (SELECT 'ALL' AS run, 'ALL_ROWS' AS scope, CAST(NULL AS INTEGER) AS hz, * FROM rows UNION ALL SELECT 'ALL', 'ALL', NULL, * FROM rows WHERE overridden
  UNION ALL SELECT 'ALL', 'ALL', horizon, * FROM rows WHERE overridden UNION ALL SELECT run_id, 'RUN', NULL, * FROM rows WHERE overridden UNION ALL SELECT 'ALL', 'oem:' || oem, NULL, * FROM rows WHERE overridden
  UNION ALL SELECT 'ALL', 'region:' || region, NULL, * FROM rows WHERE overridden UNION ALL SELECT 'ALL', 'product:' || product, NULL, * FROM rows WHERE overridden UNION ALL SELECT 'ALL', 'user:' || user_id, NULL, * FROM rows WHERE overridden
  UNION ALL SELECT 'ALL', 'reason:' || reason_code, NULL, * FROM rows WHERE overridden),
w AS (SELECT run AS run_id, scope, hz AS horizon, count(*) AS n_obs, sum(abs(y - naive_units)) / sum(abs(y)) AS wmape_naive, sum(abs(y - ai_units)) / sum(abs(y)) AS wmape_ai, sum(abs(y - consensus_units)) / sum(abs(y)) AS wmape_consensus FROM each GROUP BY ALL)
SELECT *, wmape_ai - wmape_consensus AS fva_sales, wmape_naive - wmape_ai AS fva_ai FROM w""",
    )
)
def fva_scopes(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    frozen = estate.plan(spark, sf, facts).drop("y").withColumn("run_id", F.lit("R1"))
    actuals = estate.panel(spark, sf, facts).select("month", "oem", "region", "product", F.col("units").alias("y"))
    return governance.value_added(governance.matured(frozen, actuals))


@query()
def bootstrap_fva(spark: SparkSession, sf: str) -> DataFrame:
    return governance.bootstrap(estate.plan(spark, sf).filter("overridden"), ("region",))


@query(
    estate.with_views(
        "panel plan",
        f"""last AS (SELECT oem, region, product, max_by(units, month) AS u FROM panel WHERE month <= {estate.CYCLE_SQL} GROUP BY ALL)
SELECT p.oem, p.region, p.product, p.month, p.ai_units, coalesce(o.units, l.u, 0.0::DOUBLE) AS naive_units FROM plan p LEFT JOIN panel o ON o.month <= {estate.CYCLE_SQL} AND o.oem = p.oem AND o.region = p.region AND o.product = p.product AND CAST(o.month + INTERVAL 12 MONTH AS DATE) = p.month
LEFT JOIN last l ON l.oem = p.oem AND l.region = p.region AND l.product = p.product""",
    )
)
def frozen_version(spark: SparkSession, sf: str) -> DataFrame:
    facts = estate.facts(spark, sf)
    plan = estate.plan(spark, sf, facts).select("oem", "region", "product", "month", "ai_units")
    return governance.freeze(plan, estate.panel(spark, sf, facts).select("oem", "region", "product", "month", "units"), F.lit(estate.CYCLE))


@query(
    estate.with_views(
        "plan",
        """requests AS (SELECT oem, region, product, month, ai_units, asp, CASE WHEN length(product) % 2 = 0 THEN 'UNITS' ELSE 'REVENUE' END AS basis, CASE WHEN horizon = 5 THEN -1.0::DOUBLE WHEN length(product) % 2 = 0 THEN ai_units * 2 ELSE ai_units * asp END AS value,
  CASE WHEN horizon = 4 THEN 'WHIM' ELSE 'PROMOTION' END AS reason_code, CASE WHEN horizon <= 2 THEN 'a campaign in all shops' ELSE 'short' END AS comment, 'rep' AS user_id, horizon FROM plan),
u AS (SELECT *, CASE WHEN asp > 0 THEN asp ELSE 0.0::DOUBLE END AS price FROM requests),
v AS (SELECT *, CASE WHEN basis = 'UNITS' THEN value WHEN price > 0 THEN value / price ELSE 0.0::DOUBLE END AS override_units, CASE WHEN basis = 'UNITS' THEN value * price ELSE value END AS override_revenue FROM u),
d AS (SELECT *, CASE WHEN ai_units > 1e-9 THEN abs(override_units / ai_units - 1) * 100 WHEN override_units > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS deviation_pct FROM v)
SELECT oem, region, product, month, override_units, override_revenue, deviation_pct, CASE WHEN reason_code = 'WHIM' THEN 'unknown reason' WHEN value < 0 THEN 'negative value' WHEN region = 'ASIA' THEN 'outside the user''s scope' WHEN deviation_pct > 60.0 + 1e-6 AND length(comment) < 15 THEN 'a large change needs a comment' END AS error FROM d""",
    )
)
def override_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = estate.plan(spark, sf)
    even = F.length("product") % 2 == 0
    requests = p.select(
        "oem", "region", "product", "month", F.when(even, "UNITS").otherwise("REVENUE").alias("basis"),
        F.when(F.col("horizon") == 5, -1.0).when(even, F.col("ai_units") * 2).otherwise(F.col("ai_units") * F.col("asp")).alias("value"),
        F.when(F.col("horizon") == 4, "WHIM").otherwise("PROMOTION").alias("reason_code"), F.when(F.col("horizon") <= 2, "a campaign in all shops").otherwise("short").alias("comment"), F.lit("rep").alias("user_id"), F.lit(False).alias("locked"),
    )
    points = p.select("oem", "region", "product", "month", F.col("ai_units").alias("units"), (F.col("ai_units") * F.col("asp")).alias("revenue"), "asp")
    regions = [r for r in estate.CURRENCY if r != "ASIA"]
    scopes = spark.createDataFrame([("rep", "sales_rep", [], regions)], "user_id string, role string, oems array<string>, regions array<string>")
    out = governance.check_overrides(requests, points, scopes)
    return out.select("oem", "region", "product", "month", "override_units", "override_revenue", "deviation_pct", "error")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Entries chained in pairs: an even entry starts anew from the genesis, an odd one follows it; one of 1,000 was altered."""
    k = F.col("o_orderkey")
    rows = estate.table(spark, sf, "orders").select(
        k.alias("entry_id"), F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("user_id"), F.lit("SET").alias("action"), F.lit("order").alias("entity_type"), k.cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("before"), F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('"}')).alias("after"),
    )
    head = governance.entry_hash(F.lit(governance.GENESIS), *(F.col(c) for c in ("user_id", "action", "entity_type", "entity_id", "before", "after")))
    even = rows.filter("entry_id % 2 = 0").withColumn("prev_hash", F.lit(governance.GENESIS)).withColumn("hash", head)
    odd = rows.filter("entry_id % 2 = 1").join(even.select((F.col("entry_id") + 1).alias("entry_id"), F.col("hash").alias("prev_hash")), "entry_id")
    odd = odd.withColumn("hash", governance.entry_hash(*(F.col(c) for c in ("prev_hash", "user_id", "action", "entity_type", "entity_id", "before", "after"))))
    spoiled = F.when(k_mod(1000, 1), F.concat(F.col("after"), F.lit(" "))).otherwise(F.col("after"))
    return even.unionByName(odd).withColumn("after", spoiled)


def k_mod(n: int, rest: int):
    return F.col("entry_id") % n == rest


@query("""SELECT o_orderkey AS entry_id FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderkey > (SELECT min(o_orderkey) FROM orders)) OR o_orderkey % 1000 = 1""")
def audit_chain_check(spark: SparkSession, sf: str) -> DataFrame:
    return governance.broken_entries(_log(spark, sf))


@query(estate.with_views("plan", "SELECT level, oem, region, product, month, units FROM (SELECT 'OEM_REGION' AS level, oem, region, 'ALL' AS product, month, sum(ai_units) AS units FROM plan GROUP BY ALL)"))
def override_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = hierarchy.rollup(estate.plan(spark, sf), {"units": F.sum("ai_units")})
    return nodes.filter(hierarchy.level_of(F.col("oem"), F.col("region"), F.col("product")) == "OEM_REGION")




@query(f"WITH {_OVERRIDES} SELECT override_id, oem, region, month FROM ovs WHERE oem = 'MACHINERY' ORDER BY override_id DESC LIMIT 50")
def node_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """The newest overrides of nodes that overlap an oem's node of one product."""
    from tidecast.operators import views

    return views.node_overrides(_overrides(spark, sf), oem="MACHINERY", product="SMALL").select("override_id", "oem", "region", "month")


@query()
def simulated_overrides(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.sources import synthetic

    plan = estate.plan(spark, sf)
    return synthetic.simulate_overrides(plan, plan.select("oem", "region", "product", "month", "y"))
