"""Queries on mapping accounts and facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.metrics import exact_sum
from tidecast.functions.text import name_similarity
from tidecast.functions.vectors import hash_embedding
from tidecast.operators import mapping, resolution
from tidecast.plans import estate
from tidecast.plans.registry import query


def _source(spark: SparkSession, sf: str) -> DataFrame:
    keys = ("month", "account_id", "end_account_id", "product", "currency")
    return estate.sales(spark, sf).groupBy(*keys).agg(F.sum(F.col("units").cast("decimal(18,2)")).alias("units"), F.sum("revenue").alias("revenue"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.map_facts(_source(spark, sf), estate.mapping(spark, sf), ("units", "revenue"))


_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


@query(estate.with_views("mapped", f"SELECT month, oem, region, {_MONEY.format('units')} AS units, {_MONEY.format('revenue')} AS revenue FROM mapped GROUP BY month, oem, region"))
def effective_dated_map(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).groupBy("month", "oem", "region").agg(exact_sum(F.col("units")).alias("units"), exact_sum(F.col("revenue")).alias("revenue"))


@query(estate.with_views("mapped", f"SELECT end_account_id, oem, count(*) AS n, {_MONEY.format('units')} AS units FROM mapped WHERE end_account_id IS NOT NULL GROUP BY ALL"))
def end_customer_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(spark, sf).filter("end_account_id is not null")
    return rows.groupBy("end_account_id", "oem").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("units")).alias("units"))


@query(estate.with_views("mapped", f"SELECT account_id, oem, CAST(pct AS DOUBLE) AS pct, count(*) AS n, {_MONEY.format('units')} AS units FROM mapped WHERE account_id % 10 IN (1, 2) AND end_account_id IS NULL GROUP BY ALL"))
def allocation_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(spark, sf).filter("account_id % 10 in (1, 2) and end_account_id is null")
    return rows.groupBy("account_id", "oem", F.col("pct").cast("double").alias("pct")).agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("units")).alias("units"))


@query(estate.with_views("mapped", f"SELECT month, u / t AS share FROM (SELECT month, coalesce({_MONEY.format('CASE WHEN oem = $$UNMAPPED$$ THEN units ELSE 0 END')}, 0) AS u, {_MONEY.format('units')} AS t FROM mapped GROUP BY month)"))
def unmapped_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(spark, sf).groupBy("month").agg(exact_sum(F.when(F.col("oem") == "UNMAPPED", F.col("units")).otherwise(0)).alias("u"), exact_sum(F.col("units")).alias("t"))
    return rows.select("month", (F.col("u") / F.col("t")).alias("share"))


def _usd(where: str) -> str:
    value = "CAST(CAST(s.revenue AS DECIMAL(20,8)) * f.rate AS DECIMAL(18,4))"
    return estate.with_views("source fx", f"SELECT s.month, s.currency, {_MONEY.format(value)} AS revenue FROM source s LEFT JOIN fx f ON f.currency = s.currency AND {where} GROUP BY ALL")


@query(_usd("f.month = (SELECT max(month) FROM source)"))
def fx_constant(spark: SparkSession, sf: str) -> DataFrame:
    rows = mapping.with_rate(_source(spark, sf), estate.fx(spark, sf))
    return rows.groupBy("month", "currency").agg(exact_sum(mapping.in_usd(F.col("revenue"))).alias("revenue"))


@query(_usd("f.month = s.month"))
def fx_actual(spark: SparkSession, sf: str) -> DataFrame:
    rows = mapping.with_rate(_source(spark, sf), estate.fx(spark, sf), "actual")
    return rows.groupBy("month", "currency").agg(exact_sum(mapping.in_usd(F.col("revenue"))).alias("revenue"))


@query(_usd("f.month = DATE '1997-06-01'"))
def fx_base_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = mapping.with_rate(_source(spark, sf), estate.fx(spark, sf), base_month=date(1997, 6, 1))
    return rows.groupBy("month", "currency").agg(exact_sum(mapping.in_usd(F.col("revenue"))).alias("revenue"))


@query(
    estate.with_views(
        "mapped fx",
        f"""SELECT m.month, m.oem, m.region, m.product, {_MONEY.format('m.units')} AS units, {_MONEY.format('CAST(m.revenue AS DECIMAL(20,8)) * f.rate')} AS revenue
FROM mapped m LEFT JOIN fx f ON f.currency = m.currency AND f.month = (SELECT max(month) FROM source) GROUP BY ALL""",
    )
)
def mapped_series(spark: SparkSession, sf: str) -> DataFrame:
    sales = estate.sales(spark, sf).withColumn("units", F.col("units").cast("decimal(18,2)"))
    return mapping.mapped_series(sales, estate.mapping(spark, sf), estate.fx(spark, sf))


@query(
    estate.with_views(
        "fx",
        "SELECT m.month, f.currency, CAST(f.rate AS DOUBLE) AS rate FROM (VALUES (DATE '2003-01-01'), (DATE '2003-02-01')) m(month) CROSS JOIN (SELECT currency, max_by(rate, month) AS rate FROM fx WHERE month <= DATE '2001-05-01' GROUP BY currency) f",
    )
)
def fx_future(spark: SparkSession, sf: str) -> DataFrame:
    months = spark.createDataFrame([(date(2003, 1, 1),), (date(2003, 2, 1),)], "month date")
    return mapping.future_rates(estate.fx(spark, sf), months, "constant", date(2001, 5, 1)).select("month", "currency", F.col("rate").cast("double").alias("rate"))


# ---------------------------------------------------------------- accounts


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return estate.table(spark, sf, "customer").select(
        k.alias("account_id"),
        F.col("c_name").alias("name"),
        F.when(k % 8 != 0, F.col("c_mktsegment")).alias("region"),
        F.when(k % 10 == 1, "DISTRIBUTOR").otherwise("OEM").alias("account_type"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("string").alias("global_ultimate_duns"),
        F.concat(F.lit("D"), (k % 97).cast("string")).alias("duns"),
        F.when(k % 3 == 0, F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("tax_id"),
        F.lit(None).cast("string").alias("erp_parent_id"),
        F.concat(F.lower("c_mktsegment"), F.lit(".com")).alias("domain"),
    )


def _identifiers(spark: SparkSession, sf: str) -> DataFrame:
    c = estate.table(spark, sf, "customer")
    k = (F.col("c_custkey") % 97).alias("k")
    duns = c.select(k).distinct().filter("k < 40").select(F.lit("DUNS").alias("id_type"), F.concat(F.lit("D"), F.col("k").cast("string")).alias("id_value"), F.concat(F.lit("OEM"), (F.col("k") % 5).cast("string")).alias("oem"))
    tax = c.select("c_nationkey").distinct().filter("c_nationkey < 12").select(F.lit("TAX_ID").alias("id_type"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("id_value"), F.concat(F.lit("OEM"), (F.col("c_nationkey") % 5).cast("string")).alias("oem"))
    domain = c.select("c_mktsegment").distinct().filter("c_mktsegment <> 'BUILDING'").select(F.lit("DOMAIN").alias("id_type"), F.concat(F.lower("c_mktsegment"), F.lit(".com")).alias("id_value"), F.concat(F.lit("OEM"), (F.length("c_mktsegment") % 5).cast("string")).alias("oem"))
    return duns.unionByName(tax).unionByName(domain)


_HITS = """hits AS (
  SELECT c_custkey AS account_id, c_custkey, c_mktsegment, 20 AS priority, 'RULE_DUNS_EXACT' AS source, 1.0::DOUBLE AS confidence, 'OEM' || (c_custkey % 97 % 5) AS oem FROM customer WHERE c_custkey % 97 < 40
  UNION ALL SELECT c_custkey, c_custkey, c_mktsegment, 30, 'RULE_TAX_ID', 0.99::DOUBLE, 'OEM' || (c_nationkey % 5) FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12
  UNION ALL SELECT c_custkey, c_custkey, c_mktsegment, 50, 'RULE_DOMAIN', 0.95::DOUBLE, 'OEM' || (length(c_mktsegment) % 5) FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@query(
    f"""WITH {_HITS}
SELECT account_id, arg_min(oem, priority) AS oem, CASE WHEN account_id % 8 <> 0 THEN any_value(c_mktsegment) ELSE 'AMER' END AS region, arg_min(source, priority) AS source,
  CASE WHEN count(DISTINCT oem) > 1 THEN 0.5::DOUBLE ELSE arg_min(confidence, priority) END AS confidence, CASE WHEN count(DISTINCT oem) > 1 OR account_id % 8 = 0 THEN 'PENDING_REVIEW' ELSE 'ACTIVE' END AS status, count(DISTINCT oem) > 1 AS conflict
FROM hits WHERE account_id % 10 <> 1 GROUP BY account_id"""
)
def rule_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    accounts = _accounts(spark, sf)
    none = estate.mapping(spark, sf).filter("false").withColumn("status", F.lit("ACTIVE"))
    aliases = spark.createDataFrame([("no such name", "OEM0")], "alias string, oem string")
    hits = resolution.rule_hits(resolution.unmapped_accounts(accounts, none), resolution.default_rules(spark), _identifiers(spark, sf), aliases)
    return resolution.decide(hits).select("account_id", "oem", "region", "source", "confidence", "status", "conflict")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    waits = F.when(F.col("account_id") % 10 == 4, "PENDING_REVIEW").otherwise("ACTIVE")
    return estate.mapping(spark, sf).select("account_id", "oem", F.col("pct").cast("double").alias("pct"), "valid_from", "valid_to", waits.alias("status"))


_HISTORY = "history AS (SELECT account_id, oem, CAST(pct AS DOUBLE) AS pct, valid_from, valid_to, CASE WHEN account_id % 10 = 4 THEN 'PENDING_REVIEW' ELSE 'ACTIVE' END AS status FROM mapping)"


@query(
    estate.with_views(
        "mapping",
        _HISTORY
        + """, changed AS (SELECT account_id AS a, CASE WHEN account_id % 2 = 0 THEN DATE '1997-01-01' ELSE DATE '1999-01-01' END AS f FROM (SELECT DISTINCT account_id FROM mapping WHERE account_id >= 0 AND account_id % 3 = 0))
SELECT account_id, oem, pct, valid_from, CASE WHEN f IS NULL OR status <> 'ACTIVE' THEN valid_to WHEN valid_from >= f THEN valid_from WHEN valid_to IS NULL OR valid_to > f THEN f ELSE valid_to END AS valid_to,
  CASE WHEN f IS NOT NULL AND (status = 'PENDING_REVIEW' OR valid_from >= f) THEN 'SUPERSEDED' ELSE status END AS status FROM history LEFT JOIN changed ON a = account_id""",
    )
)
def scd2_close(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    f = F.when(F.col("account_id") % 2 == 0, F.lit(date(1997, 1, 1))).otherwise(F.lit(date(1999, 1, 1)))
    changes = h.filter("account_id >= 0 and account_id % 3 = 0").select("account_id").distinct().select("account_id", f.alias("new_from"))
    return mapping.close_active(h, changes)


@query(
    """WITH c AS (SELECT c_custkey AS account_id, unnest(CASE c_custkey % 5 WHEN 0 THEN [0.7, 0.2] WHEN 1 THEN [1.5, -0.5] WHEN 2 THEN [0.5, 0.5] WHEN 3 THEN [0.6, 0.4] ELSE [1.0] END) AS pct, unnest(CASE c_custkey % 5 WHEN 2 THEN ['A', 'A'] WHEN 4 THEN ['B'] ELSE ['A', 'B'] END) AS oem FROM customer)
SELECT account_id, CASE account_id % 5 WHEN 0 THEN 'shares must sum to 1' WHEN 1 THEN 'shares must be positive' WHEN 2 THEN 'an oem and region twice' WHEN 3 THEN 'only distributors may be split' ELSE 'unknown oem' END AS error
FROM (SELECT DISTINCT account_id FROM c) WHERE NOT (account_id % 5 = 3 AND account_id % 10 = 3)"""
)
def allocation_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = F.create_map(*(x for i, parts in enumerate(([("A", 0.7), ("B", 0.2)], [("A", 1.5), ("B", -0.5)], [("A", 0.5), ("A", 0.5)], [("A", 0.6), ("B", 0.4)], [("Z", 1.0)])) for x in (F.lit(i).cast("long"), F.array(*(F.struct(F.lit(o).alias("oem"), F.lit(p).alias("pct")) for o, p in parts)))))
    changes = estate.table(spark, sf, "customer").select(k.alias("account_id"), F.explode(F.element_at(rows, k % 5)).alias("p")).select("account_id", "p.oem", F.lit("R").alias("region"), F.col("p.pct").cast("decimal(9,6)").alias("pct"))
    accounts = estate.table(spark, sf, "customer").select(k.alias("account_id"), F.when(k % 10 == 3, "DISTRIBUTOR").otherwise("OEM").alias("account_type"))
    return mapping.allocation_errors(changes, accounts, spark.createDataFrame([("A",), ("B",)], "oem string"))


@query(
    estate.with_views(
        "mapping",
        _HISTORY
        + """ SELECT c_custkey AS account_id, CASE WHEN a THEN 'MAPPED' WHEN p THEN 'PENDING' WHEN c_custkey % 20 = 0 THEN 'NEEDS_ALLOCATION' ELSE 'UNMAPPED' END AS status
FROM customer LEFT JOIN (SELECT account_id, bool_or(status = 'ACTIVE') AS a, bool_or(status = 'PENDING_REVIEW') AS p FROM history GROUP BY account_id) ON account_id = c_custkey""",
    )
)
def account_status(spark: SparkSession, sf: str) -> DataFrame:
    accounts = estate.table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_custkey") % 20 == 0, "DISTRIBUTOR").otherwise("OEM").alias("account_type"))
    return resolution.account_status(accounts, _history(spark, sf))


@query(
    """WITH names AS (SELECT DISTINCT p_name AS n, split_part(p_name, ' ', 1) AS w FROM part),
pairs AS (SELECT a.n AS name, b.n || ' ltd' AS full_alias, b.n AS alias FROM names a JOIN names b ON a.w = b.w),
sims AS (SELECT *, string_split(name, ' ') AS nt, string_split(alias, ' ') AS t FROM pairs),
scored AS (SELECT *, [list_max([1.0::DOUBLE - levenshtein(a, x) / greatest(length(a), length(x)) FOR x IN nt]) FOR a IN t] AS best,
  [x FOR x IN nt IF list_max([1.0::DOUBLE - levenshtein(a, x) / greatest(length(a), length(x)) FOR a IN t]) < 0.6] AS extra FROM sims)
SELECT name, full_alias AS alias, greatest(list_sum([CASE WHEN b >= 0.6 THEN b ELSE 0 END FOR b IN best]) / len(t) * (1 - least(0.36::DOUBLE, 0.12::DOUBLE * len(extra))),
  1.0::DOUBLE - levenshtein(name, alias) / greatest(length(name), length(alias))) AS sim FROM scored"""
)
def levenshtein_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from tidecast.functions.text import normalize_name

    names = estate.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().withColumn("w", F.split("name", " ")[0])
    pairs = names.join(names.select("w", F.concat("name", F.lit(" ltd")).alias("alias")), "w")
    return pairs.select("name", "alias", name_similarity(normalize_name(F.col("name")), normalize_name(F.col("alias"))).alias("sim"))


@query(
    """WITH near AS (SELECT q.vec_id AS query, v.vec_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 12) DESC, v.vec_id) AS n
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v ON q.vec_id <> v.vec_id),
votes AS (SELECT query, label, count(*) AS votes FROM near WHERE n <= 5 GROUP BY query, label)
SELECT query, label, votes FROM votes QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1"""
)
def knn_cosine_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    e = estate.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    near = resolution.nearest(e.filter("id % 20 = 0"), e, 5, exclude_self=True)
    return resolution.knn_vote(near, e.select("id", "label"))


@query()
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    names = estate.table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", hash_embedding(F.col("p_name")).alias("embedding"))


@query()
def fuzzy_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Customers named after parts, all of them and with a slip in some names, against the parts' names as aliases; those named by a colour are mapped."""
    p = estate.table(spark, sf, "part").select("p_partkey", "p_name")
    aliases = p.select(F.col("p_name").alias("alias"), F.element_at(F.split("p_name", " "), -1).alias("oem")).distinct()
    k = F.col("p_partkey")
    names = F.when(k % 3 == 0, F.concat("p_name", F.lit(" GmbH"))).when(k % 3 == 1, F.overlay("p_name", F.lit("x"), 2)).otherwise(F.concat(F.lit("Nord "), "p_name"))
    accounts = p.select(k.alias("account_id"), names.alias("name"), F.when(k % 2 == 0, "EU").alias("region"))
    mapped = p.filter("p_name rlike '^(red|blue) '").select(k.alias("account_id"), F.col("p_name").alias("name"), F.lit("US").alias("region"), F.element_at(F.split("p_name", " "), -1).alias("oem"))
    return resolution.score_accounts(accounts, aliases, mapped)


@query()
def name_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Parts under names with a slip or a word more, mapped by name until no further one is: a seventh of the parts' own names hold from the start, and one oem has been rejected for some."""
    p = estate.table(spark, sf, "part").select("p_partkey", "p_name")
    oem, k = F.element_at(F.split("p_name", " "), -1), F.col("p_partkey")
    aliases = p.filter(k % 7 == 0).select(F.col("p_name").alias("alias"), oem.alias("oem")).distinct()
    names = F.when(k % 3 == 0, F.concat("p_name", F.lit(" GmbH"))).when(k % 3 == 1, F.overlay("p_name", F.lit("x"), 2)).otherwise(F.concat(F.lit("Nord "), "p_name"))
    accounts = p.filter(k % 7 != 0).select(k.alias("account_id"), names.alias("name"), F.when(k % 2 == 0, "EU").alias("region"))
    mapped = p.filter(k % 7 == 0).select(k.alias("account_id"), F.col("p_name").alias("name"), F.lit("US").alias("region"), oem.alias("oem"))
    rejected = p.filter(k % 11 == 0).select(k.alias("account_id"), oem.alias("oem"))
    return resolution.map_by_name(accounts, aliases, mapped, rejected)


@query("SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS oem, 'The ' || c_mktsegment AS oem_name, r_name AS region, 0.7::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 10 = 4")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = estate.table(spark, sf, "customer")
    waiting = estate.mapping(spark, sf).filter("account_id >= 0").withColumns({"status": F.when(F.col("account_id") % 10 == 4, "PENDING_REVIEW").otherwise("ACTIVE"), "confidence": F.lit(0.7)})
    oems = c.select(F.col("c_mktsegment").alias("oem")).distinct().withColumn("oem_name", F.concat(F.lit("The "), "oem"))
    return resolution.review_queue(waiting, c.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name")), oems)


@query("SELECT c_custkey AS account_id, c_name AS name, c_mktsegment AS segment FROM customer WHERE lower(c_name) LIKE '%r#00000001%' AND c_mktsegment = 'MACHINERY'")
def account_search(spark: SparkSession, sf: str) -> DataFrame:
    accounts = estate.table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return resolution.search(accounts, "R#00000001", segment="MACHINERY")


@query(
    """SELECT k AS rule_id, CASE WHEN k % 4 = 3 THEN 'unknown kind of rule' WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'unknown oem' WHEN k % 4 = 0 AND k % 5 = 0 THEN 'a pattern needs a target'
  ELSE 'the pattern cannot be read' END AS error FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 = 3 OR (k % 5 <> 0 AND k % 7 = 0) OR (k % 4 = 0 AND (k % 5 = 0 OR k % 3 = 0))"""
)
def rule_list_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for each customer, of four kinds, some without a target or with an unknown one, some with patterns that cannot be read."""
    c, k = estate.table(spark, sf, "customer"), F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("NAME_REGEX", "ALIAS_EXACT", next(iter(resolution.IDENTIFIER_RULES)), "GUESS"))), (k % 4 + 1).cast("int"))
    target = F.when(k % 5 == 0, None).when(k % 7 == 0, "NOBODY").otherwise(F.col("c_mktsegment"))
    rules = c.select(k.alias("rule_id"), kind.alias("rule_type"), target.alias("target_oem"), F.concat(F.when(k % 3 == 0, "(").otherwise("^"), "c_name").alias("pattern"))
    return resolution.rule_errors(rules, c.select(F.col("c_mktsegment").alias("oem")))


@query(
    """WITH n AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_custkey - c_custkey % 8 ELSE c_custkey END AS v, CASE WHEN c_custkey % 9 = 0 THEN 'NOBODY' ELSE c_mktsegment END AS oem FROM customer)
SELECT 'DUNS' AS id_type, CAST(v AS VARCHAR) AS id_value, oem, CASE WHEN oem = 'NOBODY' THEN 'unknown oem' ELSE 'the identifier is taken' END AS error
FROM (SELECT *, count(*) OVER (PARTITION BY v) AS c FROM n) WHERE oem = 'NOBODY' OR c > 1 OR v % 10 = 1"""
)
def identifier_list_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A new identifier for each customer: some equal another new one, some are taken, some are of no oem."""
    c, k = estate.table(spark, sf, "customer"), F.col("c_custkey")
    row = lambda v, oem: [F.lit("DUNS").alias("id_type"), v.cast("string").alias("id_value"), oem.alias("oem")]
    new = c.select(*row(F.when(k % 4 == 0, k - k % 8).otherwise(k), F.when(k % 9 == 0, "NOBODY").otherwise(F.col("c_mktsegment"))))
    return resolution.identifier_errors(new, c.filter(k % 10 == 1).select(*row(k, F.col("c_mktsegment"))), c.select(F.col("c_mktsegment").alias("oem")))


@query(
    """SELECT oem, name AS normalized_alias, min(alias) AS alias FROM (SELECT p_brand AS oem, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || ' Inc.' END AS alias FROM part
WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0) GROUP BY ALL"""
)
def alias_additions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of every second part as aliases of its brand, with those of the others added in capitals with a legal form, a fifth of them for no known brand."""
    p, k = estate.table(spark, sf, "part"), F.col("p_partkey")
    new = p.filter(k % 2 == 1).select(F.concat(F.upper("p_name"), F.lit(" Inc.")).alias("alias"), F.when(k % 5 == 0, "NOBODY").otherwise(F.col("p_brand")).alias("oem"))
    return resolution.add_aliases(p.filter(k % 2 == 0).select(F.col("p_name").alias("alias"), F.col("p_brand").alias("oem")), new, p.select(F.col("p_brand").alias("oem")))
