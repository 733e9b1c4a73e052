"""Reconciliation by joins, held against the dense projection."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import hierarchy, projection, reconcile


def planted(spark, oems, regions, products, months=40, seed=1):
    """(leaves, forecasts, residuals, nodes, leaf names, summing matrix, y, residual matrix)"""
    rng = np.random.default_rng(seed)
    rows = [(f"o{o}", f"r{r}", f"p{p}") for o in range(oems) for r in range(regions) for p in range(products) if rng.uniform() < 0.8]
    leaves = spark.createDataFrame(rows, "oem string, region string, product string")
    nodes, names, s = reconcile.summing(leaves)
    days = [datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)]
    y = s @ rng.uniform(5, 50, (len(names), 2)) + rng.standard_normal((len(nodes), 2))
    shared = rng.standard_normal((3, months))
    resid = rng.standard_normal((len(nodes), 3)) @ shared + rng.uniform(0.5, 2, (len(nodes), 1)) * rng.standard_normal((len(nodes), months))
    forecasts = spark.createDataFrame([(n, days[k], float(y[i, k])) for i, n in enumerate(nodes) for k in range(2)], "unique_id string, ds date, mean double")
    old = [datetime.date(2010 + k // 12, k % 12 + 1, 1) for k in range(months)]
    residuals = spark.createDataFrame([(n, old[k], float(resid[i, k])) for i, n in enumerate(nodes) for k in range(months)], "unique_id string, ds date, resid double")
    return leaves, forecasts, residuals, nodes, s, y, resid, days


@pytest.fixture(scope="module")
def case(spark):
    return planted(spark, 4, 3, 6)


@pytest.mark.parametrize("method", reconcile.METHODS)
def test_equals_the_dense_projection(spark, case, method):
    leaves, forecasts, residuals, nodes, s, y, resid, days = case
    want = s @ np.maximum(reconcile.projection(s, reconcile.ERRORS[method](s, resid)) @ y, 0)
    got = {(r[0], r[1]): r[2] for r in reconcile.reconcile(forecasts, leaves, residuals, method).collect()}
    assert len(got) == 2 * len(nodes)
    assert max(abs(got[n, d] - want[i, k]) for i, n in enumerate(nodes) for k, d in enumerate(days)) < 1e-8 * np.abs(want).max()


def test_shrinkage_equals_that_of_the_whole_matrix(spark, case):
    _, _, residuals, nodes, _, _, resid, _ = case
    months = [r[0] for r in residuals.select("ds").distinct().orderBy("ds").collect()]
    rows = projection.lined(residuals.withColumnRenamed("unique_id", "node"), "node", "ds", "resid", months).withColumnRenamed("resid", "e")
    got, shrink = projection.shrunk(rows, len(months))
    cov, want = reconcile.shrunk_covariance(resid)
    assert abs(shrink - want) < 1e-10 and 0 < want < 1
    found = {r["node"]: (r["d"], np.array(r["u"])) for r in got.collect()}
    u = np.stack([found[n][1] for n in nodes])
    assert np.allclose(np.diag([found[n][0] for n in nodes]) + u @ u.T, cov, atol=1e-9)


@pytest.mark.parametrize("method", ["wls_struct", "mint_shrink"])
def test_conjugate_gradients_give_the_same(spark, monkeypatch, method):
    leaves, forecasts, residuals, nodes, s, y, resid, days = planted(spark, 2, 2, 3, months=8, seed=2)
    want = s @ np.maximum(reconcile.projection(s, reconcile.ERRORS[method](s, resid)) @ y, 0)
    monkeypatch.setattr(projection, "DENSE", 0)
    got = {(r[0], r[1]): r[2] for r in reconcile.reconcile(forecasts, leaves, residuals, method).collect()}
    assert max(abs(got[n, d] - want[i, k]) for i, n in enumerate(nodes) for k, d in enumerate(days)) < 1e-7 * np.abs(want).max()


def test_fifty_thousand_leaves_are_coherent(spark):
    leaves = spark.range(50_000).select(*(F.concat(F.lit(d[0]), (F.floor(F.col("id") / by) % n).cast("string")).alias(d) for d, by, n in (("oem", 1, 50), ("region", 50, 20), ("product", 1000, 50))))
    up = hierarchy.edges(leaves)
    forecasts = up.select(F.col("node").alias("unique_id")).distinct().select("unique_id", F.lit(datetime.date(2020, 1, 1)).alias("ds"), (F.pmod(F.xxhash64("unique_id"), F.lit(1000)) + 1).cast("double").alias("mean"))
    got = reconcile.reconcile(forecasts, leaves, None, "wls_struct").cache()
    sums = up.join(got.withColumnRenamed("unique_id", "leaf"), "leaf").groupBy(F.col("node").alias("unique_id")).agg(F.sum("mean").alias("s"))
    worst, rows = got.join(sums, "unique_id").agg(F.max(F.abs(F.col("s") - F.col("mean")) / F.greatest("s", F.lit(1.0))), F.count("*")).first()
    assert worst < 1e-9 and rows == up.select("node").distinct().count() > 50_000


def test_methods_that_cannot_be_done_are_left_to_the_next(spark, case):
    leaves, forecasts, residuals, *_ = case
    by = lambda method, r: {tuple(x[:2]): x[2] for x in reconcile.reconcile(forecasts, leaves, r, method).collect()}
    plain = by("ols", None)
    for other in (by("mint_shrink", None), by("wls_var", residuals.filter("resid is null"))):
        assert other.keys() == plain.keys() and all(abs(other[k] - plain[k]) < 1e-9 * (1 + plain[k]) for k in plain)
    assert reconcile.reconcile(forecasts.filter("false"), leaves, None, "ols").collect() == []
    with pytest.raises(ValueError):
        reconcile.reconcile(forecasts, leaves, None, "other")
