"""A query reads the order tables once, however many planning tables it is made from."""

import datetime

import pytest

from pyspark.sql import functions as F

from tidecast.plans import estate, registry
from tidecast.sources.sales_files import drop_partial_month

SF = "/root/testdata/sf0.001"
NAMES = ("alert_summary", "explorer", "champion_rows", "revenue_gap", "coverage_table", "capabilities", "asp_blend", "conformal_applied", "metric_grid", "champion_pick", "error_drift", "supply_bottleneck", "frozen_version", "fva_scopes", "conformal_quantile", "historical_p10_coverage")


@pytest.mark.parametrize("name", NAMES)
def test_lines_are_read_once(spark, monkeypatch, name):
    read, table = [], estate.table
    monkeypatch.setattr(estate, "table", lambda spark, sf, what: read.append(what) or table(spark, sf, what))
    registry.queries()[name](spark, SF)
    assert read.count("lineitem") == 1


def test_bounds_of_facts_are_those_of_days(spark):
    day = datetime.date
    for last in ([day(2001, 5, 1)], [day(2001, 5, 1), day(2001, 5, 30)], [day(2001, 5, 31)], [day(2001, 5, 2)]):
        rows = spark.createDataFrame([(d, d.replace(day=1)) for d in (day(2001, 4, 1), *last)], "ship_date date, month date")
        by = rows.groupBy("month").agg(F.max("ship_date").alias("ship_date"))
        kept = lambda df: sorted(r.month for r in drop_partial_month(df, "ship_date").select("month").distinct().collect())
        assert kept(by) == kept(rows)


def test_data_checks_read_lines_for_the_mapping_and_for_all_else(spark, monkeypatch):
    read, table = [], estate.table
    monkeypatch.setattr(estate, "table", lambda spark, sf, what: read.append(what) or table(spark, sf, what))
    registry.queries()["dq_checks"](spark, SF)
    assert read.count("lineitem") == 2


def test_backtest_of_models_reads_lines_once(spark, monkeypatch):
    read, table = [], estate.table
    monkeypatch.setattr(estate, "table", lambda spark, sf, what: read.append(what) or table(spark, sf, what))
    registry.queries()["model_backtest"](spark, SF)
    assert read.count("lineitem") == 1
