"""Models that search for forms, orders and cuts: held against definitions, grids, brute force and planted truths."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidecast.functions.simplex import minimise
from tidecast.operators import arima, boosting, models, smoothing
from tidecast.operators import panel as panels
from tidecast.plans import estate
from tidecast.sources.tables import checkpointed

T = np.arange(72)
WAVE = np.sin(2 * np.pi * T / 12)


def test_simplex_finds_the_lowest_points_of_many_problems():
    goals = np.random.default_rng(1).standard_normal((20, 3))
    f = lambda rows, x: np.square(x - goals[rows][:, None]).sum(axis=2) * (1 + rows[:, None])
    x, v = minimise(f, np.zeros((20, 3)), rounds=200, tolerance=1e-12)
    assert np.allclose(x, goals, atol=1e-3) and (v < 1e-5).all()
    x, v = minimise(lambda rows, x: np.full(x.shape[:2], np.nan), np.ones((2, 2)))
    assert np.isinf(v).all() and x.shape == (2, 2)


def test_smoothing_chooses_planted_forms():
    rng = np.random.default_rng(2)
    grows = [(50 + 2 * T) * (1 + 0.4 * WAVE) * np.exp(0.03 * rng.standard_normal(72)) for _ in range(8)]
    stays = [100 + 30 * WAVE + 3 * rng.standard_normal(72) for _ in range(8)]
    some = [rng.poisson(1, 40).astype(float) for _ in range(8)]
    forms = [x[0] for x in smoothing.chosen(grows + stays + some, 12)]
    assert all(f[2] == "M" and f[1] != "N" for f in forms[:8])
    assert all(f[2] != "N" for f in forms[8:16]) and sum(f[2] == "A" for f in forms[8:16]) >= 6
    assert all(f[0] == "A" and f[2] != "M" for f in forms[16:])  # zeros leave out what is multiplied
    mean = smoothing.chosen(grows[:1], 12)[0][2][0]
    truth = (50 + 2 * np.arange(72, 84)) * (1 + 0.4 * WAVE[:12])
    assert np.abs(mean / truth - 1).mean() < 0.1


@pytest.mark.parametrize("form", smoothing.FORMS)
def test_smoothing_is_never_worse_than_its_grid(form):
    rng = np.random.default_rng(3)
    batch = smoothing.Batch.of([80 + 20 * WAVE[:n] + 5 * rng.standard_normal(n) for n in (40, 55, 72)], 12)
    starts = smoothing.grid(form)
    grid = smoothing.walk(batch, form, np.broadcast_to(starts, (3, *starts.shape)))["score"].min(axis=1)
    assert (smoothing.fit_form(batch, form)[1] <= grid + 1e-9).all()


def test_walks_of_series_of_different_lengths_are_those_of_each_alone():
    rng = np.random.default_rng(4)
    series = [60 + 20 * WAVE[:n] + 4 * rng.standard_normal(n) for n in (30, 44, 72)]
    for form in smoothing.FORMS:
        u = rng.standard_normal((3, 2, smoothing.n_weights(form))) * 0.3
        together = smoothing.walk(smoothing.Batch.of(series, 12), form, u)
        for i, y in enumerate(series):
            alone = smoothing.walk(smoothing.Batch.of([y], 12), form, u[i : i + 1])
            assert np.allclose(together["score"][i], alone["score"][0]) and np.allclose(together["level"][i], alone["level"][0]) and np.allclose(together["cycle"][i], alone["cycle"][0])


@pytest.mark.parametrize("order", [*arima.STARTS, (1, 1, 0, 1), (0, 2, 1, 1), (2, 0, 0, 0), (1, 0, 1, 1)])
def test_likelihood_equals_that_of_the_dense_covariance(order):
    rng = np.random.default_rng(5)
    u, x = 0.6 * rng.standard_normal((2, sum(order))), rng.standard_normal((2, 40))
    ar, ma = arima.coefficients(u, order, 12)
    for i in range(2):
        psi, b = np.zeros(5000), np.r_[1, ma[i]]
        for j in range(5000):
            psi[j] = (b[j] if j < len(b) else 0) + sum(a * psi[j - k] for k, a in enumerate(ar[i], 1) if a and j >= k)
        gamma = np.array([psi[: 5000 - k] @ psi[k:] for k in range(40)])
        root = np.linalg.cholesky(gamma[np.abs(np.subtract.outer(range(40), range(40)))])
        z = np.linalg.solve(root, x[i])
        dense = 40 * np.log(z @ z / 40) + 2 * np.log(np.diag(root)).sum()
        assert abs(dense - arima.deviance(x[i : i + 1], np.array([40]), u[i : i + 1, None], order, 12)[0, 0]) < 1e-6


def test_shorter_series_of_a_batch_have_the_likelihood_of_their_own_months():
    rng = np.random.default_rng(6)
    x, u = rng.standard_normal((2, 50)), 0.5 * rng.standard_normal((2, 1, 4))
    x[1, 30:] = 0
    got = arima.deviance(x, np.array([50, 30]), u, (1, 1, 1, 1), 12)
    assert abs(got[1, 0] - arima.deviance(x[1:, :30], np.array([30]), u[1:], (1, 1, 1, 1), 12)[0, 0]) < 1e-9


def test_planted_seasonal_moving_terms_are_recovered():
    rng = np.random.default_rng(7)

    def planted(n):
        e = rng.standard_normal(n + 40)
        return 100 + np.convolve(np.convolve(e, [1, 0.5]), np.r_[1, np.zeros(11), 0.6])[20 : 20 + n]

    found = arima.chosen([planted(120) for _ in range(12)], 12)
    assert sum(f[0][3] == 1 for f in found) >= 9
    exact = [arima.coefficients(u[None], o, 12)[1][0] for o, u, _ in arima.search([planted(240) - 100 for _ in range(3)], 12, [False] * 3) if o == (0, 1, 0, 1)]
    assert exact and all(abs(m[0] - 0.5) < 0.25 and abs(m[11] - 0.6) < 0.25 for m in exact)


def test_neighbours_stay_within_bounds_and_short_or_constant_series_have_no_model():
    assert all(all(0 <= v <= m for v, m in zip(o, arima.MOST, strict=True)) for o in arima.neighbours((2, 0, 1, 0)))
    assert arima.chosen([np.array([1.0]), np.full(30, 7.0), np.arange(30.0)], 6) == [None] * 3
    assert smoothing.chosen([np.array([1.0]), np.array([1.0, 2.0, 3.0])], 6) == [None, None] and smoothing.chosen([], 6) == []


def test_best_cut_equals_trying_every_cut():
    rng = np.random.default_rng(8)
    for _ in range(20):
        bins, g = rng.integers(0, 6, (60, 4)), rng.standard_normal(60)
        sums, counts = np.zeros((4, 6)), np.zeros((4, 6), int)
        for f in range(4):
            np.add.at(sums[f], bins[:, f], g)
            np.add.at(counts[f], bins[:, f], 1)
        tried = {}
        for f in range(4):
            for b in range(5):
                left = bins[:, f] <= b
                if left.sum() >= 5 and (~left).sum() >= 5:
                    tried[f, b] = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / 60
        gain, f, b = boosting.best_cut(sums, counts, 5)
        assert abs(gain - max(tried.values())) < 1e-9 and abs(tried[f, b] - gain) < 1e-9
    assert boosting.best_cut(np.zeros((2, 3)), np.zeros((2, 3), int), 1) == (0.0, -1, 0)


def test_first_tree_equals_one_grown_in_memory_and_bands_hold_four_fifths(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, (4000, 3))
    y = 5 * (x[:, 0] > 0.5) + x[:, 1] + (0.2 + 2 * x[:, 2]) * rng.standard_normal(4000)
    rows = spark.createDataFrame(pd.DataFrame({"i": range(4000), "x": x.tolist(), "y": y})).repartition(4)
    forest = boosting.fit(rows.filter("i < 3000"), trees=24)
    bins, pull = forest.binned(x[:3000]), y[:3000] - forest.base["mean"]
    first = forest.trees["mean"][0]
    sums, counts = np.zeros((3, 32)), np.zeros((3, 32), int)
    for f in range(3):
        np.add.at(sums[f], bins[:, f], pull)
        np.add.at(counts[f], bins[:, f], 1)
    assert (first.feature[0], first.cut[0]) == boosting.best_cut(sums, counts, boosting.LEAST)[1:]
    leaves = first.leaves(bins, forest.depth)
    assert all(abs(first.value[k] - pull[leaves == k].mean()) < 1e-9 for k in np.unique(leaves))
    got = boosting.predict(rows.filter("i >= 3000"), forest, ("mean", "low", "high")).toPandas()
    held = got["y"].between(got["low"], got["high"]).mean()
    assert 0.75 <= held <= 0.85
    wide = (got["high"] - got["low"]).groupby(x[got["i"], 2] > 0.5).mean()
    assert wide[True] > 1.5 * wide[False]  # bands widen where the noise does


def test_forests_of_nothing_and_of_odd_features(spark):
    none = spark.createDataFrame([], "x array<double>, y double")
    forest = boosting.fit(none, trees=2)
    assert boosting.predict(spark.createDataFrame([], "x array<double>, k int"), forest, ("a", "b", "c")).collect() == []
    rows = spark.createDataFrame([([None, float("nan"), 1.0], float(i % 2)) for i in range(60)] + [([2.0, 1.0, 1.0], None)], "x array<double>, y double")
    forest = boosting.fit(rows, trees=2)
    assert boosting.predict(rows, forest, ("a", "b", "c")).filter("a is null or isnan(a)").count() == 0


def test_boosted_band_of_the_held_out_year(spark):
    long = panels.long(estate.panel(spark, SF))
    last = long.agg(F.add_months(F.max("ds"), -12)).first()[0]
    got = models.boosted(long.filter(F.col("ds") <= last), trees=15).join(long.select("unique_id", "ds", "y"), ["unique_id", "ds"])
    held, rows, fits = got.agg(F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("int")), F.count("*"), F.min((F.col("q10") <= F.col("mean")) & (F.col("mean") <= F.col("q90")))).first()
    assert rows > 1000 and fits and abs(held - 0.8) <= 0.05, held


def test_batches_do_not_change_forecasts(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(f"s{i}", d.date(), float(60 + 20 * WAVE[t] + 3 * rng.standard_normal())) for i in range(5) for t, d in enumerate(pd.date_range("2018-01-01", periods=30 + 4 * i, freq="MS"))]
    panel = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    kept = ("AutoETS", "AutoARIMA", "TSB")
    order = lambda df: {tuple(r[:5]): r[5] for r in df.collect()}
    whole = order(models.forecast(panel, kept, 6))
    monkeypatch.setattr(models, "TOGETHER", 1)
    alone = order(models.forecast(panel, kept, 6))
    assert whole.keys() == alone.keys() and len(whole) == 5 * 3 * 6
    assert all(abs(whole[k] - alone[k]) < 1e-6 * max(1, abs(whole[k])) for k in whole)
    assert {r[0] for r in models.residuals(panel, "AutoARIMA").select("unique_id").distinct().collect()} == {f"s{i}" for i in range(5)}


def test_predictions_end_with_their_series():
    """Rows of different lengths take no steps after their end, and are the same as alone."""
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=(4, 30)), np.array([12, 30, 7, 20])
    gamma = arima.autocovariances(np.tile([[0.5, 0.2]], (4, 1)), np.tile([[0.3]], (4, 1)), 30)
    errors, variances = arima.predictions(x, gamma, n)
    whole = arima.predictions(x, gamma)
    for i, k in enumerate(n):
        assert (errors[i, :k] == whole[0][i, :k]).all() and (variances[i, :k] == whole[1][i, :k]).all()
        assert (errors[i, k:] == 0).all() and (variances[i, k:] == 1).all()


def test_a_run_fits_its_backtest_once(spark, monkeypatch):
    """What models give is written before it is read again: of a run's forecasts none is left to be fitted twice."""
    from tidecast.operators import forecast_run, models

    made, forecast = [], models.forecast
    monkeypatch.setattr(forecast_run, "checkpointed", lambda df: made.append(df) or checkpointed(df))
    monkeypatch.setattr(models, "forecast", lambda *a, **k: made.append("forecast") or forecast(*a, **k))
    months = [datetime.date(2020 + k // 12, k % 12 + 1, 1) for k in range(30)]
    rows = [(o, "EU", "P", m, float(20 + 3 * i + j % 12), 100.0) for i, o in enumerate(("A", "B")) for j, m in enumerate(months)]
    forecast_run.run(spark.createDataFrame(rows, "oem string, region string, product string, month date, units double, revenue double"), ("SeasonalNaive", "CrostonSBA", "TSB"))
    at = [i for i, x in enumerate(made) if isinstance(x, str)]
    assert len(at) == 2 and all(not isinstance(made[i + 1], str) and "origin" in made[i + 1].columns and "y" not in made[i + 1].columns and "segment" not in made[i + 1].columns for i in at)
