"""Forecast models of single series, in numpy, fitted in batches of series; and a model over all series by boosted trees.

A model is a function (values, horizon, season) -> (mean, spread or None, fitted one-step values): spreads are those of a normal band, without one the series' own quantiles
are its band. A row holds the months of one series, a few hundred numbers at most; all series, models and origins are fitted in one stage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators import arima as seasonal_arima
from tidecast.operators import boosting, smoothing
from tidecast.operators.backtest import FIRST, HORIZON, STEP, Z90
from tidecast.operators.windows import horizon_features, rolling_features
from tidecast.sources.tables import checkpointed

Fit = tuple[np.ndarray, np.ndarray | None, np.ndarray]
FORECAST = "model string, unique_id string, origin date, h int, ds date, mean double, q10 double, q50 double, q90 double"


def naive(y: np.ndarray, horizon: int, season: int = 12) -> Fit:
    r = np.diff(y)
    s = np.sqrt((r * r).mean()) if len(r) else 0.0
    return np.full(horizon, y[-1]), s * np.sqrt(np.arange(1, horizon + 1)), np.r_[np.nan, y[:-1]]


def seasonal_naive(y: np.ndarray, horizon: int, season: int = 12) -> Fit:
    if len(y) <= season:
        return naive(y, horizon, season)
    r = y[season:] - y[:-season]
    k = np.arange(horizon)
    return y[len(y) - season + k % season], np.sqrt((r * r).mean()) * np.sqrt(k // season + 1), np.r_[np.full(season, np.nan), y[:-season]]


def _first(found: list, y: np.ndarray, horizon: int, season: int) -> Fit:
    return found[0][2] if found[0] is not None else naive(y, horizon, season)


def ets(y: np.ndarray, horizon: int, season: int = 12) -> Fit:
    return _first(smoothing.chosen([y], horizon, season), y, horizon, season)


def arima(y: np.ndarray, horizon: int, season: int = 12) -> Fit:
    return _first(seasonal_arima.chosen([y], horizon, season), y, horizon, season)


# ---------------------------------------------------------------- intermittent demand


def croston_sba(y: np.ndarray, horizon: int, season: int = 12, alpha: float = 0.1) -> Fit:
    """Smoothed size over smoothed interval of demands, less the known bias; the band is the series' own."""
    size = gap = None
    wait, fitted = 1, np.full(len(y), np.nan)
    for t, v in enumerate(y):
        if size is not None:
            fitted[t] = (1 - alpha / 2) * size / gap
        if v > 0:
            size, gap = (float(v), float(wait)) if size is None else (size + alpha * (v - size), gap + alpha * (wait - gap))
            wait = 1
        else:
            wait += 1
    return np.full(horizon, 0.0 if size is None else (1 - alpha / 2) * size / gap), None, fitted


def tsb(y: np.ndarray, horizon: int, season: int = 12, alpha: float = 0.2, beta: float = 0.2) -> Fit:
    """Smoothed size times smoothed chance of demand; the band is the series' own."""
    some = y[y > 0]
    size, chance = (float(some[0]) if len(some) else 0.0), float(len(some) / len(y))
    fitted = np.empty(len(y))
    for t, v in enumerate(y):
        fitted[t] = chance * size
        chance += beta * ((v > 0) - chance)
        if v > 0:
            size += alpha * (v - size)
    return np.full(horizon, chance * size), None, fitted


#: Models of single series; the others of the catalogue run over all series or cannot run here.
MODELS: dict[str, Callable[..., Fit]] = {"Naive": naive, "SeasonalNaive": seasonal_naive, "AutoETS": ets, "AutoARIMA": arima, "CrostonSBA": croston_sba, "TSB": tsb}
#: Models that take many series in one call.
BATCHED = {"AutoETS": smoothing.chosen, "AutoARIMA": seasonal_arima.chosen}
#: Series of one such call, at most.
TOGETHER = 50
CATALOGUE = (*MODELS, "LightGBM", "Chronos-2", "TiRex-2")
_NEEDS = {"Chronos-2": "chronos", "TiRex-2": "tirex"}


def availability() -> dict[str, str]:
    """Of each model why it cannot run; empty for those that can. LightGBM's place is taken by the trees of ``boosting``."""
    import importlib.util

    return {m: f"needs the package {_NEEDS[m]}" if m in _NEEDS and importlib.util.find_spec(_NEEDS[m]) is None else "" for m in CATALOGUE}


def band(y: np.ndarray, mean: np.ndarray, spread: np.ndarray | None) -> np.ndarray:
    """Columns mean, q10, q50, q90: not negative, never falling, with the mean inside."""
    mean = np.maximum(mean, 0.0)
    if spread is None:
        low, high = np.quantile(y, 0.1), np.quantile(y, 0.9)
        low, high = np.full(len(mean), low), np.full(len(mean), high)
    else:
        low, high = mean - Z90 * spread, mean + Z90 * spread
    return np.column_stack([mean, np.minimum(np.maximum(low, 0.0), mean), mean, np.maximum(high, mean)])


def _months(last, n: int) -> list:
    start = pd.Timestamp(last)
    return [(start + pd.DateOffset(months=k)).date() for k in range(1, n + 1)]


def as_series(panel: DataFrame) -> DataFrame:
    """unique_id, ds, y: a row for each series, with its months in order. Series are dealt to all shuffle partitions, since fitting them takes longer than moving them."""
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y")).repartition(n, "unique_id").groupBy("unique_id")
    return each.agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("s")).select("unique_id", "s.ds", "s.y")


def fitted(model: str, series: list[np.ndarray], horizon: int, season: int) -> list[Fit | None]:
    """A fit of each series; None where the model fails. Models that search for parameters take all series in one call, and give the naive fit where none of their forms fits."""
    if model in BATCHED:
        return [x[2] if x is not None else naive(y, horizon, season) for x, y in zip(BATCHED[model](series, horizon, season), series, strict=True)]
    out: list[Fit | None] = []
    for y in series:
        try:
            out.append(MODELS[model](y, horizon, season))
        except (ValueError, np.linalg.LinAlgError):
            out.append(None)
    return out


def forecast(panel: DataFrame, models: tuple[str, ...], horizon: int = HORIZON, first: int | None = None, step: int = STEP, season: int = 12) -> DataFrame:
    """Forecasts of ``panel`` (unique_id, ds, y; dense) by each model: with ``first`` from every origin of a backtest, else from the last month.

    ``TOGETHER`` series with all their origins are fitted in one call, so a series' months are shuffled once. A model that fails at an origin has no rows there."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                out = []
                part = list(batch.iloc[at : at + TOGETHER].itertuples(index=False))
                cuts = [(i, o) for i, r in enumerate(part) for o in ([len(r.y)] if first is None else range(first, len(r.y), step))]
                heads = [np.asarray(part[i].y[:o], float) for i, o in cuts]
                for m in models:
                    for (i, o), y, fit in zip(cuts, heads, fitted(m, heads, horizon, season), strict=True):
                        if fit is None:
                            continue
                        h = horizon if first is None else min(horizon, len(part[i].y) - o)
                        mean, spread, _ = fit
                        b = band(y, mean[:h], spread[:h] if spread is not None else None)
                        if np.isfinite(b).all():
                            months = _months(part[i].ds[o - 1], h)
                            out += [(m, part[i].unique_id, part[i].ds[o - 1], k + 1, months[k], *map(float, b[k])) for k in range(h)]
                yield pd.DataFrame(out, columns=["model", "unique_id", "origin", "h", "ds", "mean", "q10", "q50", "q90"])

    return as_series(panel).mapInPandas(run, FORECAST)


def residuals(panel: DataFrame, model: str = "AutoETS", season: int = 12) -> DataFrame:
    """unique_id, ds, y, resid: one-step errors within the series."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.iloc[at : at + TOGETHER]
                ys = [np.asarray(y, float) for y in part["y"]]
                for r, y, fit in zip(part.itertuples(index=False), ys, fitted(model, ys, 1, season), strict=True):
                    if fit is not None:
                        yield pd.DataFrame({"unique_id": r.unique_id, "ds": list(r.ds), "y": y, "resid": y - fit[2]})

    return as_series(panel).mapInPandas(run, "unique_id string, ds date, y double, resid double")


def model_status(forecasts: DataFrame, models: tuple[str, ...] = CATALOGUE) -> DataFrame:
    """model, status (OK, FAILED or UNAVAILABLE), note."""
    notes = availability()
    rows = forecasts.sparkSession.createDataFrame([(m, notes[m]) for m in models], "model string, note string")
    seen = forecasts.select("model").distinct().withColumn("_ok", F.lit(True))
    status = F.when(F.col("note") != "", "UNAVAILABLE").when(F.col("_ok"), "OK").otherwise("FAILED")
    return rows.join(seen, "model", "left").select("model", status.alias("status"), "note")


def boosted(panel: DataFrame, horizon: int = HORIZON, trees: int = boosting.TREES, least: int = 12) -> DataFrame:
    """Forecasts of all series by boosted trees under the name LightGBM, one forest each for the mean, the tenth and the ninetieth percentile: direct, with the horizon as a feature, on values scaled by the last year's mean.

    ``panel`` has unique_id, ds, y. No band of the model's own errors is needed: the quantiles are learned."""
    base = rolling_features(panel.withColumnRenamed("ds", "month").withColumnRenamed("y", "units"), ("unique_id",))
    old = panel.select("unique_id", F.col("ds").alias("_ds"), F.col("y").alias("_y"))
    t = F.row_number().over(Window.partitionBy("unique_id").orderBy("month"))
    rows = base.withColumn("_t", t).filter(F.col("_t") >= least).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("ds", F.add_months("month", F.col("h").cast("int")))
    for k in (12, 24):
        was = old.select("unique_id", F.add_months("_ds", k).alias("ds"), F.col("_y").alias(f"_s{k}"))
        rows = rows.join(was, ["unique_id", "ds"], "left").withColumn(f"seasonal{k}", F.coalesce(F.col(f"_s{k}") / F.col("scale"), F.lit(-1.0))).drop(f"_s{k}")
    names = [c for c in base.columns if c not in ("unique_id", "month", "scale")]
    rows = rows.select("unique_id", "month", "ds", "scale", F.col("h").cast("int").alias("ahead"), *names, *horizon_features(F.col("h"), F.col("ds")), "seasonal12", "seasonal24")
    inputs = [*names, "h", "m", "sin_m", "cos_m", "qtr_end", "seasonal12", "seasonal24"]
    rows = checkpointed(rows.select("unique_id", "month", "ds", "scale", "ahead", F.array(*(F.col(c).cast("double") for c in inputs)).alias("x")))
    train = rows.join(old.select("unique_id", F.col("_ds").alias("ds"), "_y"), ["unique_id", "ds"]).select("x", (F.col("_y") / F.col("scale")).alias("y"))
    forest = boosting.fit(train, trees=trees)
    last = rows.join(panel.groupBy("unique_id").agg(F.max("ds").alias("month")), ["unique_id", "month"])
    out = boosting.predict(last, forest, ("mean", "low", "high"))
    mean, low, high = (F.greatest(F.col(c), F.lit(0.0)) * F.col("scale") for c in ("mean", "low", "high"))
    return out.select(
        F.lit("LightGBM").alias("model"), "unique_id", F.col("month").alias("origin"), F.col("ahead").alias("h"), "ds", mean.alias("mean"),
        F.least(low, mean).alias("q10"), mean.alias("q50"), F.greatest(high, mean).alias("q90"),
    )


def backtest_frame(panel: DataFrame, models: tuple[str, ...], horizon: int = HORIZON) -> DataFrame:
    return forecast(panel, models, horizon, first=FIRST)

