"""Exponential smoothing by maximum likelihood: error, trend and season each in several forms, chosen by the corrected information criterion.

All series of a batch are fitted together: a walk over the months carries every series and every candidate along as arrays, and the parameters (smoothing weights, damping, first level and slope) are found by a simplex
search of all series at once, which begins at the best of a grid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidecast.functions.simplex import minimise

Fit = tuple[np.ndarray, np.ndarray | None, np.ndarray]
ROUNDS = 40
#: (error, trend, season): additive errors with multiplicative seasons are left out, since their variance is not bounded.
FORMS = [(e, t, s) for e in "AM" for t in ("N", "A", "Ad") for s in "NAM" if (e, s) != ("A", "M")]


@dataclass
class Batch:
    """Series side by side: ``y`` padded with their last value, ``n`` months each, and the states to start from."""

    y: np.ndarray
    n: np.ndarray
    season: int

    @classmethod
    def of(cls, series: list[np.ndarray], season: int) -> Batch:
        n = np.array([len(y) for y in series])
        return cls(np.stack([np.r_[y, np.full(n.max() - len(y), y[-1])] for y in series]).astype(float), n, season)

    def only(self, rows: np.ndarray) -> Batch:
        return Batch(self.y[rows], self.n[rows], self.season)

    def begin(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First level, slope and cycle by the first two years, or the first months without a season."""
        m = self.season if kind != "N" else 1
        y = self.y
        first, second = (y[:, k * m : (k + 1) * m] for k in (0, 1))
        if kind == "N":
            cycle = np.zeros((len(y), 1))
        elif kind == "A":
            cycle = ((first - first.mean(axis=1, keepdims=True)) + (second - second.mean(axis=1, keepdims=True))) / 2
        else:
            cycle = (first / np.maximum(first.mean(axis=1, keepdims=True), 1e-12) + second / np.maximum(second.mean(axis=1, keepdims=True), 1e-12)) / 2
            cycle = np.maximum(cycle, 1e-3)
        head = y[:, : max(m, 6)]
        turn = np.arange(head.shape[1]) % m
        head = head / cycle[:, turn] if kind == "M" else head - cycle[:, turn]
        return head.mean(axis=1), (y[:, min(5, y.shape[1] - 1)] - y[:, 0]) / 5, cycle


def _weights(form: tuple[str, str, str], u: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothing weights of unbounded parameters, in the order level, slope, damping, season, first level, first slope (those that the form has)."""
    squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    take = iter(np.moveaxis(u, -1, 0))
    alpha = 1e-4 + 0.9998 * squash(next(take))
    out = {"alpha": alpha, "beta": 0.0, "phi": 1.0 if form[1] == "A" else 0.0, "gamma": 0.0, "slope": 0.0}
    if form[1] != "N":
        out["beta"] = alpha * squash(next(take))
    if form[1] == "Ad":
        out["phi"] = 0.8 + 0.18 * squash(next(take))
    if form[2] != "N":
        out["gamma"] = (1 - alpha) * squash(next(take))
    out["level"] = next(take)
    if form[1] != "N":
        out["slope"] = next(take)
    return out


def n_weights(form: tuple[str, str, str]) -> int:
    return 2 + 2 * (form[1] != "N") + (form[1] == "Ad") + (form[2] != "N")


def n_parameters(form: tuple[str, str, str], season: int) -> int:
    """With the variance and the season's first states."""
    return n_weights(form) + 1 + (season - 1 if form[2] != "N" else 0)


def walk(batch: Batch, form: tuple[str, str, str], u: np.ndarray) -> dict[str, np.ndarray]:
    """Walks all series (first axis) under all candidates (second axis of ``u``): ``score`` is -2 log likelihood but for a constant, with states, errors and one-step values."""
    error, trend, kind = form
    y, n = batch.y, batch.n
    m = batch.season if kind != "N" else 1
    level, slope, cycle = batch.begin(kind)
    w = _weights(form, u)
    unit = np.maximum(np.where(np.arange(y.shape[1])[None] < n[:, None], np.abs(y), 0.0).sum(axis=1) / n, 1e-9)[:, None]
    shape = u.shape[:2]
    level = np.broadcast_to(level[:, None], shape) + w["level"] * unit * 0.1
    slope = np.broadcast_to(slope[:, None], shape) + w["slope"] * unit * 0.01 if trend != "N" else np.zeros(shape)
    cycle = np.repeat(cycle[:, None, :], shape[1], axis=1)
    square, logs = np.zeros(shape), np.zeros(shape)
    fitted = np.empty((y.shape[1], *shape))
    even = int(n.min())
    for t in range(y.shape[1]):
        s = cycle[:, :, t % m]
        base = level + w["phi"] * slope
        f = base * s if kind == "M" else base + s
        fitted[t] = f
        e = y[:, t, None] - f
        size = np.maximum(f, 1e-9 * unit) if error == "M" else 1.0
        new_square = square + (e / size) ** 2
        by = np.maximum(s, 1e-3) if kind == "M" else 1.0
        new = base + w["alpha"] * e / by, w["phi"] * slope + w["beta"] * e / by
        turned = s + w["gamma"] * (e / np.maximum(base, 1e-9 * unit) if kind == "M" else e) if kind != "N" else s
        new_logs = logs + np.log(size) if error == "M" else logs
        if t >= even:  # series that have ended keep their states
            on = (t < n)[:, None]
            new = np.where(on, new[0], level), np.where(on, new[1], slope)
            turned, new_square, new_logs = np.where(on, turned, s), np.where(on, new_square, square), np.where(on, new_logs, logs)
        level, slope = new
        cycle[:, :, t % m] = turned
        square, logs = new_square, new_logs
    count = n[:, None]
    # a spread of nothing would win against all: errors count as a billionth of the series' size at least
    floor = 1e-18 if error == "M" else 1e-18 * unit**2
    score = count * np.log(np.maximum(square / count, floor)) + 2 * logs
    return {**w, "score": score, "level": level, "slope": slope, "cycle": cycle, "square": square, "fitted": fitted}


def grid(form: tuple[str, str, str]) -> np.ndarray:
    """Unbounded parameters to begin from, a row each."""
    back = lambda p: np.log(p / (1 - p))
    rows = []
    for a in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.75, 0.95):
        for b in (0.01, 0.1, 0.3) if form[1] != "N" else (None,):
            for phi in (0.85, 0.95) if form[1] == "Ad" else (None,):
                for g in (0.01, 0.1, 0.3) if form[2] != "N" else (None,):
                    rows.append([back((a - 1e-4) / 0.9998), *([back(b)] if b else []), *([back((phi - 0.8) / 0.18)] if phi else []), *([back(g)] if g else []), 0.0, *([0.0] if b else [])])
    return np.array(rows)


def able(batch: Batch, form: tuple[str, str, str]) -> np.ndarray:
    """Series that a form can be fitted to: long enough, and above zero where something is multiplied."""
    k = n_parameters(form, batch.season)
    out = (batch.n - k - 1 > 0) & (batch.n >= 6)
    if form[2] != "N":
        out &= (batch.n >= 2 * batch.season + 2) & (batch.season > 1)
    if "M" in (form[0], form[2]):
        inside = np.arange(batch.y.shape[1])[None] < batch.n[:, None]
        out &= np.where(inside, batch.y, 1.0).min(axis=1) > 0
    return out


def fit_form(batch: Batch, form: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The best parameters of a form for each series, and the scores there."""
    starts = grid(form)
    n = len(batch.y)
    scores = walk(batch, form, np.broadcast_to(starts, (n, *starts.shape)))["score"]
    start = starts[np.where(np.isnan(scores), np.inf, scores).argmin(axis=1)]
    return minimise(lambda rows, x: walk(batch.only(rows), form, x)["score"], start, rounds=ROUNDS)


def ahead(form: tuple[str, str, str], got: dict[str, np.ndarray], i: int, n: int, horizon: int, season: int) -> Fit:
    """Means, spreads and one-step values of series ``i`` of a walk with one candidate."""
    at = lambda name: float(got[name][i, 0]) if np.ndim(got[name]) else float(got[name])
    h = np.arange(1, horizon + 1)
    phi, alpha, beta, gamma = at("phi"), at("alpha"), at("beta"), at("gamma")
    damp = np.cumsum(phi**h) if form[1] != "N" else np.zeros(horizon)
    mean = at("level") + at("slope") * damp
    m = season if form[2] != "N" else 1
    if form[2] != "N":
        turn = got["cycle"][i, 0, (n + h - 1) % m]
        mean = mean * turn if form[2] == "M" else mean + turn
    w = alpha + beta * damp + (gamma * (h % m == 0) if form[2] != "N" else 0.0)
    w = np.broadcast_to(w, (horizon,))
    sigma = np.sqrt(at("square") / max(n - 1, 1)) * np.sqrt(1 + np.r_[0.0, np.cumsum(w**2)[:-1]])
    return mean, sigma * np.abs(mean) if form[0] == "M" else sigma, got["fitted"][:n, i, 0]


def chosen(series: list[np.ndarray], horizon: int, season: int = 12) -> list[tuple[tuple[str, str, str], float, Fit] | None]:
    """Of each series its form, criterion and forecast; None where no form can be fitted."""
    out: list = [None] * len(series)
    if not series:
        return out
    whole = Batch.of(series, season)
    for form in FORMS:
        rows = np.flatnonzero(able(whole, form))
        if not len(rows):
            continue
        batch = whole.only(rows)
        with np.errstate(all="ignore"):
            u, score = fit_form(batch, form)
            got = walk(batch, form, u[:, None, :])
        k = n_parameters(form, season)
        n = batch.n
        score = score + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        for i, r in enumerate(rows.tolist()):
            if np.isfinite(score[i]) and (out[r] is None or score[i] < out[r][1]):
                fit = ahead(form, got, i, int(n[i]), horizon, season)
                if np.isfinite(fit[0]).all() and np.isfinite(fit[1]).all():
                    out[r] = (form, float(score[i]), fit)
    return out
