"""Seasonal autoregression with moving terms by exact Gaussian likelihood, with orders found step by step.

The likelihood is that of the prediction errors: the autocovariances of a set of coefficients are solved for exactly, and the Durbin-Levinson recursion turns them into one-step predictions and their variances, for all series and all
candidates of a batch at once. Coefficients are bounded by partial autocorrelations, so every model is stationary and invertible. The search over orders begins at four models and moves to the best neighbour by the corrected
information criterion, until no series of the batch improves."""

from __future__ import annotations

import numpy as np

from tidecast.functions.simplex import minimise

Fit = tuple[np.ndarray, np.ndarray | None, np.ndarray]
Order = tuple[int, int, int, int]  # p, q, seasonal p, seasonal q
MOST: Order = (2, 2, 1, 1)
STARTS: list[Order] = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)]
ROUNDS = 40


# ---------------------------------------------------------------- coefficients


def _bounded(u: np.ndarray) -> np.ndarray:
    """Coefficients (..., at most 2) of a stationary polynomial from unbounded numbers."""
    r = 0.99 * np.tanh(u)
    return r if u.shape[-1] < 2 else np.stack([r[..., 0] * (1 - r[..., 1]), r[..., 1]], axis=-1)


def _product(short: np.ndarray, long: np.ndarray, season: int) -> np.ndarray:
    """The coefficients after the first of (1 + short B + ...)(1 + long B**season)."""
    p, s = short.shape[-1], long.shape[-1]
    out = np.zeros((*short.shape[:-1], p + season * s))
    out[..., :p] += short
    if s:
        out[..., season - 1] += long[..., 0]
        out[..., season : season + p] += long * short
    return out


def coefficients(u: np.ndarray, order: Order, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive and moving coefficients (x_t = sum ar x + e + sum ma e)."""
    p, q, sp, sq = order
    cut = np.cumsum([p, q, sp, sq])[:-1]
    a, m, sa, sm = np.split(u, cut, axis=-1)
    return -_product(-_bounded(a), -_bounded(sa), season), _product(-_bounded(m), -_bounded(sm), season)


def autocovariances(ar: np.ndarray, ma: np.ndarray, n: int) -> np.ndarray:
    """Autocovariances at lags 0 to n - 1 for innovations of variance 1; the first axis is the batch."""
    batch, p, q = len(ar), ar.shape[1], ma.shape[1]
    b = np.concatenate([np.ones((batch, 1)), ma], axis=1)
    psi = np.zeros((batch, q + 1))
    for j in range(q + 1):
        psi[:, j] = b[:, j] + sum(ar[:, i] * psi[:, j - i - 1] for i in range(min(j, p)))
    right = np.zeros((batch, max(p, q, n) + 1))
    for k in range(q + 1):
        right[:, k] = (b[:, k:] * psi[:, : q + 1 - k]).sum(axis=1)
    left = np.zeros((batch, p + 1, p + 1)) + np.eye(p + 1)
    for k in range(p + 1):
        for i in range(1, p + 1):
            left[:, k, abs(k - i)] -= ar[:, i - 1]
    out = np.zeros((batch, max(n, p + 1)))
    out[:, : p + 1] = np.linalg.solve(left, right[:, : p + 1, None])[:, :, 0]
    lags = [i for i in range(p) if np.any(ar[:, i])]
    for k in range(p + 1, n):
        out[:, k] = right[:, k] + sum(ar[:, i] * out[:, k - i - 1] for i in lags)
    return out[:, :n]


def predictions(x: np.ndarray, gamma: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of rows ``x`` and their variances (batch x months), by the Durbin-Levinson recursion. With ``n`` a row takes no part after its ``n`` months: its errors are 0 there, its variances 1."""
    batch, months = gamma.shape
    order = np.argsort(-n, kind="stable") if n is not None else np.arange(batch)
    going = (n[:, None] > np.arange(months)[None]).sum(axis=0) if n is not None else np.full(months, batch)
    x, gamma = x[order], gamma[order]
    errors, variances = np.zeros((batch, months)), np.ones((batch, months))
    errors[:, 0], variances[:, 0] = x[:, 0], gamma[:, 0]
    phi = np.zeros((batch, 0))
    for t in range(1, months):
        c = going[t]  # the longest rows come first
        if not c:
            break
        phi, v = phi[:c], variances[:c, t - 1]
        k = (gamma[:c, t] - np.einsum("bi,bi->b", phi, gamma[:c, t - 1 : 0 : -1])) / v
        new = np.empty((c, t))
        np.multiply(k[:, None], phi[:, ::-1], out=new[:, :-1])
        np.subtract(phi, new[:, :-1], out=new[:, :-1])
        new[:, -1] = k
        phi = new
        variances[:c, t] = v * (1 - k * k)
        errors[:c, t] = x[:c, t] - np.einsum("bi,bi->b", phi, x[:c, t - 1 :: -1])
    back = np.empty(batch, int)
    back[order] = np.arange(batch)
    return errors[back], variances[back]


def deviance(x: np.ndarray, n: np.ndarray, u: np.ndarray, order: Order, season: int) -> np.ndarray:
    """-2 log likelihood, but for a constant, with the variance at its best: of rows ``x`` (padded; ``n`` months each) under candidates ``u`` (rows x candidates x parameters)."""
    rows, k = u.shape[:2]
    ar, ma = coefficients(u.reshape(rows * k, -1), order, season)
    months = x.shape[1]
    errors, variances = predictions(np.repeat(x, k, axis=0), autocovariances(ar, ma, months), np.repeat(n, k))
    on = np.arange(months)[None] < np.repeat(n, k)[:, None]
    square = np.where(on, errors**2 / variances, 0.0).sum(axis=1) / np.repeat(n, k)
    logs = np.where(on, np.log(variances), 0.0).sum(axis=1)
    return (np.repeat(n, k) * np.log(np.maximum(square, 1e-18)) + logs).reshape(rows, k)


# ---------------------------------------------------------------- search


def neighbours(order: Order) -> list[Order]:
    """Orders one step away: one of the four, both of the months, or both of the season."""
    steps = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1), (1, -1, 0, 0)]
    out = [tuple(o + s * d for o, d in zip(order, step, strict=True)) for step in steps for s in (1, -1)]
    return [o for o in out if all(0 <= v <= most for v, most in zip(o, MOST, strict=True))]


def differenced(y: np.ndarray, season: int) -> tuple[np.ndarray, list[int]]:
    """Differences over a season and over a month where they lower the spread, and which were taken."""
    x, undo = y, []
    if season > 1 and len(y) > 2 * season + 6 and np.var(x[season:] - x[:-season]) < 0.7 * np.var(x):
        undo.append(season)
        x = x[season:] - x[:-season]
    if len(x) > 8 and np.var(np.diff(x)) < 0.9 * np.var(x):
        undo.append(1)
        x = np.diff(x)
    return x, undo


def search(series: list[np.ndarray], season: int, means: list[bool]) -> list[tuple[Order, np.ndarray, float]]:
    """Of each (differenced, centred) series its order, parameters and criterion. ``means`` tells which had a mean taken off, which counts as a parameter."""
    n = np.array([len(x) for x in series])
    padded = np.stack([np.r_[x, np.zeros(n.max() - len(x))] for x in series])
    unit = np.maximum(np.abs(padded).max(axis=1, keepdims=True), 1e-12)
    padded = padded / unit
    extra = np.array(means, int) + 1
    seasonal = n >= 2 * season if season > 1 else np.zeros(len(n), bool)
    best: list = [None] * len(series)
    tried: list[set[Order]] = [set() for _ in series]
    wanted: dict[Order, list[int]] = {}
    for i in range(len(series)):
        for o in STARTS:
            wanted.setdefault(o if seasonal[i] else (o[0], o[1], 0, 0), []).append(i)
    while wanted:
        improved = set()
        for order, rows in wanted.items():
            k = sum(order)
            rows = np.array(sorted({r for r in rows if order not in tried[r] and n[r] - (k + extra[r]) - 1 > 0}), int)
            for r in rows.tolist():
                tried[r].add(order)
            if not len(rows):
                continue
            with np.errstate(all="ignore"):
                u, value = minimise(lambda at, u, rows=rows, order=order: deviance(padded[rows[at]], n[rows[at]], u, order, season), np.zeros((len(rows), k)) + 0.1, rounds=ROUNDS, tolerance=1e-4)
            c = k + extra[rows]
            score = value + 2 * c + 2 * c * (c + 1) / (n[rows] - c - 1)
            for i, r in enumerate(rows.tolist()):
                if np.isfinite(score[i]) and (best[r] is None or score[i] < best[r][2] - 1e-9):
                    best[r] = (order, u[i], float(score[i]))
                    improved.add(r)
        wanted = {}
        for r in improved:
            for o in neighbours(best[r][0]):
                if o not in tried[r] and (seasonal[r] or o[2:] == (0, 0)):
                    wanted.setdefault(o, []).append(r)
    return best


def ahead(y: np.ndarray, x: np.ndarray, undo: list[int], mean: float, order: Order, u: np.ndarray, horizon: int, season: int) -> Fit:
    """Means, spreads and one-step values of ``y``, whose differences ``x`` have been fitted."""
    ar, ma = (c[0] for c in coefficients(u[None], order, season))
    errors, variances = (v[0] for v in predictions((x - mean)[None], autocovariances(ar[None], ma[None], len(x))))
    sigma = np.sqrt((errors**2 / variances).mean())
    path, noise = list(x - mean), list(errors)
    for _ in range(horizon):
        path.append(sum(a * path[-i] for i, a in enumerate(ar, 1) if i <= len(path)) + sum(b * noise[-i] for i, b in enumerate(ma, 1) if i <= len(noise)))
        noise.append(0.0)
    out = mean + np.array(path[len(x) :])
    psi = np.zeros(horizon)
    for h in range(horizon):
        psi[h] = (1.0 if h == 0 else ma[h - 1] if h <= len(ma) else 0.0) + sum(a * psi[h - i] for i, a in enumerate(ar, 1) if i <= h)
    for k in reversed(undo):
        base = y[season:] - y[:-season] if k == 1 and season in undo else y
        if k == 1:
            out, psi = base[-1] + np.cumsum(out), np.cumsum(psi)
        else:
            for h in range(horizon):
                out[h] += base[len(base) - k + h] if h < k else out[h - k]
                psi[h] += psi[h - k] if h >= k else 0.0
    fitted = np.full(len(y), np.nan)
    fitted[len(y) - len(x) :] = y[len(y) - len(x) :] - errors
    return out, sigma * np.sqrt(np.cumsum(psi**2)), fitted


def chosen(series: list[np.ndarray], horizon: int, season: int = 12) -> list[tuple[Order, float, Fit] | None]:
    """Of each series its order, criterion and forecast; None where it is too short or does not change."""
    rows, centred, parts = [], [], []
    for r, y in enumerate(series):
        x, undo = differenced(np.asarray(y, float), season)
        mean = float(x.mean()) if len(undo) < 2 else 0.0
        if len(x) >= 4 and np.ptp(x) > 0:
            rows.append(r)
            centred.append(x - mean)
            parts.append((x, undo, mean))
    out: list = [None] * len(series)
    if rows:
        for r, (x, undo, mean), found in zip(rows, parts, search(centred, season, [len(p[1]) < 2 for p in parts]), strict=True):
            if found is not None:
                fit = ahead(np.asarray(series[r], float), x, undo, mean, found[0], found[1], horizon, season)
                if np.isfinite(fit[0]).all() and np.isfinite(fit[1]).all():
                    out[r] = (found[0], found[2], fit)
    return out
