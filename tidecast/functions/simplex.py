"""Simplex search for many small problems at once, in numpy: each row of a batch is a problem of its own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, size: float = 0.5, rounds: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The lowest points found from ``start`` (problems x parameters), and the values there.

    ``f(rows, x)`` takes the problems' numbers and points (problems x points x parameters), and gives values (problems x points); what is not a number counts as infinite. A problem whose
    values are within ``tolerance`` of each other is left alone from then on. The starting point is never left for a worse one."""
    n, p = start.shape

    def value(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = f(rows, x)
        return np.where(np.isnan(v), np.inf, v)

    every = np.arange(n)
    x = np.concatenate([start[:, None, :], start[:, None, :] + size * np.eye(p)[None]], axis=1)
    v = value(every, x)
    for _ in range(rounds if p else 0):
        order = np.argsort(v, axis=1, kind="stable")
        x, v = np.take_along_axis(x, order[:, :, None], 1), np.take_along_axis(v, order, 1)
        with np.errstate(invalid="ignore"):
            spread = np.where(np.isfinite(v[:, -1]), v[:, -1] - v[:, 0], np.inf)
        rows = np.flatnonzero(np.isfinite(v[:, 0]) & (spread > tolerance))
        if not len(rows):
            break
        middle, worst = x[rows, :-1].mean(axis=1), x[rows, -1]
        # reflected, expanded, contracted outside and inside: all four are tried in one call
        tried = np.stack([middle + k * (middle - worst) for k in (1.0, 2.0, 0.5, -0.5)], axis=1)
        got = value(rows, tried)
        best, second, last = v[rows, 0], v[rows, -2], v[rows, -1]
        reflected, expanded, outside, inside = got.T
        pick = np.where(reflected < best, np.where(expanded < reflected, 1, 0), np.where(reflected < second, 0, np.where(reflected < last, 2, 3)))
        chosen = got[np.arange(len(rows)), pick]
        good = np.where(pick == 2, outside <= reflected, np.where(pick == 3, inside < last, True))
        hit = rows[good]
        x[hit, -1], v[hit, -1] = tried[np.flatnonzero(good), pick[good]], chosen[good]
        if len(rest := rows[~good]):  # towards the best
            x[rest, 1:] = (x[rest, 1:] + x[rest, :1]) / 2
            v[rest, 1:] = value(rest, x[rest, 1:])
    k = v.argmin(axis=1)
    return x[every, k], v[every, k]
