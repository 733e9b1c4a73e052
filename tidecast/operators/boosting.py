"""Boosted regression trees for the mean and for quantiles, grown level by level from histograms.

Features are cut into bins at approximate quantiles, once; the binned rows are written to the shared folder. For each level of a tree one job adds up, in each partition, the gradients of every target by node, feature and bin; the partitions' histograms are
summed by Spark, and the best cut of each node is read off them: what comes to the driver is bounded by targets, nodes, features and bins, not by rows. Targets (the squared loss, and the pinball loss of each quantile) grow side by side in the same jobs.
A leaf of the squared loss holds the mean of the residuals, one of a quantile their quantile. Predictions are computed anew from the trees so far, so no state is kept between jobs and a lost executor costs its tasks only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.sources.tables import checkpointed

BINS, DEPTH, TREES, RATE, LEAST = 32, 3, 30, 0.15, 20
MEAN = "mean"
Target = str | float


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i+1 and 2i+2): the feature that cuts a node (-1: none), the last bin that goes left, and values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row of ``bins`` (rows x features) after so many levels; a node without a cut keeps its rows."""
        at = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class Forest:
    edges: list[np.ndarray]
    targets: tuple[Target, ...]
    base: dict[Target, float]
    rate: float = RATE
    depth: int = DEPTH
    trees: dict[Target, list[Tree]] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of features (rows x features); what is not a number goes to the first."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def predict(self, target: Target, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base[target])
        for t in self.trees[target]:
            out += self.rate * t.value[t.leaves(bins, self.depth)]
        return out


def gradient(target: Target, residual: np.ndarray) -> np.ndarray:
    """What each row pulls its prediction by: the residual, or for a quantile q either q or q - 1."""
    return residual if target == MEAN else np.where(residual > 0, target, target - 1.0)


def best_cut(sums: np.ndarray, counts: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, last bin that goes left) of a node from histograms (features x bins); ties to the first feature and bin. A gain of 0 is no cut."""
    left, n_left = sums.cumsum(axis=1)[:, :-1], counts.cumsum(axis=1)[:, :-1]
    total, n = sums.sum(axis=1)[:, None], counts.sum(axis=1)[:, None]
    n_right = n - n_left
    with np.errstate(all="ignore"):
        gain = left**2 / n_left + (total - left) ** 2 / n_right - total**2 / n
    gain = np.where((n_left >= least) & (n_right >= least), gain, 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-12 else (0.0, -1, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _bins(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def _histograms(rows: DataFrame, forest: Forest, growing: dict[Target, Tree], level: int) -> DataFrame:
    """(target, node, feature, bin, g, n) of the nodes of a level."""
    features, width = len(forest.edges), max(len(e) for e in forest.edges) + 1
    first = (1 << level) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(forest.targets), 1 << level, features, width)
        g, n = np.zeros(shape), np.zeros(shape, np.int64)
        for batch in batches:
            bins, y = _bins(batch.column(0), features), batch.column(1).to_numpy()
            for k, target in enumerate(forest.targets):
                pull = gradient(target, y - forest.predict(target, bins))
                at = growing[target].leaves(bins, level) - first
                on = np.flatnonzero(at >= 0)  # others ended above this level
                spot = (at[on, None] * features + np.arange(features)) * width + bins[on]
                size = (1 << level) * features * width
                g[k] += np.bincount(spot.ravel(), np.repeat(pull[on], features), size).reshape(shape[1:])
                n[k] += np.bincount(spot.ravel(), minlength=size).reshape(shape[1:])
        at = np.nonzero(n)
        names = ["target", "node", "feature", "bin", "g", "n"]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in at), pa.array(g[at]), pa.array(n[at])], names)

    each = rows.mapInArrow(run, "target int, node int, feature int, bin int, g double, n long")
    return each.groupBy("target", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _leaf_values(rows: DataFrame, forest: Forest, growing: dict[Target, Tree]) -> list:
    """(target, leaf, mean residual, quantiles of the residuals) of the leaves; partial sums and sketches are made before the shuffle."""
    features = len(forest.edges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = _bins(batch.column(0), features), batch.column(1).to_numpy()
            for k, target in enumerate(forest.targets):
                residual = y - forest.predict(target, bins)
                leaf = growing[target].leaves(bins, forest.depth).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(leaf), pa.array(residual)], ["target", "leaf", "r"])

    each = rows.mapInArrow(run, "target int, leaf int, r double").groupBy("target", "leaf")
    quantiles = [float(t) for t in forest.targets if t != MEAN]
    return each.agg(F.avg("r").alias("mean"), F.percentile_approx("r", quantiles or [0.5], 1000).alias("q")).collect()


def fit(rows: DataFrame, targets: tuple[Target, ...] = (MEAN, 0.1, 0.9), trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST) -> Forest:
    """Grows a forest for each target on ``rows`` (x: array of features, y); rows without y are left out."""
    rows = rows.filter("y is not null").select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    width = len((rows.select("x").first() or [[]])[0])
    quantiles = [float(t) for t in targets if t != MEAN]
    cuts = rows.agg(*(F.percentile_approx(F.get("x", F.lit(i)), [k / bins for k in range(1, bins)], 1000).alias(f"c{i}") for i in range(width)), F.avg("y").alias("mean"), F.percentile_approx("y", quantiles or [0.5], 1000).alias("q")).first()
    edges = [np.unique(np.array(cuts[f"c{i}"] or [], float)) for i in range(width)]
    base = {t: 0.0 if cuts["mean"] is None else cuts["mean"] if t == MEAN else cuts["q"][quantiles.index(float(t))] for t in targets}
    forest = Forest(edges, targets, base, rate, depth, {t: [] for t in targets})
    if not width or cuts["mean"] is None:
        return forest

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in forest.binned(_matrix(batch.column(0)))], pa.binary()), batch.column(1)], ["bins", "y"])

    table = checkpointed(rows.mapInArrow(cut_up, "bins binary, y double"))
    order = list(targets)
    for _ in range(trees):
        growing = {t: Tree.empty(depth) for t in targets}
        for level in range(depth):
            found = _histograms(table, forest, growing, level).toPandas()
            if not len(found):
                break
            shape = (len(order), 1 << level, width, max(len(e) for e in edges) + 1)
            g, n = np.zeros(shape), np.zeros(shape, np.int64)
            at = tuple(found[c].to_numpy() for c in ("target", "node", "feature", "bin"))
            g[at], n[at] = found["g"], found["n"]
            for k, t in enumerate(order):
                for node in range(1 << level):
                    _, feature, cut = best_cut(g[k, node], n[k, node], least)
                    growing[t].feature[(1 << level) - 1 + node], growing[t].cut[(1 << level) - 1 + node] = feature, cut
        for r in _leaf_values(table, forest, growing):
            t = order[r["target"]]
            growing[t].value[r["leaf"]] = r["mean"] if t == MEAN else r["q"][quantiles.index(float(t))]
        for t in targets:
            forest.trees[t].append(growing[t])
    return forest


def predict(rows: DataFrame, forest: Forest, names: tuple[str, ...]) -> DataFrame:
    """``rows`` without their features ``x``, with a column for each target."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = forest.binned(_matrix(batch.column(len(kept))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(forest.predict(t, bins)) for t in forest.targets)], [*kept, *names])

    given = rows.select(*kept, F.col("x").cast("array<double>").alias("x"))
    return given.mapInArrow(run, given.select(*kept, *(F.lit(0.0).alias(c) for c in names)).schema)
