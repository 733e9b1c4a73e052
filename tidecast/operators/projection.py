"""Minimum-trace projection of hierarchies of any size, as joins and sums.

Leaves are found by generalised least squares of all nodes' forecasts. The matrix of that problem is never made. With a variance for each node, it is a diagonal for the leaves plus one term for each node above them, so that (by Woodbury's
identity) what has to be solved has the size of the nodes above the leaves alone; its entries are sums over pairs of nodes above a common leaf. Up to ``DENSE`` such nodes it is solved on the driver, beyond that by conjugate gradients whose products are joins with
the table of pairs, with the same result. A covariance with shrunk correlations is a diagonal plus a term for each month of residuals, which is taken in by the same identity: only arrays of months by months come to the driver.

Vectors are arrays, one value for each month (and each value column) to be reconciled, so all of them are solved in the same jobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.sources.tables import checkpointed

DENSE = 2000
#: Conjugate gradients end when the squared residual is so small a share of the first, or after so many rounds.
CLOSE, ROUNDS = 1e-24, 500
FLOOR = 1e-9


def summed(x: str, k: int, by: Column | float = 1.0) -> Column:
    """The sum of arrays of ``k`` numbers, each times ``by``."""
    return F.array(*(F.sum(F.get(x, F.lit(i)) * by) for i in range(k)))


def lined(rows: DataFrame, key: str, at: str, value: str, places: list) -> DataFrame:
    """(key, ``value`` as an array with a number for each of ``places``); gaps are zero."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(key, at).agg(F.sum(value).alias(value)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(at, value))).alias("_m"))
    return each.select(key, F.transform(F.array(*map(F.lit, places)), lambda d: F.coalesce(F.try_element_at("_m", d), F.lit(0.0))).alias(value))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def gram(rows: DataFrame, a: str, b: str, n: int, m: int) -> np.ndarray:
    """The sum over rows of the products of the arrays ``a`` (n) and ``b`` (m); partitions are summed before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, m))
        for batch in batches:
            if batch.num_rows:
                total += _matrix(batch.column(0)).T @ _matrix(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), lists], ["i", "x"])

    got = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b")).mapInArrow(run, "i int, x array<double>").groupBy("i").agg(summed("x", m).alias("x")).collect()
    out = np.zeros((n, m))
    for r in got:
        out[r["i"]] = r["x"]
    return out


# ---------------------------------------------------------------- the nodes above the leaves


def _dense(pairs: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(node, z): the solution by one matrix, for at most ``DENSE`` nodes."""
    rows = right.toPandas()
    at = {x: i for i, x in enumerate(rows["node"])}
    left = np.diag(rows["d"].to_numpy(float))
    entries = pairs.toPandas()
    np.add.at(left, (entries["i"].map(at).to_numpy(int), entries["j"].map(at).to_numpy(int)), entries["w"].to_numpy(float))
    z = np.linalg.solve(left, np.stack(rows["t"]).reshape(len(rows), k))
    return right.sparkSession.createDataFrame([(n, list(map(float, x))) for n, x in zip(rows["node"], z, strict=True)], "node string, z array<double>")


def _gradients(pairs: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(node, z): the solution by conjugate gradients, scaled by the diagonal."""
    pairs = checkpointed(pairs)
    own = pairs.filter("i = j").select(F.col("i").alias("node"), F.col("w").alias("own"))
    times = lambda x, by: F.transform(x, lambda v: v * by)
    dot = lambda s, x, y: np.array(s.agg(F.array(*(F.sum(F.get(x, F.lit(i)) * F.get(y, F.lit(i))) for i in range(k)))).first()[0], float)
    each = lambda v: F.array(*map(F.lit, map(float, v)))
    plus = lambda x, y, by: F.zip_with(x, F.zip_with(y, each(by), lambda a, b: a * b), lambda a, b: a + b)
    s = right.join(own, "node", "left").select("node", "d", (F.col("d") + F.coalesce("own", F.lit(0.0))).alias("m"), times("t", F.lit(0.0)).alias("x"), F.col("t").alias("r"))
    s = checkpointed(s.withColumn("s", times("r", 1 / F.col("m"))).withColumn("p", F.col("s")))
    first, rs = dot(s, "r", "r"), dot(s, "r", "s")
    for _ in range(ROUNDS):
        moved = pairs.join(s.select(F.col("node").alias("j"), "p"), "j").groupBy(F.col("i").alias("node")).agg(summed("p", k, F.col("w")).alias("q"))
        s = checkpointed(s.join(moved, "node", "left").withColumn("q", F.zip_with(F.coalesce("q", times("p", F.lit(0.0))), times("p", F.col("d")), lambda a, b: a + b)))
        pq = dot(s, "p", "q")
        step = np.divide(rs, pq, out=np.zeros(k), where=pq > 0)
        s = s.select("node", "d", "m", plus("x", "p", step).alias("x"), plus("r", "q", -step).alias("r"), "p").withColumn("s", times("r", 1 / F.col("m")))
        s = checkpointed(s)
        now = dot(s, "r", "s")
        turn = np.divide(now, rs, out=np.zeros(k), where=rs > 0)
        s, rs = s.withColumn("p", plus("s", "p", turn)).drop("s"), now
        if (dot(s, "r", "r") <= CLOSE * np.maximum(first, 1e-300)).all():
            break
    return s.select("node", F.col("x").alias("z"))


def solved(leaves: DataFrame, above: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(leaf, x): the inverse of the diagonal problem times the arrays ``x`` of ``leaves`` (leaf, w, x). ``above`` has (node, d), ``links`` (node, leaf) for nodes above leaves."""
    n = above.count()
    plain = F.transform("x", lambda v: v * F.col("w"))
    if not n:
        return leaves.select("leaf", plain.alias("x"))
    t = links.join(leaves, "leaf").groupBy("node").agg(summed("x", k, F.col("w")).alias("t"))
    right = checkpointed(above.join(t, "node").select("node", "d", "t"))
    a, b = links.select(F.col("node").alias("i"), "leaf"), links.select(F.col("node").alias("j"), F.col("leaf").alias("leaf_j"))
    pairs = a.join(b, F.col("leaf") == F.col("leaf_j")).join(leaves.select("leaf", "w"), "leaf").groupBy("i", "j").agg(F.sum("w").alias("w"))
    z = (_dense if n <= DENSE else _gradients)(pairs, right, k)
    down = links.join(z, "node").groupBy("leaf").agg(summed("z", k).alias("u"))
    rest = F.transform(F.zip_with("x", F.coalesce("u", F.transform("x", lambda v: v * 0.0)), lambda p, q: p - q), lambda v: v * F.col("w"))
    return leaves.join(down, "leaf", "left").select("leaf", rest.alias("x"))


# ---------------------------------------------------------------- errors of the nodes


def shrunk(rows: DataFrame, t: int) -> tuple[DataFrame, float]:
    """(node, d, u) of rows (node, e: residuals of ``t`` months): the covariance with shrunk correlations is the diagonal d plus the products of the arrays u; and the intensity of shrinkage."""
    mean = F.aggregate("e", F.lit(0.0), lambda a, v: a + v) / t
    centred = rows.withColumn("_mean", mean).withColumn("e", F.transform("e", lambda v: v - F.col("_mean"))).drop("_mean")
    power = lambda p: F.aggregate("e", F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(p)))
    sized = checkpointed(centred.withColumn("var", power(2) / t).withColumn("scale", F.greatest(F.sqrt("var"), F.lit(1e-6))))
    z = sized.select(F.transform("e", lambda v: v / F.col("scale")).alias("z"))
    months = gram(z, "z", "z", t, t)
    fourth, own = z.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v * v * v)), F.sum(F.pow(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v) / t, F.lit(2)))).first()
    products, correlated = (np.diag(months) ** 2).sum() - fourth, ((months / t) ** 2).sum() - own
    shrink = 1.0 if correlated <= 0 or t < 2 else float(min(max(t / (t - 1) ** 3 * (products / correlated - t), 0.0), 1.0))
    if shrink < 1e-6:
        raise np.linalg.LinAlgError("correlations are not shrunk, so the covariance has no inverse")
    left = (1 - shrink) / t
    return sized.select("node", (F.col("scale") * F.col("scale") - (1 - shrink) * F.col("var")).alias("d"), F.transform("e", lambda v: v * float(np.sqrt(left))).alias("u")), shrink


def variances(nodes: DataFrame, up: DataFrame, resid: DataFrame | None, method: str) -> tuple[DataFrame, int]:
    """(node, d, u) and the length of u (0 but for shrunk covariances)."""
    none = F.array().cast("array<double>").alias("u")
    if method == "ols":
        return nodes.select("node", F.lit(1.0).alias("d"), none), 0
    if method == "wls_struct":
        return up.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("d")).select("node", "d", none), 0
    if resid is None:
        raise np.linalg.LinAlgError("there are no residuals")
    months = [r[0] for r in resid.filter("resid is not null").select("ds").distinct().orderBy("ds").collect()]
    if not months:
        raise np.linalg.LinAlgError("there are no residuals")
    each = lined(resid.select(F.col("unique_id").alias("node"), "ds", F.col("resid").cast("double").alias("resid")), "node", "ds", "resid", months)
    empty = F.array_repeat(F.lit(0.0), len(months))
    rows = nodes.join(each, "node", "left").select("node", F.coalesce("resid", empty).alias("e"))
    if method == "wls_var":
        square = F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v) / len(months)
        return rows.select("node", F.greatest(square, F.lit(FLOOR)).alias("d"), none), 0
    return shrunk(rows, len(months))[0], len(months)


def leaf_values(y: DataFrame, up: DataFrame, errors: DataFrame, k: int, t: int) -> DataFrame:
    """(leaf, b): the leaves that fit the arrays ``y`` of all nodes (node, y) best under ``errors`` (node, d, u)."""
    base = checkpointed(errors.join(y, "node", "left").select("node", "d", "u", F.coalesce("y", F.array_repeat(F.lit(0.0), k)).alias("y")))
    both = base.select("node", F.transform(F.concat("y", "u"), lambda v: v / F.col("d")).alias("x"))
    own = base.select(F.col("node").alias("leaf"), F.col("d").alias("w"))
    leaves = checkpointed(up.join(both, "node").groupBy("leaf").agg(summed("x", k + t).alias("x")).join(own, "leaf").select("leaf", "w", "x"))
    links = up.filter("node <> leaf")
    above = base.join(links.select("node").distinct(), "node").select("node", "d")
    out = checkpointed(leaves.select("leaf", F.col("x").alias("given")).join(solved(leaves, above, links, k + t), "leaf"))
    if not t:
        return out.select("leaf", F.col("x").alias("b"))
    part = lambda c, i, n: F.slice(c, i + 1, n)
    weighed = base.select("u", "y", F.transform("u", lambda v: v / F.col("d")).alias("v"))
    inner = np.eye(t) + gram(weighed, "v", "u", t, t)
    g = gram(weighed, "v", "y", t, k)
    across = gram(out.select(part("given", k, t).alias("a"), "x"), "a", "x", t, k + t)
    va, vc = across[:, :k], across[:, k:]
    back = np.linalg.solve(inner, g)
    q = np.linalg.solve(inner - vc, va - vc @ back) - back
    if not np.isfinite(q).all():
        raise np.linalg.LinAlgError("numbers are not finite")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                b = x[:, :k] + x[:, k:] @ q
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), pa.array(b.ravel()))], ["leaf", "b"])

    return out.select("leaf", "x").mapInArrow(run, "leaf string, b array<double>")


def projected(forecasts: DataFrame, up: DataFrame, resid: DataFrame | None, method: str, values: tuple[str, ...]) -> DataFrame:
    """unique_id, ds, values of all nodes of ``up`` (node, leaf; each leaf under itself too), coherent, with leaves cut at zero. Nodes and months without a forecast count as zero."""
    months = [r[0] for r in forecasts.select("ds").distinct().orderBy("ds").collect()]
    if not months:
        return forecasts.select("unique_id", "ds", *(F.col(v).cast("double").alias(v) for v in values))
    up = checkpointed(up.select("node", "leaf").distinct())
    nodes = up.select("node").distinct()
    y = nodes
    for v in values:
        y = y.join(lined(forecasts.select(F.col("unique_id").alias("node"), "ds", F.col(v).cast("double").alias(v)), "node", "ds", v, months), "node", "left")
    empty = F.array_repeat(F.lit(0.0), len(months))
    y = y.select("node", F.concat(*(F.coalesce(v, empty) for v in values)).alias("y"))
    k = len(months) * len(values)
    errors, t = variances(nodes, up, resid, method)
    b = leaf_values(y, up, errors, k, t).select("leaf", F.transform("b", lambda v: F.greatest(v, F.lit(0.0))).alias("b"))
    out = up.join(b, "leaf").groupBy(F.col("node").alias("unique_id")).agg(summed("b", k).alias("b"))
    each = F.array(*(F.struct(F.lit(d).alias("ds"), *(F.get("b", F.lit(j * len(months) + i)).alias(v) for j, v in enumerate(values))) for i, d in enumerate(months)))
    return out.select("unique_id", F.explode(each).alias("e")).select("unique_id", "e.*")
