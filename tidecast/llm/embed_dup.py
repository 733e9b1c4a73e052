"""Operator 11: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Two vectors link if their cosine, in double precision, is ``threshold`` or more.

1. *Codes.* On a bounded sample (``SAMPLE`` vectors of the smallest hashes) the principal axes are found and a rotation is learned that brings the
   rotated vectors close to the corners of a cube (iterative quantisation: signs and the orthogonal Procrustes rotation in turn), so that bits are balanced. The signs are a vector's code.
2. *Tables.* A code is cut into tables of about log2(n) bits. Each vector stands in a table under its own bits and under all codes one bit away, so that two vectors meet
   if a table's bits differ in at most two places. Pairs at exactly the threshold, made from the sample, tell how many tables (and further rotations) are needed for ``RECALL`` of such pairs.
   Those that meet count as candidates if their whole codes differ in few enough bits.
3. *Cells.* Each vector is first compared with one leader of each of its buckets. Leaders gather groups; a member stays in its group's cell if it lies within half of the threshold's angle of the
   group's mean direction, so all members of a cell link with each other and need no comparison. A group of near copies of any size thus costs its size. All others are cells by themselves.
4. *Reranking.* Cells that meet in a table are compared by their centres' original vectors; by the triangle inequality of angles, all, none or some of their members link. Where some do, members are compared with the other
   cell's centre, and what is still open, member by member in blocks, as matrix products that give counts and not pairs. Equal vectors are one vector with a weight throughout.

Results: one row per input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. Vectors that are null, empty, zero, or hold
null or non-finite components have no links and are their own component. Vectors of different lengths never link. Rows with one vec_id count as rows of their own; a null vec_id takes part, and its component is the
smallest id that there is (null, and kept, if there is none). An empty table gives an empty table. Further columns are not kept, whatever their names.
Every link given has been verified or follows from the triangle inequality with a margin; a pair that meets in no table is missed (measured by the tests). Tables that later steps need are written to the shared folder; only the sample comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch
from tidecast.llm.near_dup import connected

THRESHOLD = 0.95
#: Vectors that the rotation is learned from, at most, and rounds of learning.
SAMPLE, ROUNDS = 10_000, 50
#: Share of pairs at the threshold that must meet, as measured on the sample; tables at most, whatever the share.
RECALL, TABLES = 0.99, 48
#: Bits of a table, at least.
LEAST_BITS = 8
#: Angles closer than this to a bound are compared, not inferred.
MARGIN = 1e-6
#: Members of one side of a block.
BLOCK = 1_000
SEED = 11


# ---------------------------------------------------------------- vectors in Arrow batches


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in double precision, and where each row begins; rows are scaled so that their squares are finite."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return x / np.repeat(np.maximum.reduceat(np.abs(x), starts), lengths), starts


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, padded with zeros to ``width``."""
    x, starts = _rows_of(column)
    lengths = np.diff(np.append(starts, len(x)))
    x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, starts)), lengths)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(x)) - np.repeat(starts, lengths)] = x
    return out


def cosines(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The columns of ``pairs`` but for the vectors ``a`` and ``b``, and their cosine ``cos``."""
    kept = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, at), (y, _) = _rows_of(batch.column(len(kept))), _rows_of(batch.column(len(kept) + 1))
                size = np.sqrt(np.add.reduceat(x * x, at)) * np.sqrt(np.add.reduceat(y * y, at))
                cos = np.add.reduceat(x * y, at) / size
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(cos)], [*kept, "cos"])

    return pairs.select(*kept, a, b).mapInArrow(run, pairs.select(*kept).withColumn("cos", F.lit(0.0)).schema)


# ---------------------------------------------------------------- codes


@dataclass
class Model:
    """Directions whose signs are the bits of a code (the columns of ``axes``), the mean, and how the code is cut into tables."""

    mean: np.ndarray
    axes: np.ndarray
    bits: int
    tables: int
    near: float
    differ: float = 0.0
    recall: float = 0.0

    @property
    def words(self) -> int:
        return -(-self.axes.shape[1] // 64)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.axes > 0

    def most(self, angle: Column) -> Column:
        """Bits in which the codes of vectors at ``angle`` differ, but for a few in 100,000 pairs."""
        n = self.axes.shape[1]
        p = F.least(angle * (self.differ / self.near), F.lit(0.5))
        return F.ceil(n * p + 4 * F.sqrt(n * p * (1 - p)))

    def coded(self, rows: DataFrame, vec: str) -> DataFrame:
        """``rows`` with the code of the column ``vec`` in words of 64 bits, and its parts, one a table."""
        model = self

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                signs = model.signs(unit_rows(batch.column(batch.schema.get_field_index(vec)), len(model.mean)))
                padded = np.zeros((len(signs), 64 * model.words), bool)
                padded[:, : signs.shape[1]] = signs
                code = np.packbits(padded, axis=1, bitorder="little").view("<i8")
                parts = signs[:, : model.bits * model.tables].reshape(len(signs), model.tables, model.bits) @ (1 << np.arange(model.bits, dtype=np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (code, parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "code", "part"])

        empty = F.array().cast("array<bigint>")
        return rows.mapInArrow(run, rows.withColumns({"code": empty, "part": empty}).schema)

    def keys(self, *more: str) -> list[Column]:
        """Columns of exploded rows: the key of each bucket that a vector stands in, and ``more``."""
        flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(self.bits)))
        each = F.transform("part", lambda p, t: F.transform(flips, lambda f: F.xxhash64(F.size("vec"), t, p.bitwiseXOR(f))))
        return [F.explode(F.flatten(each)).alias("key"), *map(F.col, more)]

    def apart(self, a: str, b: str) -> Column:
        """Bits in which two codes differ."""
        out = F.lit(0)
        for k in range(self.words):
            out = out + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
        return out


def rotation(x: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """The rotation that brings the rows of ``x`` closest to their signs, found in turns."""
    r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def fit(unit: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Model:
    """Learns axes from unit vectors (rows), for a table of ``n`` vectors; tables are added until pairs at the threshold meet often enough."""
    rng = np.random.default_rng(SEED)
    mean = unit.mean(axis=0)
    width = unit.shape[1]
    _, vectors = np.linalg.eigh(np.cov(unit - mean, rowvar=False).reshape(width, width) if len(unit) > 1 else np.eye(width))
    main = vectors[:, ::-1][:, : min(width, 64)]
    away = rng.standard_normal(unit.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    size = np.linalg.norm(away, axis=1, keepdims=True)
    other = threshold * unit + math.sqrt(1 - threshold**2) * away / np.where(size > 0, size, 1)
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(n, 2)))), 60)
    axes, model = np.zeros((width, 0)), None
    met = np.zeros(len(unit), bool)
    for tables in range(1, TABLES + 1):
        while axes.shape[1] < bits * tables:
            axes = np.hstack([axes, main @ rotation((unit - mean) @ main, rng, ROUNDS)])
        model = Model(mean, axes, bits, tables, math.acos(threshold))
        differ = model.signs(unit) != model.signs(other)
        met |= differ[:, bits * (tables - 1) : bits * tables].sum(axis=1) <= 2
        model.differ, model.recall = max(float(differ.mean()), 0.01), float(met.mean())
        if model.recall >= recall:
            break
    return model


# ---------------------------------------------------------------- links


def valid(vec: Column) -> Column:
    """Whether a vector can link: some component, each finite, one not zero."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0))))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def partial_sums(rows: DataFrame) -> DataFrame:
    """(lead, pos, x): sums of the unit vectors of rows (lead, vec) over each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leads, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                lengths = np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64)
                total = np.zeros((len(leads), int(lengths.max())))
                np.add.at(total, at, unit_rows(batch.column(1), total.shape[1]))
                width = np.zeros(len(leads), np.int64)
                width[at] = lengths  # of one length in a group
                for i in range(len(leads)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(width[i], leads[i])), pa.array(np.arange(width[i], dtype=np.int32)), pa.array(total[i, : width[i]])], ["lead", "pos", "x"])

    return rows.select("lead", "vec").mapInArrow(run, "lead long, pos int, x double")


def gathered(s: Scratch, coded: DataFrame, model: Model, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Cells of vectors that all link: members (v, cell, angle to the centre) and centres (cell, vec)."""
    near = math.acos(threshold)
    members = coded.select(*model.keys("v", "code"))
    leaders = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "code")).alias("m")).filter("n > 1").select("key", F.col("m.v").alias("lead"), F.col("m.code").alias("lead_code"))
    led = members.join(leaders, "key").filter((F.col("v") != F.col("lead")) & (model.apart("code", "lead_code") <= model.most(F.lit(near)))).select("v", "lead").distinct()
    vectors = coded.select("v", "vec")
    led = s.save(led, "led").join(vectors, "v").join(vectors.select(F.col("v").alias("lead"), F.col("vec").alias("lead_vec")), "lead")
    attached = s.save(cosines(led, "vec", "lead_vec").filter(F.col("cos") >= threshold).groupBy("v").agg(F.min("lead").alias("lead")), "attached")
    alone = attached.select("lead").distinct().join(attached.select(F.col("v").alias("lead")), "lead", "left_anti")  # leaders that follow none lead themselves
    grouped = attached.select("v", "lead").unionByName(alone.select(F.col("lead").alias("v"), "lead")).join(vectors, "v")
    sums = partial_sums(grouped).groupBy("lead", "pos").agg(F.sum("x").alias("x"))
    centres = sums.groupBy("lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias("centre"))
    # a mean direction of zero cannot be: all members are within the threshold's angle of one leader
    centres = s.save(centres, "centres")
    inside = cosines(grouped.join(centres, "lead"), "vec", "centre").withColumn("angle", F.acos(F.least("cos", F.lit(1.0)))).filter(F.col("angle") <= near / 2 - MARGIN)
    cell = (-1 - F.col("lead")).alias("cell")
    return s.save(inside.select("v", cell, "angle"), "inside"), centres.select(cell, F.col("centre").alias("vec"))


def open_blocks(tested: DataFrame, state: DataFrame, least: float) -> DataFrame:
    """Compares members of a cell i that are open towards a cell j with those members of j that may link: (x, i, j, links), by blocks of both."""
    counts = tested.groupBy("i", "j").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    back = counts.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("parts").alias("others"))
    sized = tested.join(counts, ["i", "j"]).join(back, ["i", "j"])
    block = F.pmod(F.xxhash64("x"), "parts")
    own = sized.filter("open").select("x", "i", "j", block.alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("yb"))
    # the other side of (i, j) stands in the table as (j, i)
    other = sized.select(F.col("x").alias("y"), F.col("j").alias("i"), F.col("i").alias("j"), block.alias("yb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("xb"))
    own = own.join(state.select(F.col("v").alias("x"), F.col("vec").alias("own")), "x")
    other = other.join(state.select(F.col("v").alias("y"), F.col("w").alias("weight"), F.col("vec").alias("other")), "y")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({"x": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        a, b = left["own"].chunk(0), right["other"].chunk(0)
        width = int(a.value_lengths()[0].as_py())
        near = unit_rows(a, width) @ unit_rows(b, width).T >= least
        return pa.table({"x": left["x"], "i": left["i"], "j": left["j"], "links": pa.array(near @ right["weight"].to_numpy())})

    keys = ["i", "j", "xb", "yb"]
    return own.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(run, "x long, i long, j long, links long")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vectors`` (vec_id, embedding); see the head of this file."""
    s = scratch or Scratch(vectors.sparkSession, "embed-dup")
    near, exact = math.acos(threshold), F.col("cos") >= threshold
    named = vectors.select("vec_id", F.when(valid(F.col("embedding")), F.col("embedding")).alias("vec"))
    rows = s.save(named.select("vec_id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(SEED), "vec").alias("k2"), F.monotonically_increasing_id().alias("uid")), "rows")
    some = rows.filter(F.col("vec").isNotNull())
    classes = s.save(some.groupBy("k1", "k2").agg(F.min("uid").alias("v"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first"), F.first("vec").alias("vec")), "classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    picked = classes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("vec").toArrow()
    model = fit(unit_rows(picked["vec"].combine_chunks() if picked["vec"].num_chunks == 1 else pa.concat_arrays(picked["vec"].chunks), width), n, threshold, recall)
    coded = s.save(model.coded(classes.select("v", "w", "first", "vec"), "vec"), "coded")
    inside, centres = gathered(s, coded, model, threshold)
    groups = coded.select("v", "w", "first").join(inside, "v").groupBy("cell").agg(F.sum("w").alias("weight"), F.max("angle").alias("r"), F.min("first").alias("first"))
    groups = s.save(model.coded(groups.join(centres, "cell"), "vec").drop("part"), "groups")
    state = coded.join(inside.select("v", "cell"), "v", "left").join(groups.select("cell", "weight", "r", F.col("code").alias("centre_code")), "cell", "left")
    state = s.save(
        state.select("v", "w", "first", "vec", "part", F.coalesce("cell", "v").alias("cell"), F.coalesce("weight", "w").alias("weight"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("centre_code", "code").alias("code")),
        "state",
    )
    s.drop(coded)
    single = state.filter("cell >= 0").select("cell", "weight", "r", "first", F.col("vec").cast("array<double>").alias("vec"))
    cells = s.save(groups.select("cell", "weight", "r", "first", "vec").unionByName(single), "cells")

    spots = state.select(*model.keys("cell", "r", "code")).dropDuplicates(["key", "cell"])
    x, y = (spots.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("cell", "r", "code"))) for k in "xy")
    met = x.join(y, "key").filter((F.col("cell_x") < F.col("cell_y")) & (model.apart("code_x", "code_y") <= model.most(near + F.col("r_x") + F.col("r_y"))))
    met = s.save(met.select("cell_x", "cell_y").distinct(), "met")
    for k in "xy":
        met = met.join(cells.select(F.col("cell").alias(f"cell_{k}"), F.col("r").alias(f"r_{k}"), F.col("vec").alias(f"vec_{k}")), f"cell_{k}")
    angle, wide = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))), F.col("r_x") + F.col("r_y")
    judged = cosines(met, "vec_x", "vec_y").withColumn("all", F.when(wide == 0, exact).when(angle + wide <= near - MARGIN, True))
    judged = s.save(judged.filter("all or (`all` is null)").filter(F.col("all").isNotNull() | (angle - wide <= near + MARGIN)).select(F.col("cell_x").alias("i"), F.col("cell_y").alias("j"), F.coalesce("all", F.lit(False)).alias("all")), "judged")
    both = judged.unionByName(judged.select(F.col("j").alias("i"), F.col("i").alias("j"), "all"))
    whole = both.filter("all").join(cells.select(F.col("cell").alias("j"), "weight"), "j").groupBy(F.col("i").alias("cell")).agg(F.sum("weight").alias("whole"))

    towards = both.filter("not `all`").join(state.select(F.col("v").alias("x"), F.col("cell").alias("i"), "vec"), "i")
    towards = towards.join(cells.select(F.col("cell").alias("j"), "weight", "r", F.col("vec").alias("centre")), "j").withColumn("vec", F.col("vec").cast("array<double>"))
    towards = cosines(towards.select("x", "i", "j", "weight", "r", "vec", "centre"), "vec", "centre")
    full = F.when(F.col("r") == 0, exact).otherwise(angle + F.col("r") <= near - MARGIN)
    tested = towards.withColumn("full", full).withColumn("open", ~F.col("full") & (F.col("r") > 0) & (angle - F.col("r") <= near + MARGIN)).filter("full or open")
    tested = s.save(tested.select("x", "i", "j", "weight", "full", "open"), "tested")
    compared = s.save(open_blocks(tested, state, threshold).filter("links > 0"), "compared")

    single_links = tested.filter("full").select("x", F.col("weight").alias("links")).unionByName(compared.select("x", "links")).groupBy(F.col("x").alias("v")).agg(F.sum("links").alias("links"))
    edges = judged.filter("all").select("i", "j").unionByName(tested.filter("full").select("i", "j")).unionByName(compared.select("i", "j"))
    labels = connected(s, s.save(edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), "links"))
    labelled = cells.select("cell", "first").join(labels.select(F.col("v").alias("cell"), "c"), "cell", "left").withColumn("c", F.coalesce("c", "cell"))
    least = labelled.groupBy("c").agg(F.min("first").alias("component_id"))
    out = state.select("v", "cell", "weight").join(single_links, "v", "left").join(whole, "cell", "left").join(labelled.select("cell", "c"), "cell").join(least, "c")
    none = F.lit(0).cast("long")
    out = s.save(out.select("v", "component_id", (F.col("weight") - 1 + F.coalesce("links", none) + F.coalesce("whole", none)).alias("n_links")), "result")
    ids = s.save(rows.select("vec_id", "k1", "k2", F.col("vec").isNotNull().alias("valid")), "ids")
    named = s.save(classes.select("k1", "k2", "v").join(out, "v").select("k1", "k2", "component_id", "n_links"), "named")
    s.drop_all_but(ids, named)
    found = ids.withColumn("k1", F.when(F.col("valid"), F.col("k1"))).join(named, ["k1", "k2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.coalesce("n_links", none).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
