"""The governed plan: overrides and their checks, consensus, frozen versions, value added, and the audit chain."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import ALL, DEFAULT, EngineConfig
from tidecast.functions.metrics import steady_sum, wmape
from tidecast.operators.hierarchy import DIMS, depth_of, level_of, matches
from tidecast.operators.windows import latest, seasonal_naive
from tidecast.sources.tables import checkpointed

# The reasons that an override may give.
REASONS = ("PROMOTION", "NEW_PROGRAM", "LOST_DEAL", "SUPPLY_CONSTRAINT", "MARKET_SHIFT", "INVENTORY_CORRECTION", "PRICE_CHANGE", "OTHER")
LEAST_COMMENT = 15
GENESIS = "0" * 64
STATES = ("OPEN", "FORECASTED", "CONSENSUS", "LOCKED")
DRAWS, LEAST_DRAWN = 400, 12
#: Rows that are drawn in one task, about, and children of a node of the tree that deals draws to them.
DRAWN_TOGETHER, FAN = 1000, 256
#: Classes of leaves of one month that one group may hold; months of more bind by turns.
CLASSES = 1_000_000
NO_LEAVES, NONE_FREE, BELOW = "no leaves under the node", "no leaf is free and totals differ", "below the sum of finer overrides"


# ---------------------------------------------------------------- overrides


def check_overrides(requests: DataFrame, points: DataFrame, scopes: DataFrame, reasons: tuple[str, ...] = REASONS, config: EngineConfig = DEFAULT) -> DataFrame:
    """``requests`` with override_units, override_revenue, deviation_pct and error (null: sound; else the first rule that is broken).

    ``requests`` has oem, region, product, month, basis, value, reason_code, comment, user_id, locked; ``points`` the forecast's nodes with month, units, revenue, asp; ``scopes`` has
    user_id, role, oems, regions (arrays; empty: all)."""
    node = [*DIMS, "month"]
    p = points.select(*node, F.col("units").alias("_u"), F.col("revenue").alias("_r"), F.col("asp").alias("_a"))
    rows = requests.join(p, node, "left").join(scopes.select("user_id", "role", "oems", "regions"), "user_id", "left")
    price = F.when(F.col("_a") > 0, F.col("_a")).otherwise(F.coalesce(F.when(F.col("_u") > 0, F.try_divide("_r", "_u")), F.lit(0.0)))
    units = F.when(F.col("basis") == "UNITS", F.col("value")).otherwise(F.when(price > 0, F.col("value") / price).otherwise(0.0))
    revenue = F.when(F.col("basis") == "UNITS", F.col("value") * price).otherwise(F.col("value"))
    deviation = F.when(F.col("_u") > 1e-9, F.abs(units / F.col("_u") - 1) * 100).otherwise(F.when(units > 0, 100.0).otherwise(0.0))
    outside = lambda allowed, v: (F.col("role") == "sales_rep") & (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col(v))
    comment = F.length(F.trim(F.coalesce("comment", F.lit(""))))
    error = (
        F.when(F.col("locked"), "the version is locked")
        .when(level_of(*(F.col(d) for d in DIMS)) == "INVALID", "not a level of the hierarchy")
        .when(~F.coalesce(F.col("reason_code").isin(*reasons), F.lit(False)), "unknown reason")
        .when(~F.coalesce(F.col("basis").isin("UNITS", "REVENUE"), F.lit(False)), "unknown basis")
        .when(F.col("value") < 0, "negative value")
        .when(outside(F.col("oems"), "oem") | outside(F.col("regions"), "region"), "outside the user's scope")
        .when(F.col("_u").isNull(), "no forecast for the node and month")
        .when((deviation > config.max_deviation_pct + 1e-6) & (comment < LEAST_COMMENT), "a large change needs a comment")
    )
    return rows.select(*requests.columns, units.alias("override_units"), revenue.alias("override_revenue"), deviation.alias("deviation_pct"), error.alias("error"))


def revisions(overrides: DataFrame) -> DataFrame:
    """``overrides`` (override_id, node, month) with revision, supersedes and status by order of ids: the last of a node and month is ACTIVE, earlier ones SUPERSEDED; ``events`` may change that."""
    w = Window.partitionBy(*DIMS, "month").orderBy("override_id")
    last = Window.partitionBy(*DIMS, "month")
    return overrides.withColumns(
        {"revision": F.row_number().over(w), "supersedes": F.lag("override_id").over(w), "status": F.when(F.col("override_id") == F.max("override_id").over(last), "ACTIVE").otherwise("SUPERSEDED")}
    )


def latest_state(overrides: DataFrame, events: DataFrame) -> DataFrame:
    """Overrides with revision, status and approval after ``events`` (override_id, event_id, action: WITHDRAW, APPROVE, REJECT or a note), which are only ever appended; the last of a kind counts."""
    kind = F.when(F.col("action") == "WITHDRAW", "withdraw").otherwise("review")
    done = latest(events.withColumn("_kind", kind), ("override_id", "_kind"), F.col("event_id").desc())
    done = done.groupBy("override_id").agg(F.bool_or(F.col("_kind") == "withdraw").alias("_gone"), F.max(F.when(F.col("_kind") == "review", F.col("action"))).alias("_review"))
    out = revisions(overrides).join(done, "override_id", "left")
    status = F.when((F.col("status") == "ACTIVE") & F.col("_gone"), "WITHDRAWN").otherwise(F.col("status"))
    approval = F.when(F.col("_review") == "APPROVE", "APPROVED").when(F.col("_review") == "REJECT", "REJECTED").otherwise("PENDING")
    return out.withColumns({"status": status, "approval_status": approval}).drop("_gone", "_review")


def active_overrides(overrides: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    rows = overrides.filter("status = 'ACTIVE' and approval_status <> 'REJECTED'")
    return rows.filter("approval_status = 'APPROVED'") if config.requires_approval else rows


# ---------------------------------------------------------------- consensus


def rounds(overrides: DataFrame) -> DataFrame:
    """``overrides`` with ``turn``: what binds together, since within a month the nodes of a turn do not overlap.

    Finer nodes come first. Nodes of the two finest levels overlap only if they are equal, so there a turn is a level and how often its node came before. Coarser nodes (regions, oems, products, the
    total) may overlap, so there a new turn also begins where, by id, other dimensions are named. Only these are ordered by month."""
    dims = F.concat_ws(",", *(F.when(F.col(d) != ALL, d) for d in DIMS))
    again = F.row_number().over(Window.partitionBy(*DIMS, "month").orderBy("override_id")) - 1
    rows = overrides.withColumns({"_dims": dims, "_depth": depth_of(level_of(*(F.col(d) for d in DIMS))), "_again": again})
    by_id = Window.partitionBy("month", "_depth").orderBy("override_id")
    kind = F.struct("_dims", "_again")
    coarse = rows.filter("_depth <= 1").withColumn("_new", (kind != F.lag(kind).over(by_id)).cast("int"))
    coarse = coarse.withColumn("_run", F.coalesce(F.sum("_new").over(by_id), F.lit(0)).cast("int")).drop("_new")
    out = rows.filter("_depth > 1").withColumn("_run", F.col("_again")).unionByName(coarse)
    return out.withColumn("turn", F.struct((-F.col("_depth")).alias("depth"), F.col("_run").alias("run"), F.col("_dims").alias("dims"))).drop("_dims", "_depth", "_again", "_run")


def _by_turns(state: DataFrame, turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The state after ``turns``, and conflicts: each turn is a join with the leaves and a sum by override, for all months at once; states are checkpointed."""
    leaf, conflicts = [*DIMS, "month"], []
    for turn in sorted(r[0] for r in turns.select("turn").distinct().collect()):
        keys = [*(d for d in turn["dims"].split(",") if d), "month"]
        now = turns.filter(reduce(lambda x, y: x & y, (F.col(f"turn.{k}") == turn[k] for k in ("depth", "run", "dims")))).select("override_id", *keys, "override_units")
        free = F.col("pin").isNull()
        sums = now.join(state, keys, "left").groupBy("override_id", *keys, "override_units").agg(
            F.count("ai").alias("leaves"), F.count_if(free & F.col("ai").isNotNull()).alias("free"),
            steady_sum(F.when(~free, F.col("value")).otherwise(0.0)).alias("held"), steady_sum(F.when(free, F.col("ai")).otherwise(0.0)).alias("open"),
        )
        sums = checkpointed(sums.withColumn("left", F.col("override_units") - F.col("held")))
        broken = (
            F.when(F.col("leaves") == 0, NO_LEAVES)
            .when((F.col("free") == 0) & (F.abs("left") > 1e-6), NONE_FREE)
            .when((F.col("free") > 0) & (F.col("left") < -1e-9), BELOW)
        )
        conflicts.append(sums.select("override_id", broken.alias("reason"), F.when(F.col("leaves") > 0, F.col("left")).alias("residual")).filter("reason is not null"))
        binding = sums.filter("free > 0 and left >= -1e-9").select(F.col("override_id").alias("_id"), *keys, "left", "open", "free")
        state = checkpointed(_bound(state.join(binding, keys, "left"), leaf))
    return state, conflicts


def _bound(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """Leaves with the override (_id, left, open, free) that takes them if they are free."""
    share = F.when(F.col("open") > 1e-12, F.col("ai") / F.col("open")).otherwise(1 / F.col("free"))
    takes = F.col("pin").isNull() & F.col("_id").isNotNull()
    return rows.select(*leaf, "ai", F.when(takes, F.col("left") * share).otherwise(F.col("value")).alias("value"), F.when(takes, F.col("_id")).otherwise(F.col("pin")).alias("pin"))


def _bind_classes(key: tuple, classes: pd.DataFrame, overrides: pd.DataFrame) -> pd.DataFrame:
    """A month's coarse overrides in their order over its classes of leaves: a row for each class and override that takes it, and for each conflict. Sums are of whole billionths."""
    classes = classes.sort_values([f"_{d}" for d in DIMS], ignore_index=True)
    leaves, free = classes["leaves"].to_numpy(np.int64), classes["free"].to_numpy(np.int64)
    held, open_ = (np.array([int(x) for x in classes[c]], object) for c in ("held", "open"))
    members = [classes.groupby(f"_{d}").indices for d in DIMS]
    none, out = np.zeros(0, np.int64), []
    for o in overrides.sort_values("_order").itertuples(index=False):
        own = [members[i].get(getattr(o, d), none) for i, d in enumerate(DIMS) if getattr(o, d) != ALL]
        rows = reduce(np.intersect1d, own) if own else np.arange(len(classes))
        taken = rows[free[rows] > 0]
        left, n = o.override_units - int(held[rows].sum()) / 1e9, int(free[taken].sum())
        reason = NO_LEAVES if not len(rows) else (NONE_FREE if abs(left) > 1e-6 else None) if not n else BELOW if left < -1e-9 else None
        if reason:
            out.append((None, None, None, o.override_id, left if len(rows) else None, None, None, reason))
        if reason or not n:
            continue
        total = int(open_[taken].sum()) / 1e9
        for c in taken.tolist():
            out.append((*(classes.at[c, f"_{d}"] for d in DIMS), o.override_id, left, total, float(n), None))
            share = int(open_[c]) / 1e9 / total if total > 1e-12 else int(free[c]) / n
            held[c], free[c], open_[c] = held[c] + int(np.floor(left * share * 1e9)), 0, 0
    found = pd.DataFrame(out, columns=[*(f"_{d}" for d in DIMS), "_id", "left", "open", "free", "reason"])
    found.insert(0, "month", key[0])
    return found


def _by_classes(state: DataFrame, coarse: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The state after coarse overrides, and conflicts, in a number of jobs that does not depend on theirs.

    Leaves of a month that the same overrides cover are one class, which is summed once. The order of overrides is run over the classes, a month in a group, and what takes a class is joined back
    to its leaves. Months of more than ``most`` classes go by turns, with the same result."""
    leaf, names = [*DIMS, "month"], [f"_{d}" for d in DIMS]
    for d in DIMS:
        named = coarse.filter(F.col(d) != ALL).select("month", d, F.col(d).alias(f"_{d}")).distinct()
        state = state.join(named, ["month", d], "left").withColumn(f"_{d}", F.coalesce(f"_{d}", F.lit(ALL)))
    free, billionths = F.col("pin").isNull(), lambda c: F.sum(F.floor(c * 1e9).cast("decimal(38,0)"))
    classes = state.join(coarse.select("month").distinct(), "month", "left_semi").groupBy("month", *names).agg(
        F.count(F.lit(1)).alias("leaves"), F.count_if(free).alias("free"),
        billionths(F.when(~free, F.col("value")).otherwise(0.0)).alias("held"), billionths(F.when(free, F.col("ai")).otherwise(0.0)).alias("open"),
    )
    classes = checkpointed(classes)
    large = classes.groupBy("month").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("month")
    by_order = Window.partitionBy("month").orderBy(F.col("turn.depth"), "override_id")
    listed = coarse.join(large, "month", "left_anti").select("month", *DIMS, "override_id", F.col("override_units").cast("double").alias("override_units"), F.row_number().over(by_order).alias("_order"))
    id_type, month = coarse.schema["override_id"].dataType.simpleString(), coarse.schema["month"].dataType.simpleString()
    schema = f"month {month}, " + ", ".join(f"{n} string" for n in names) + f", _id {id_type}, left double, open double, free double, reason string"
    small = classes.join(large, "month", "left_anti")
    found = checkpointed(small.groupBy("month").cogroup(listed.groupBy("month")).applyInPandas(_bind_classes, schema))
    conflicts = [found.filter("reason is not null").select(F.col("_id").alias("override_id"), "reason", F.col("left").alias("residual"))]
    state = checkpointed(_bound(state.join(found.filter("reason is null").drop("reason"), ["month", *names], "left"), leaf))
    state, late = _by_turns(state, coarse.join(large, "month", "left_semi"))
    return state, conflicts + late


def consensus(plan: DataFrame, overrides: DataFrame, classes: int = CLASSES) -> tuple[DataFrame, DataFrame]:
    """(plan, conflicts): ``plan`` (oem, region, product, month, ai_units and more) with consensus_units, overridden, reason_code, user_id; conflicts (override_id, reason, residual).

    Overrides (override_id, oem, region, product, month, override_units, reason_code, user_id) bind the finest first, of equal depth by id. One shares what its node's total leaves
    after finer overrides among the leaves that are still free, in proportion to their forecast (evenly if that is zero). One whose node has no leaves, no free leaves (with another total), or
    less than its leaves already hold, is a conflict and binds nothing.
    Overrides of the two finest levels overlap only where nodes are equal, so a turn of joins binds nearly all of a level; coarser ones, which overlap at will, are ordered over classes of leaves (at most ``classes`` a month in one group)."""
    leaf = [*DIMS, "month"]
    turns = checkpointed(rounds(overrides))
    months = turns.select("month").distinct()
    state = plan.select(*leaf, F.col("ai_units").cast("double").alias("ai")).join(months, "month", "left_semi")
    state = state.withColumns({"value": F.col("ai"), "pin": F.lit(None).cast(overrides.schema["override_id"].dataType)})
    state, conflicts = _by_turns(state, turns.filter("turn.depth <= -2"))
    coarse = turns.filter("turn.depth > -2")
    if not coarse.isEmpty():
        state, more = _by_classes(state, coarse, classes)
        conflicts += more
    given = overrides.select(F.col("override_id").alias("pin"), "reason_code", "user_id")
    new = state.filter("pin is not null").join(given, "pin").select(*leaf, F.col("value").alias("consensus_units"), F.lit(True).alias("overridden"), "reason_code", "user_id")
    out = plan.drop("consensus_units", "overridden", "reason_code", "user_id").join(new, leaf, "left")
    out = out.withColumns({"consensus_units": F.coalesce("consensus_units", F.col("ai_units").cast("double")), "overridden": F.coalesce("overridden", F.lit(False))})
    none = plan.sparkSession.createDataFrame([], f"override_id {overrides.schema['override_id'].dataType.simpleString()}, reason string, residual double")
    return out, reduce(DataFrame.unionByName, conflicts, none)


def consensus_single_level(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """The same for overrides whose nodes do not overlap (such as those of one level), as a join and a window, without Python."""
    o = overrides.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.col("month").alias("_month"), "override_units", F.col("reason_code").alias("_reason"), F.col("user_id").alias("_user"), "override_id")
    under = (F.col("month") == F.col("_month")) & matches([F.col(f"_{d}") for d in DIMS], [F.col(d) for d in DIMS])
    rows = plan.drop("consensus_units", "overridden", "reason_code", "user_id").join(o, under, "left")
    node = Window.partitionBy("month", "override_id")
    total, n = F.sum("ai_units").over(node), F.count(F.lit(1)).over(node)
    share = F.when(total > 1e-12, F.col("ai_units") / total).otherwise(1 / n)
    out = rows.withColumns({"consensus_units": F.when(F.col("override_id").isNotNull(), F.col("override_units") * share).otherwise(F.col("ai_units")), "overridden": F.col("override_id").isNotNull()})
    return out.withColumnsRenamed({"_reason": "reason_code", "_user": "user_id"}).drop(*(f"_{d}" for d in DIMS), "_month", "override_units", "override_id")


def freeze(consensus_rows: DataFrame, series: DataFrame, cycle: Column) -> DataFrame:
    """A consensus with ``naive_units``: the value of a year before, else the last one until the cycle month. What is written once when a run is locked."""
    known = series.filter((F.col("month") <= cycle) & (F.col("oem") != "UNMAPPED"))
    return seasonal_naive(known, consensus_rows, DIMS).withColumnRenamed("naive", "naive_units")


def next_state(state: str, action: str) -> str:
    """A planning cycle's state after attach, review or lock; other steps raise."""
    steps = {("OPEN", "attach"): "FORECASTED", ("FORECASTED", "attach"): "FORECASTED", ("FORECASTED", "review"): "CONSENSUS", ("FORECASTED", "lock"): "LOCKED", ("CONSENSUS", "lock"): "LOCKED"}
    if (state, action) not in steps:
        raise ValueError(f"cannot {action} a cycle that is {state}")
    return steps[state, action]


# ---------------------------------------------------------------- value added


def matured(frozen: DataFrame, actuals: DataFrame) -> DataFrame:
    """Frozen rows of months with actuals (month, oem, region, product, y); a month without a row of its own had no demand."""
    last = actuals.agg(F.max("month").alias("_last"))
    rows = frozen.join(actuals.select("month", *DIMS, "y"), ["month", *DIMS], "left").crossJoin(F.broadcast(last))  # one row
    return rows.filter("month <= _last").withColumn("y", F.coalesce("y", F.lit(0.0))).drop("_last")


def value_added(rows: DataFrame) -> DataFrame:
    """run_id, scope, horizon, n_obs, wmape_naive, wmape_ai, wmape_consensus, fva_sales, fva_ai.

    ``rows`` are matured rows (run_id, node, horizon, ai_units, consensus_units, naive_units, overridden, user_id, reason_code, y). ALL_ROWS has all rows, the others those
    that were overridden: all, by horizon, by each dimension, user and reason, and by run. One pass: every row is expanded to its scopes and pre-aggregated."""
    ov = F.col("overridden")
    dims = {"oem": "oem", "region": "region", "product": "product", "user": "user_id", "reason": "reason_code"}
    s = lambda run, scope, horizon: F.struct(run.alias("run_id"), scope.alias("scope"), horizon.cast("int").alias("horizon"))
    every, none = F.lit("ALL"), F.lit(None).cast("int")
    scopes = [s(every, F.lit("ALL_ROWS"), none), F.when(ov, s(every, every, none)), F.when(ov, s(every, every, F.col("horizon"))), F.when(ov, s(F.col("run_id"), F.lit("RUN"), none))]
    scopes += [F.when(ov & F.col(c).isNotNull(), s(every, F.concat(F.lit(f"{name}:"), F.col(c)), none)) for name, c in dims.items()]
    each = rows.select("y", "ai_units", "consensus_units", "naive_units", F.explode(F.array_compact(F.array(*scopes))).alias("s"))
    y = F.col("y")
    out = each.groupBy("s.run_id", "s.scope", "s.horizon").agg(
        F.count(F.lit(1)).alias("n_obs"),
        *(wmape(y, F.col(f"{m}_units")).alias(f"wmape_{m}") for m in ("naive", "ai", "consensus")),
    )
    return out.withColumns({"fva_sales": F.col("wmape_ai") - F.col("wmape_consensus"), "fva_ai": F.col("wmape_naive") - F.col("wmape_ai")})


def _splitting(seed: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Deals a node's draws to its children, one binomial a child."""

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child")
        rng = np.random.default_rng([seed, level, int(key[1]), *hashlib.sha256(str(key[0]).encode()).digest()[:8]])
        left, of, out = np.array(rows["times"].iloc[0], np.int64), int(rows["n"].sum()), []
        for n in rows["n"].tolist():
            got = rng.binomial(left, n / of) if n < of else left
            out.append(got)
            left, of = left - got, of - n
        return pd.DataFrame({"key": key[0], "node": rows["child"].to_numpy(), "times": out})

    return split


def dealt_draws(counts: DataFrame, draws: int, seed: int) -> DataFrame:
    """(key, bucket, times: for each draw how many of the key's draws fall in the bucket) of buckets (key, bucket, n).

    A draw takes as many rows as there are, so buckets have a multinomial number. It is dealt down a tree whose nodes have ``FAN`` children: each node splits its number by one binomial a child, given what is left, by a
    seed of its own. Each draw thus sums to the number of rows, and no task sees more than the children of one node."""
    high = counts.agg(F.max("bucket")).first()[0]
    levels = 1
    while high is not None and FAN**levels <= high:
        levels += 1
    dealt = counts.groupBy("key").agg(F.sum("n").alias("n")).select("key", F.lit(0).cast("long").alias("node"), F.array_repeat(F.col("n"), draws).alias("times"))
    for level in range(levels - 1, -1, -1):
        under = counts.groupBy("key", F.floor(F.col("bucket") / FAN**level).cast("long").alias("child")).agg(F.sum("n").alias("n")).withColumn("node", F.floor(F.col("child") / FAN).cast("long"))

        dealt = under.join(dealt, ["key", "node"]).groupBy("key", "node").applyInPandas(_splitting(seed, level), "key string, node long, times array<long>")
    return dealt.withColumnRenamed("node", "bucket")


def bootstrap(rows: DataFrame, keys: tuple[str, ...], draws: int = DRAWS, level: float = DEFAULT.fva_level, seed: int = 11) -> DataFrame:
    """keys, ci_low, ci_high, significant of fva_sales, for keys of 12 rows or more.

    Each draw takes as many rows of a key as it has, with repetition. Rows are dealt by hash to buckets of about ``DRAWN_TOGETHER``, the draws to buckets by ``dealt_draws``, and each bucket draws its own number of its rows; a bucket passes on three sums a draw."""
    named = rows.select(*keys, F.to_json(F.struct(*keys)).alias("key"), F.xxhash64(*rows.columns).alias("id"), *(F.col(c).cast("double").alias(c) for c in ("y", "ai_units", "consensus_units")))
    named = checkpointed(named.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id())))  # rows that are equal are dealt apart
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.filter(F.col("rows") >= LEAST_DRAWN).select("key", F.ceil(F.col("rows") / DRAWN_TOGETHER).alias("buckets"))
    placed = named.join(sizes, "key").withColumn("bucket", F.pmod("salt", "buckets").cast("long"))
    times = dealt_draws(checkpointed(placed.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))), draws, seed)

    def drawn(key: tuple, own: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "y", "ai_units", "consensus_units"])
        rng = np.random.default_rng([seed, int(key[1]), *hashlib.sha256(str(key[0]).encode()).digest()[8:16]])
        t = rng.multinomial(np.array(dealt["times"].iloc[0], np.int64), np.full(len(own), 1 / len(own)))
        y = own["y"].to_numpy()
        sums = [t @ np.abs(x) for x in (y - own["ai_units"].to_numpy(), y - own["consensus_units"].to_numpy(), y)]
        return pd.DataFrame({"key": key[0], "draw": range(len(t)), "ai": sums[0], "consensus": sums[1], "y": sums[2]})

    parts = placed.select("key", "bucket", "id", "y", "ai_units", "consensus_units").groupBy("key", "bucket").cogroup(times.groupBy("key", "bucket")).applyInPandas(drawn, "key string, draw int, ai double, consensus double, y double")
    by = parts.groupBy("key", "draw").agg((F.sum("ai") / F.sum("y") - F.sum("consensus") / F.sum("y")).alias("d"))
    ends = by.groupBy("key").agg(F.percentile("d", F.lit(level / 2)).alias("ci_low"), F.percentile("d", F.lit(1 - level / 2)).alias("ci_high"))  # one value a draw
    names = named.select("key", *keys).distinct()
    return names.join(ends, "key").select(*keys, "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


# ---------------------------------------------------------------- audit


def entry_hash(prev: Column, user: Column, action: Column, kind: Column, key: Column, before: Column, after: Column) -> Column:
    """The hash that chains an entry to the one before it; before and after are JSON texts with sorted keys."""
    return F.sha2(F.concat_ws("|", prev, user, action, kind, key, F.coalesce(before, F.lit("null")), F.coalesce(after, F.lit("null"))), 256)


def broken_entries(log: DataFrame) -> DataFrame:
    """entry_id of entries (entry_id without gaps, prev_hash, hash and what is hashed) whose own hash is wrong or that do not follow the entry before them.

    Each entry is joined with its predecessor by number, so the log is never in one order in one place."""
    before = log.select((F.col("entry_id") + 1).alias("entry_id"), F.col("hash").alias("_before"))
    own = entry_hash(*(F.col(c) for c in ("prev_hash", "user_id", "action", "entity_type", "entity_id", "before", "after")))
    rows = log.join(before, "entry_id", "left")
    first = log.agg(F.min("entry_id").alias("_first"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    expected = F.when(F.col("entry_id") == F.col("_first"), F.lit(GENESIS)).otherwise(F.coalesce("_before", F.lit("")))
    return rows.filter((F.col("hash") != own) | (F.col("prev_hash") != expected)).select("entry_id")


def verify_chain(log: DataFrame) -> DataFrame:
    """One row: ok, first_bad."""
    bad = broken_entries(log).agg(F.min("entry_id").alias("first_bad"))
    return bad.select(F.col("first_bad").isNull().alias("ok"), "first_bad")


def canonical(text: str | None) -> str:
    """A JSON text with sorted keys and without spaces; nothing is ``null``."""
    return "null" if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def append_entries(log: DataFrame, new: DataFrame) -> DataFrame:
    """New entries (seq, user_id, action, entity_type, entity_id, before, after) as rows of the log, in the order of ``seq``, chained to its last entry.

    Each hash needs the one before it, so one writer walks through the new entries, a batch at a time; the log is only asked for its end. ``before`` and ``after`` are JSON texts."""
    end = log.agg(F.max_by(F.struct("entry_id", "hash"), "entry_id").alias("e")).first()["e"]
    entry, prev = (end["entry_id"], end["hash"]) if end else (0, GENESIS)
    given = ["user_id", "action", "entity_type", "entity_id", "before", "after"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = entry, prev
        for b in batches:
            rows = []
            for user, action, kind, key, before, after in b[given].itertuples(index=False):
                at += 1
                before, after = canonical(before), canonical(after)
                own = hashlib.sha256("|".join((last, user, action, kind, key, before, after)).encode()).hexdigest()
                rows.append((at, user, action, kind, key, before, after, last, own))
                last = own
            yield pd.DataFrame(rows, columns=["entry_id", *given, "prev_hash", "hash"])

    schema = "entry_id long, " + ", ".join(f"{c} string" for c in given) + ", prev_hash string, hash string"
    return new.select("seq", *given).repartition(1).sortWithinPartitions("seq").mapInPandas(run, schema)
