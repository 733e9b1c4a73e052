"""The commercial signal: what open opportunities will add, by outcomes known at the time.

``opps`` has id, product, rep_id, created_month, ramp_months, quantity_units, first_delivery_month; ``snaps`` has opportunity_id, snapshot_month, stage
(1 to 5 open, 6 won, 7 lost), quantity_units, expected_close_month, months_in_stage, push_count, rep_probability, quote_issued; ``nodes`` has opportunity_id,
oem, region, pct. Nothing reads a snapshot later than the month it speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import months_between
from tidecast.functions.metrics import steady_sum

OPEN, WON = 5, 6
#: Months between the true and the expected close, and between close and first delivery.
SLIP, DELAY = (-3, 8), (0, 6)
ALPHA = 0.5
#: What outcomes are shrunk to, and with how many.
PRIOR_RATE, PRIOR_N = 0.30, 6.0
# The chance to win by stage, where no model is fitted.
STAGE_PRIOR = {1: 0.10, 2: 0.18, 3: 0.30, 4: 0.45, 5: 0.65}
FEATURES = ("stage", "months_in_stage", "age", "push_count", "rep_probability", "log_qty", "months_to_close", "quote_issued", "rep_win_rate", "rep_gap", "rep_n_closed", "qty_vs_first")
LEAST_ROWS = 400


def closures(snaps: DataFrame) -> DataFrame:
    """opportunity_id, closed_month, won."""
    return snaps.filter(F.col("stage") >= WON).select("opportunity_id", F.col("snapshot_month").alias("closed_month"), (F.col("stage") == WON).cast("int").alias("won"))


def at_last(snaps: DataFrame, *columns: str) -> DataFrame:
    """opportunity_id and columns of its last open snapshot."""
    return snaps.filter(F.col("stage") <= OPEN).groupBy("opportunity_id").agg(*(F.max_by(c, "snapshot_month").alias(c) for c in columns))


def rep_stats(opps: DataFrame, snaps: DataFrame) -> DataFrame:
    """rep_id, month, rep_win_rate, rep_gap (what was promised beyond what was won), rep_n_closed from opportunities closed strictly before the month, for each month with snapshots."""
    closed = closures(snaps).join(opps.select(F.col("id").alias("opportunity_id"), "rep_id"), "opportunity_id").join(at_last(snaps, "rep_probability"), "opportunity_id", "left")
    by_month = closed.groupBy("rep_id", F.col("closed_month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"), F.sum("rep_probability").alias("p"))
    months = snaps.select(F.col("snapshot_month").alias("month")).distinct()
    spine = by_month.select("rep_id").distinct().crossJoin(F.broadcast(months))  # months are few
    before = Window.partitionBy("rep_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    rows = spine.join(by_month, ["rep_id", "month"], "left").select("rep_id", "month", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double").alias(c) for c in ("n", "w", "p")))
    rate = (F.col("w") + PRIOR_RATE * PRIOR_N) / (F.col("n") + PRIOR_N)
    return rows.select("rep_id", "month", rate.alias("rep_win_rate"), ((F.col("p") + PRIOR_RATE * PRIOR_N) / (F.col("n") + PRIOR_N) - rate).alias("rep_gap"), F.col("n").alias("rep_n_closed"))


def features(opps: DataFrame, snaps: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (all snapshots by default) with product, rep_id and the model's inputs, as known at each snapshot."""
    o = opps.select(F.col("id").alias("opportunity_id"), "product", "rep_id", "created_month")
    first = snaps.groupBy("opportunity_id").agg(F.min_by("quantity_units", "snapshot_month").alias("_first"))
    stats = rep_stats(opps, snaps).withColumnRenamed("month", "snapshot_month")
    out = (snaps if rows is None else rows).join(o, "opportunity_id").join(first, "opportunity_id").join(stats, ["rep_id", "snapshot_month"], "left")
    return out.withColumns(
        {
            "age": months_between(F.col("snapshot_month"), F.col("created_month")),
            "months_to_close": months_between(F.col("expected_close_month"), F.col("snapshot_month")),
            "log_qty": F.log1p("quantity_units"),
            "qty_vs_first": F.try_divide("quantity_units", "_first"),
            "rep_win_rate": F.coalesce("rep_win_rate", F.lit(PRIOR_RATE)),
            "rep_gap": F.coalesce("rep_gap", F.lit(0.0)),
            "rep_n_closed": F.coalesce("rep_n_closed", F.lit(0.0)),
            "quote_issued": F.col("quote_issued").cast("int"),
        }
    ).drop("_first", "created_month")


def histogram(df: DataFrame, keys: tuple[str, ...], value: str, support: tuple[int, int], alpha: float = ALPHA) -> DataFrame:
    """keys, at, p, n: smoothed shares of each step of the support; values beyond it count at its ends. Keys without rows have none."""
    low, high = support
    cut = F.greatest(F.least(F.col(value), F.lit(high)), F.lit(low)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, cut.alias("at")).agg(F.count(F.lit(1)).alias("c"))
    by = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"), F.sum("c").alias("n"))  # an entry for each step
    size = high - low + 1
    rows = by.select(*keys, "n", F.col("m"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("at"))
    share = (F.coalesce(F.try_element_at("m", F.col("at")), F.lit(0)) + alpha) / (F.col("n") + alpha * size)
    return rows.select(*keys, "at", share.alias("p"), "n")


def flat(support: tuple[int, int]) -> Column:
    return F.lit(1.0 / (support[1] - support[0] + 1))


def slips(snaps: DataFrame) -> DataFrame:
    """stage (1 to 5), at, p: by how many months a close came later than expected at each snapshot in the stage, of opportunities that were won; stages without any are even."""
    won = closures(snaps).filter("won = 1")
    late = snaps.filter(F.col("stage") <= OPEN).join(won, "opportunity_id").select("stage", months_between(F.col("closed_month"), F.col("expected_close_month")).alias("late"))
    spine = snaps.sparkSession.range(1, OPEN + 1).select(F.col("id").cast("int").alias("stage")).withColumn("at", F.explode(F.sequence(F.lit(SLIP[0]), F.lit(SLIP[1]))))
    return spine.join(histogram(late, ("stage",), "late", SLIP), ["stage", "at"], "left").select("stage", "at", F.coalesce("p", flat(SLIP)).alias("p"))


def delivered(opps: DataFrame, snaps: DataFrame, asof: Column) -> DataFrame:
    """Won opportunities, closed six months before ``asof`` or earlier, that have begun to deliver: with closed_month."""
    won = closures(snaps).filter("won = 1").select(F.col("opportunity_id").alias("id"), "closed_month")
    return opps.join(won, "id").filter((F.col("closed_month") <= F.add_months(asof, -6)) & (F.col("first_delivery_month") <= asof))


def delays(opps: DataFrame, snaps: DataFrame, asof: Column, least: int = 10) -> DataFrame:
    """product, at, p: months from close to first delivery; products with fewer than ``least`` cases have the pool's."""
    rows = delivered(opps, snaps, asof).select("product", months_between(F.col("first_delivery_month"), F.col("closed_month")).alias("wait"))
    own = histogram(rows, ("product",), "wait", DELAY).filter(F.col("n") >= least)
    pool = histogram(rows.withColumn("_all", F.lit(0)), ("_all",), "wait", DELAY).select("at", F.col("p").alias("_pool"))
    steps = F.explode(F.sequence(F.lit(DELAY[0]), F.lit(DELAY[1])))
    spine = opps.select("product").distinct().select("product", steps.alias("at")).join(F.broadcast(pool), "at", "left")
    return spine.join(own, ["product", "at"], "left").select("product", "at", F.coalesce("p", "_pool", flat(DELAY)).alias("p"))


def quantity_factors(opps: DataFrame, snaps: DataFrame, asof: Column) -> DataFrame:
    """rep_id, factor: delivered over promised quantity of finished ramps, shrunk to 1 with the weight of three."""
    done = delivered(opps, snaps, asof).filter(F.date_add("first_delivery_month", (F.col("ramp_months") * 30).cast("int")) <= asof)
    promised = at_last(snaps, "quantity_units").select(F.col("opportunity_id").alias("id"), F.col("quantity_units").alias("promised"))
    ratio = F.try_divide("quantity_units", "promised")
    return done.join(promised, "id").groupBy("rep_id").agg(((steady_sum(ratio) + 3.0) / (F.count(F.lit(1)) + 3.0)).alias("factor"))


def stage_chance(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == s, p) for s, p in STAGE_PRIOR.items()))


def open_pipeline(opps: DataFrame, snaps: DataFrame, asof: Column, chance: DataFrame | None = None) -> DataFrame:
    """Opportunities open at ``asof`` with win_prob (``chance`` by opportunity, else the stage's) and qty_adj."""
    known = snaps.filter(F.col("snapshot_month") <= asof)
    rows = features(opps, known, known.filter((F.col("snapshot_month") == asof) & (F.col("stage") <= OPEN)))
    rows = rows.join(quantity_factors(opps, known, asof), "rep_id", "left").join(opps.select(F.col("id").alias("opportunity_id"), "ramp_months"), "opportunity_id")
    if chance is not None:
        rows = rows.join(chance.select("opportunity_id", F.col("win_prob").alias("_p")), "opportunity_id", "left")
        p = F.coalesce("_p", stage_chance(F.col("stage")))
    else:
        p = stage_chance(F.col("stage"))
    return rows.withColumns({"win_prob": p, "qty_adj": F.col("quantity_units") * F.coalesce("factor", F.lit(1.0))})


def uplift(pipeline: DataFrame, nodes: DataFrame, slip: DataFrame, delay: DataFrame, asof: Column, horizon: int = 12) -> DataFrame:
    """opportunity_id, oem, region, product, month, stage, win_prob, rep_probability, expected_units, unweighted_units: what each open opportunity brings in each of the
    coming months. It closes at its expected month plus the slip (one month ahead at the earliest), delivers first after the delay, and then evenly over its ramp."""
    rows = pipeline.select("opportunity_id", "product", "stage", "win_prob", "rep_probability", "qty_adj", F.greatest("ramp_months", F.lit(1)).alias("ramp"), months_between(F.col("expected_close_month"), asof).alias("due"))
    s = slip.select("stage", F.col("at").alias("slip"), F.col("p").alias("ps"))
    d = delay.select("product", F.col("at").alias("wait"), F.col("p").alias("pd"))
    first = rows.join(F.broadcast(s), "stage").join(d, "product")  # a dozen steps for each stage; products may be many
    first = first.withColumn("k", F.greatest(F.col("due") + F.col("slip"), F.lit(1)) + F.col("wait"))
    own = ["opportunity_id", "product", "stage", "win_prob", "rep_probability", "qty_adj", "ramp"]
    chance = first.groupBy(*own, "k").agg(steady_sum(F.col("ps") * F.col("pd")).alias("p")).filter(F.col("k") <= horizon)
    months = chance.withColumn("j", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + F.col("ramp") - 1, F.lit(horizon)))))
    share = months.groupBy(*own, "j").agg(steady_sum(F.col("p") / F.col("ramp")).alias("share"))
    out = share.join(nodes.select("opportunity_id", "oem", "region", "pct"), "opportunity_id")
    units = F.col("qty_adj") * F.col("pct") * F.col("share")
    return out.select(
        "opportunity_id", "oem", "region", "product", F.add_months(asof, F.col("j").cast("int")).alias("month"), "stage", "win_prob", "rep_probability",
        (F.col("win_prob") * units).alias("expected_units"), units.alias("unweighted_units"),
    )


def _even(*parts: Column) -> Column:
    """An even number from 0 to 1 by hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def uplift_samples(pipeline: DataFrame, nodes: DataFrame, slip: DataFrame, delay: DataFrame, asof: Column, horizon: int = 12, samples: int = 400, seed: int = 7) -> DataFrame:
    """oem, region, product, month, sample, units: drawn paths. Each opportunity's win, slip and delay are drawn by a hash of its id, the sample and ``seed``, so they can be drawn again."""

    def cumulative(df: DataFrame, key: str, name: str) -> DataFrame:
        steps = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("s"))
        return steps.select(key, F.expr("transform(sequence(1, size(s)), i -> struct(s[i - 1].at as at, aggregate(slice(s, 1, i), 0D, (t, x) -> t + x.p) as c))").alias(name))

    rows = pipeline.select("opportunity_id", "product", "stage", "win_prob", "qty_adj", F.greatest("ramp_months", F.lit(1)).alias("ramp"), months_between(F.col("expected_close_month"), asof).alias("due"))
    rows = rows.join(F.broadcast(cumulative(slip, "stage", "_slip")), "stage").join(cumulative(delay, "product", "_delay"), "product")
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draw = lambda k: _even(F.col("opportunity_id"), F.col("sample"), F.lit(seed), F.lit(k))
    pick = lambda steps, u: F.coalesce(F.filter(steps, lambda x: x["c"] >= u)[0]["at"], F.element_at(steps, -1)["at"])
    rows = rows.withColumn("_u1", draw(1)).withColumn("_u2", draw(2)).filter(draw(0) < F.col("win_prob"))
    rows = rows.withColumn("k", F.greatest(F.col("due") + pick(F.col("_slip"), F.col("_u1")), F.lit(1)) + pick(F.col("_delay"), F.col("_u2"))).filter(F.col("k") <= horizon)
    rows = rows.withColumn("j", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + F.col("ramp") - 1, F.lit(horizon)))))
    rows = rows.join(nodes.select("opportunity_id", "oem", "region", "pct"), "opportunity_id")
    return rows.groupBy("oem", "region", "product", F.add_months(asof, F.col("j").cast("int")).alias("month"), "sample").agg(F.sum(F.col("qty_adj") * F.col("pct") / F.col("ramp")).alias("units"))


def net_factors(rows: DataFrame, least: int = 80) -> DataFrame:
    """bucket, beta, n, improvement: which share of the gross uplift the baseline lacks.

    ``rows`` are the champions' backtest rows (h, y, mean) with ``gross``, the uplift as of their origin. Each bucket's least-squares slope is cut to 0 to 1 and shrunk to the
    pooled one by n / (n + 40); buckets with fewer than ``least`` rows have the pooled one. If the sum does not beat the baseline, all are zero."""
    from tidecast.operators.backtest import bucket_of

    d = rows.select(bucket_of(F.col("h")).alias("bucket"), "y", "mean", F.coalesce("gross", F.lit(0.0)).alias("gross"))
    resid = F.col("y") - F.col("mean")
    sums = [steady_sum(F.col("gross") * resid).alias("gr"), steady_sum(F.col("gross") * F.col("gross")).alias("gg"), F.count_if(F.col("gross") > 0).alias("n")]
    slope = lambda gr, gg: F.greatest(F.least(F.col(gr) / F.greatest(F.col(gg), F.lit(1e-9)), F.lit(1.0)), F.lit(0.0))
    pool = d.agg(*sums).select(F.when(F.col("n") >= least, slope("gr", "gg")).otherwise(0.0).alias("pooled"))
    spine = rows.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("bucket"))
    by = spine.join(d.groupBy("bucket").agg(*sums), "bucket", "left").fillna(0, ["n", "gr", "gg"]).crossJoin(pool)  # three rows and one
    n = F.col("n")
    by = by.withColumn("beta", F.when(n >= least, slope("gr", "gg") * n / (n + 40) + F.col("pooled") * 40 / (n + 40)).otherwise(F.col("pooled")))
    errors = d.join(F.broadcast(by.select("bucket", "beta")), "bucket").agg(steady_sum(F.abs(resid)).alias("base"), steady_sum(F.abs(resid - F.col("beta") * F.col("gross"))).alias("hybrid"))
    better = F.when(F.col("base") > 0, 1 - F.col("hybrid") / F.col("base")).otherwise(0.0)
    return by.crossJoin(errors).select("bucket", F.when(better > 0, F.col("beta")).otherwise(0.0).alias("beta"), "n", better.alias("improvement"))


def drivers(opps: DataFrame, snaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """oem, region, product, month, pipeline_open, won_qty of leaves; roll up as any measure."""
    rows = snaps.join(nodes, "opportunity_id").join(opps.select(F.col("id").alias("opportunity_id"), "product"), "opportunity_id").withColumn("q", F.col("quantity_units") * F.col("pct"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("q"))), F.lit(0.0))
    return rows.groupBy("oem", "region", "product", F.col("snapshot_month").alias("month")).agg(total(F.col("stage") <= OPEN).alias("pipeline_open"), total(F.col("stage") == WON).alias("won_qty"))


def win_chances(opps: DataFrame, snaps: DataFrame, asof: Column, trees: int = 40, least: int = LEAST_ROWS) -> DataFrame | None:
    """opportunity_id, win_prob of opportunities open at ``asof``: boosted trees, calibrated by isotonic regression on three folds by opportunity; None with too few closed rows or one outcome."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = snaps.filter(F.col("snapshot_month") <= asof)
    rows = features(opps, known).fillna(0.0, ["qty_vs_first"])
    train = rows.filter(F.col("stage") <= OPEN).join(closures(known), "opportunity_id").withColumn("fold", F.pmod(F.xxhash64("opportunity_id"), F.lit(3)))
    n, outcomes = train.agg(F.count(F.lit(1)), F.count_distinct("won")).first()
    if n < least or outcomes < 2:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    train = vector.transform(train).select("opportunity_id", "fold", F.col("won").cast("double").alias("label"), "x")
    fit = lambda df: GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=7).fit(df)
    score = lambda model, df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    unseen = None
    for k in range(3):
        part = score(fit(train.filter(F.col("fold") != k)), train.filter(F.col("fold") == k)).select("label", "p")
        unseen = part if unseen is None else unseen.unionByName(part)
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(unseen)
    now = vector.transform(rows.filter((F.col("snapshot_month") == asof) & (F.col("stage") <= OPEN)))
    out = iso.transform(score(fit(train), now).select("opportunity_id", "p"))
    return out.select("opportunity_id", F.greatest(F.least("prediction", F.lit(0.97)), F.lit(0.01)).alias("win_prob"))


def no_uplift(leaves: DataFrame, asof: Column, horizon: int = 12) -> DataFrame:
    """oem, region, product, month, units of a plan without a pipeline: zero for every leaf and coming month, so that what follows runs as with one."""
    months = F.sequence(F.add_months(asof, 1), F.add_months(asof, horizon), F.expr("interval 1 month"))
    return leaves.select("oem", "region", "product").distinct().select("*", F.explode(months).alias("month"), F.lit(0.0).alias("units"))
