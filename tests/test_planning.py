"""Hand-computed cases and properties of the planning operators."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import metrics, text
from tidecast.functions.quantiles import exact_quantile, exact_quantiles
from tidecast.functions.vectors import hash_embedding
from tidecast.operators import backtest, commercial, governance, hierarchy, mapping, models, panel, prices, quality, reconcile, resolution, risk, segments, windows
from tidecast.plans import estate
from tidecast.sources import sales_files

M = [date(2024 + k // 12, k % 12 + 1, 1) for k in range(48)]
MAPPING = "account_id long, oem string, region string, pct double, valid_from date, valid_to date"


def _one(df):
    return df.first()[0]


def test_mapping_by_date_and_split(spark):
    rows = [(1, "A", "R", 1.0, date(1900, 1, 1), date(2025, 4, 1)), (1, "B", "R", 1.0, date(2025, 4, 1), None), (10, "A", "R", 0.7, date(1900, 1, 1), None), (10, "B", "R", 0.3, date(1900, 1, 1), None), (20, "C", "R", 1.0, date(1900, 1, 1), None)]
    m = spark.createDataFrame(rows, MAPPING)
    facts = spark.createDataFrame(
        [(date(2025, 3, 1), 1, None, 10.0), (date(2025, 4, 1), 1, None, 20.0), (date(2025, 4, 1), 10, None, 100.0), (date(2025, 4, 1), 10, 20, 50.0), (date(2025, 4, 1), 99, None, 5.0)],
        "month date, account_id long, end_account_id long, units double",
    )
    out = mapping.map_facts(facts, m, ("units",))
    got = {(r.account_id, r.end_account_id, r.oem): r.units for r in out.collect()}
    assert got == {(1, None, "A"): 10, (1, None, "B"): 20, (10, None, "A"): 70, (10, None, "B"): pytest.approx(30), (10, 20, "C"): 50, (99, None, "UNMAPPED"): 5}
    assert _one(out.agg(F.sum("units"))) == pytest.approx(185)


def test_currencies(spark):
    fx = spark.createDataFrame([(M[0], "EUR", 1.1), (M[2], "EUR", 1.3), (M[0], "USD", 1.0)], "month date, currency string, rate double")
    rows = spark.createDataFrame([(M[0], "EUR"), (M[2], "EUR"), (M[3], "GBP")], "month date, currency string")
    assert [r.rate for r in mapping.with_rate(rows, fx).orderBy("month").collect()] == [1.3, 1.3, None]
    assert [r.rate for r in mapping.with_rate(rows, fx, "actual").orderBy("month").collect()] == [1.1, 1.3, None]
    assert [r.rate for r in mapping.with_rate(rows, fx, base_month=M[1]).orderBy("month").collect()] == [1.1, 1.1, None]
    dollars = spark.createDataFrame([(M[5], "USD")], "month date, currency string")
    assert [r.rate for r in mapping.with_rate(dollars, fx, "actual").collect()] == [1.0]


def test_set_and_review_mapping(spark):
    schema = "mapping_id long, account_id long, oem string, region string, pct double, valid_from date, valid_to date, status string"
    m = spark.createDataFrame([(1, 1, "A", "R", 1.0, date(1900, 1, 1), None, "ACTIVE"), (2, 2, "B", "R", 1.0, M[5], None, "ACTIVE"), (3, 2, "C", "R", 1.0, M[6], None, "PENDING_REVIEW")], schema)
    new = spark.createDataFrame([(1, "B", "R", 1.0, M[3])], "account_id long, oem string, region string, pct double, valid_from date")
    got = {(r.oem, r.status): (r.valid_from, r.valid_to) for r in mapping.set_mapping(m, new).filter("account_id = 1").collect()}
    assert got == {("A", "ACTIVE"): (date(1900, 1, 1), M[3]), ("B", "ACTIVE"): (M[3], None)}
    yes = spark.createDataFrame([(3, True, None, None, M[2])], "mapping_id long, approve boolean, oem string, region string, valid_from date")
    got = {r.mapping_id: (r.status, r.valid_from, r.valid_to) for r in mapping.review(m, yes).collect()}
    assert got[2] == ("SUPERSEDED", M[5], M[5]) and got[3] == ("ACTIVE", M[2], None) and got[1][0] == "ACTIVE"


def test_names(spark):
    names = ["Apple Inc.", "ROBERT BOSCH GMBH STUTTGART", "Dell'Orto SpA", "Crème & Söhne", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_name(F.col("n")).alias("x"))
    assert [r.x for r in df.collect()] == ["apple", "robert bosch stuttgart", "dell orto", "creme sohne", ""]
    pairs = spark.createDataFrame([("apple operations europe", "apple"), ("appel", "apple"), ("maple systems", "apple"), ("", "apple")], "a string, b string")
    got = [r.s for r in pairs.select(text.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] > 0.9 and got[2] < 0.6 and got[3] == 0.0
    codes = spark.createDataFrame([("all",), ("a b",), ("--A.B--",), ("",)], "n string")
    assert [r.c for r in codes.select(text.code(F.col("n"), 8).alias("c")).collect()] == ["ALL_", "A_B", "--A_B--", "X"]


def test_embedding_is_the_definition(spark):
    import zlib

    def plain(name):
        t = f" {name} "
        feats = [f"c{n}:{t[i : i + n]}" for n in (3, 4) for i in range(len(t) - n + 1)] + [f"w:{w}" for w in t.split()] * 2
        v = np.zeros(256)
        for f in feats:
            h = zlib.crc32(f.encode())
            v[h % 256] += 1 if (h >> 16) & 1 else -1
        return v / np.linalg.norm(v)

    df = spark.createDataFrame([("robert bosch",), ("",)], "n string").select(hash_embedding(F.col("n")).alias("v"))
    got = [r.v for r in df.collect()]
    assert np.allclose(got[0], plain("robert bosch")) and not any(got[1])


def test_nearest_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {}
    for q in range(10):
        sims = np.round(u @ u[q], 12)
        sims[q] = -9
        expected[q] = sorted(range(60), key=lambda i: (-sims[i], i))[:4]
    for block in (20_000, 13):
        monkeypatch.setattr(resolution, "BLOCK", block)
        got = resolution.nearest(df.filter("id < 10"), df, 4, exclude_self=True).orderBy("query", "n").collect()
        assert {q: [r.id for r in got if r["query"] == q] for q in range(10)} == expected


def test_segments_of_known_patterns(spark):
    r = np.random.default_rng(1)
    t = np.arange(48)
    patterns = {
        "smooth": 100 + r.normal(0, 5, 48), "erratic": np.abs(r.lognormal(4, 1.2, 48)) + 1, "intermittent": np.where(t % 3 == 0, 10.0, 0.0),
        "lumpy": np.where(t % 4 == 0, r.lognormal(2, 1.3, 48), 0.0), "seasonal": 100 + 60 * np.sin(2 * np.pi * t / 12) + r.normal(0, 3, 48),
    }
    df = spark.createDataFrame([(k, M[i], float(v)) for k, y in patterns.items() for i, v in enumerate(y)], "k string, month date, units double")
    got = {r.k: r.segment for r in segments.segment(df, ("k",)).collect()}
    assert got == {k: k for k in patterns}
    ten = spark.createDataFrame([("a", M[i], float(v)) for i, v in enumerate([0, 5, 0, 0, 5, 0, 5, 0, 0, 5])], "k string, month date, units double")
    row = segments.adi_cv2(ten, ("k",)).first()
    assert (row.adi, row.cv2) == (2.5, 0.0)
    none = segments.adi_cv2(ten.withColumn("units", F.lit(0.0)), ("k",)).first()
    assert none.adi is None and none.cv2 is None


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 90.0), (100.0, 80.0)], "a double, f double")
    got = df.agg(metrics.wmape(F.col("a"), F.col("f")), metrics.bias(F.col("a"), F.col("f")), metrics.mae(F.col("a"), F.col("f"))).first()
    assert tuple(got) == pytest.approx((0.15, 0.15, 15))
    for f, loss in ((8.0, 1.8), (12.0, 0.2)):
        assert _one(spark.createDataFrame([(10.0,)], "a double").agg(metrics.pinball(F.col("a"), F.lit(f), 0.9))) == pytest.approx(loss)
    ramp = spark.createDataFrame([("a", M[i], float(i)) for i in range(30)], "k string, ds date, y double")
    assert windows.mase_scale(ramp, ("k",)).first().scale == 12
    assert df.filter("a < 0").agg(metrics.wmape(F.col("a"), F.col("f"))).first()[0] is None


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_are_exact(spark, n):
    r = np.random.default_rng(n)
    x = np.round(r.normal(size=n), 1) if n > 100 else r.normal(size=n)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("g", None)], "k string, v double")
    levels = (0.0, 0.1, 0.5, 0.87, 1.0)
    row = exact_quantiles(df, ("k",), "v", [F.lit(q) for q in levels]).first()
    assert row.n == n and row.q == pytest.approx(np.quantile(x, levels).tolist())
    assert exact_quantile(df, ("k",), "v", F.least(F.lit(1.0), 0.8 * (1 + 1 / F.col("n")))).first().q == pytest.approx(np.quantile(x, min(1.0, 0.8 * (1 + 1 / n))))


def test_hierarchy(spark):
    leaves = [(o, r, p, M[0], 1.0) for o in "AB" for r in "XY" for p in "PQ"]
    df = spark.createDataFrame(leaves, "oem string, region string, product string, month date, units double")
    nodes = hierarchy.rollup(df, {"units": F.sum("units")})
    assert {r.level: r.n for r in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()} == {"TOTAL": 1, "REGION": 2, "OEM": 2, "PRODUCT": 2, "OEM_REGION": 4, "BOTTOM": 8}
    assert nodes.filter("level = 'TOTAL'").first().units == 8
    assert _one(hierarchy.coherence_error(nodes, "units")) == 0
    assert {tuple(x[:3]): x[3] for x in nodes.select("oem", "region", "product", hierarchy.level_of(F.col("oem"), F.col("region"), F.col("product")), "level").collect()}[("A", "ALL", "ALL")] == "OEM"
    grid = panel.dense(df.unionByName(df.withColumn("month", F.lit(M[2]))), ("units",))
    assert grid.count() == 24 and grid.filter(F.col("month") == M[1]).agg(F.sum("units")).first()[0] == 0


@pytest.mark.parametrize("method", reconcile.METHODS)
def test_projection(spark, method):
    df = spark.createDataFrame([(o, r, p) for o in "AB" for r in "XY" for p in "PQ"], "oem string, region string, product string")
    nodes, leaves, s = reconcile.summing(df)
    resid = np.random.default_rng(2).normal(size=(len(nodes), 30))
    p, used, _ = reconcile.fit(s, resid, method)
    assert used == method and np.abs(p @ s - np.eye(len(leaves))).max() < 1e-8
    assert reconcile.fit(s, np.zeros((len(nodes), 30)), method)[0].shape == p.shape
    y = np.random.default_rng(3).uniform(1, 9, len(nodes))
    f = spark.createDataFrame([(n, M[0], float(v)) for n, v in zip(nodes, y, strict=True)], "unique_id string, ds date, mean double")
    got = {r.unique_id: r.mean for r in reconcile.reconcile(f, df, None, "ols").collect()}
    want = s @ np.maximum(reconcile.projection(s, np.eye(len(nodes))) @ y, 0)
    assert [got[n] for n in nodes] == pytest.approx(want.tolist())


def test_shrinkage_is_the_definition():
    x = np.random.default_rng(5).normal(size=(6, 20))
    w, shrink = reconcile.shrunk_covariance(x)
    c = x - x.mean(axis=1, keepdims=True)
    z = c / np.sqrt((c * c).mean(axis=1))[:, None]
    each = z[:, None, :] * z[None, :, :]
    r = each.mean(axis=2)
    var = 20 / 19**3 * ((each - r[:, :, None]) ** 2).sum(axis=2)
    off = ~np.eye(6, dtype=bool)
    assert shrink == pytest.approx(min(1.0, var[off].sum() / (r[off] ** 2).sum())) and np.allclose(np.diag(w), (c * c).mean(axis=1))


def _plan(spark):
    rows = [(o, r, p, M[h], h, u, 1000.0) for h in (1, 2, 3) for (o, r, p, u) in (("A", "X", "P", 100.0), ("A", "Y", "P", 50.0), ("B", "X", "P", 80.0), ("B", "Y", "P", 20.0))]
    return spark.createDataFrame(rows, "oem string, region string, product string, month date, horizon int, ai_units double, asp double")


OVERRIDE = "override_id long, oem string, region string, product string, month date, override_units double, reason_code string, user_id string"


def test_consensus(spark):
    plan = _plan(spark)
    o = spark.createDataFrame([(2, "ALL", "X", "ALL", M[1], 300.0, "PROMOTION", "u"), (1, "A", "X", "P", M[1], 100.0, "OTHER", "v")], OVERRIDE)
    out, conflicts = governance.consensus(plan, o)
    got = {(r.oem, r.region): r.consensus_units for r in out.filter(F.col("month") == M[1]).collect()}
    assert got == {("A", "X"): 100, ("B", "X"): 200, ("A", "Y"): 50, ("B", "Y"): 20} and conflicts.count() == 0
    assert out.count() == plan.count() and out.filter(F.col("month") == M[2]).agg(F.sum("consensus_units")).first()[0] == 250
    o = spark.createDataFrame([(2, "ALL", "X", "ALL", M[1], 50.0, "PROMOTION", "u"), (1, "A", "X", "P", M[1], 100.0, "OTHER", "v"), (3, "A", "X", "Z", M[1], 1.0, "OTHER", "v")], OVERRIDE)
    assert {r.override_id: r.reason for r in governance.consensus(plan, o)[1].collect()} == {2: "below the sum of finer overrides", 3: "no leaves under the node"}
    one = spark.createDataFrame([(1, "A", "ALL", "ALL", M[1], 300.0, "OTHER", "v"), (2, "B", "ALL", "ALL", M[1], 10.0, "OTHER", "v")], OVERRIDE)
    key = lambda df: sorted((r.oem, r.region, str(r.month), round(r.consensus_units, 9), r.overridden, r.user_id) for r in df.collect())
    assert key(governance.consensus(plan, one)[0]) == key(governance.consensus_single_level(plan, one))


def _one_by_one(plan, overrides):
    """Overrides applied one after the other, as the rules say."""
    value, pin, bad = {k: v for k, v in plan.items()}, {}, {}
    depth = lambda o: {(1, 1, 1): 3, (1, 1, 0): 2, (1, 0, 0): 1, (0, 1, 0): 1, (0, 0, 1): 1}.get(tuple(int(x != "ALL") for x in o[1:4]), 0)
    for o in sorted(overrides, key=lambda o: (-depth(o), o[0])):
        under = [k for k in plan if k[3] == o[4] and all(x in ("ALL", y) for x, y in zip(o[1:4], k, strict=False))]
        free = [k for k in under if k not in pin]
        rest = o[5] - sum(value[k] for k in under if k in pin)
        if not under or (not free and abs(rest) > 1e-6) or (free and rest < -1e-9):
            bad[o[0]] = rest if under else None
        else:
            total = sum(plan[k] for k in free)
            value |= {k: rest * plan[k] / total if total > 1e-12 else rest / len(free) for k in free}
            pin |= dict.fromkeys(free, o[0])
    return value, pin, bad


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("classes", [governance.CLASSES, 0])  # by classes of leaves, by turns
def test_overlapping_overrides_bind_by_depth_and_id(spark, seed, classes):
    import random

    r = random.Random(seed)
    plan = {(o, g, p, M[h]): float(r.choice([0, 10, 40, 90])) for o in "AB" for g in "XYZ" for p in "PQ" for h in (1, 2)}
    some = lambda values: r.choice([*values, "ALL", "ALL"])
    overrides = [(k, some("AB"), some("XYZ"), some("PQR"), M[r.choice((1, 2))], float(r.choice([50, 200, 600, 2000])), "OTHER", f"u{k}") for k in r.sample(range(100), 25)]
    df = spark.createDataFrame([(*k, v) for k, v in plan.items()], "oem string, region string, product string, month date, ai_units double")
    out, conflicts = governance.consensus(df, spark.createDataFrame(overrides, OVERRIDE), classes)
    value, pin, bad = _one_by_one(plan, overrides)
    rows = {(x.oem, x.region, x.product, x.month): x for x in out.collect()}
    assert rows.keys() == plan.keys()
    assert {k: round(x.consensus_units, 5) for k, x in rows.items()} == {k: round(v, 5) for k, v in value.items()}
    assert {k: x.user_id for k, x in rows.items() if x.overridden} == {k: f"u{v}" for k, v in pin.items()}
    assert {x.override_id: x.residual if x.residual is None else round(x.residual, 5) for x in conflicts.collect()} == {k: v if v is None else round(v, 5) for k, v in bad.items()}


def test_many_alternating_overrides_take_a_fixed_number_of_jobs(spark):
    plan = {(f"o{o}", f"r{g}", f"p{p}", M[1]): float((o * 7 + g * 5 + p * 3) % 11) for o in range(40) for g in range(10) for p in range(40)}
    df = spark.createDataFrame([(*k, v) for k, v in plan.items()], "oem string, region string, product string, month date, ai_units double")

    def jobs(n, group):
        overrides = [(k, f"o{k // 2 % 40}" if k % 2 else "ALL", "ALL", "ALL" if k % 2 else f"p{k // 2 % 40}", M[1], 900.0 + k, "OTHER", f"u{k}") for k in range(n)]
        spark.sparkContext.setJobGroup(group, group)
        out, conflicts = governance.consensus(df, spark.createDataFrame(overrides, OVERRIDE))
        got = {(x.oem, x.region, x.product, x.month): x.consensus_units for x in out.collect()}
        bad = {x.override_id for x in conflicts.collect()}
        value, _, expected = _one_by_one(plan, overrides)
        assert {k: round(v, 4) for k, v in got.items()} == {k: round(v, 4) for k, v in value.items()} and bad == expected.keys()
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return ran

    assert jobs(80, "many") <= jobs(4, "few") + 3


def test_value_added(spark):
    rows = [("R1", "A", "X", "P", M[k], 1, 100.0, 115.0, 60.0, k == 0, "u", "OTHER") for k in range(12)]
    frozen = spark.createDataFrame(rows, "run_id string, oem string, region string, product string, month date, horizon int, ai_units double, consensus_units double, naive_units double, overridden boolean, user_id string, reason_code string")
    actual = spark.createDataFrame([("A", "X", "P", M[k], 120.0) for k in range(12)], "oem string, region string, product string, month date, y double")
    got = {(r.scope, r.horizon): r for r in governance.value_added(governance.matured(frozen, actual)).collect()}
    assert got[("ALL_ROWS", None)].n_obs == 12 and got[("ALL", None)].n_obs == 1
    assert got[("ALL", None)].fva_sales == pytest.approx(15 / 120) and got[("ALL", None)].fva_ai == pytest.approx(40 / 120)
    ci = governance.bootstrap(governance.matured(frozen, actual), ("oem",), draws=50).first()
    assert ci.ci_low == pytest.approx(15 / 120) and ci.significant


def test_audit_chain(spark):
    import hashlib

    prev, rows = governance.GENESIS, []
    for i in range(1, 5):
        own = hashlib.sha256(f"{prev}|u|SET|x|{i}|null|{i}".encode()).hexdigest()
        rows.append((i, "u", "SET", "x", str(i), None, str(i), prev, own))
        prev = own
    schema = "entry_id long, user_id string, action string, entity_type string, entity_id string, before string, after string, prev_hash string, hash string"
    log = spark.createDataFrame(rows, schema)
    assert tuple(governance.verify_chain(log).first()) == (True, None)
    assert tuple(governance.verify_chain(log.withColumn("after", F.when(F.col("entry_id") == 3, "9").otherwise(F.col("after")))).first()) == (False, 3)
    with pytest.raises(ValueError):
        governance.next_state("LOCKED", "attach")


def test_thresholds_and_severity(spark):
    t = spark.createDataFrame([(1, None, None, 0.6, True, 0.7, 3, 0.05), (2, "P", None, 0.4, True, 0.7, 3, 0.05), (3, "P", "X", 0.2, True, 0.7, 3, 0.05)], "threshold_id int, product string, region string, min_coverage double, use_history boolean, concentration double, max_stage int, min_uplift_share double")
    rows = spark.createDataFrame([("P", "X"), ("P", "Y"), ("Q", "X")], "product string, region string")
    assert {(r.product, r.region): r.min_coverage for r in risk.with_thresholds(rows, t).collect()} == {("P", "X"): 0.2, ("P", "Y"): 0.4, ("Q", "X"): 0.6}
    assert {r.min_coverage for r in risk.with_thresholds(rows, t.filter("false")).collect()} == {0.6}
    s = spark.createDataFrame([(2e6,), (3e5,), (1.0,)], "i double").select(risk.severity(F.col("i")).alias("s"))
    assert [r.s for r in s.collect()] == ["HIGH", "MEDIUM", "LOW"]


def test_uplift_keeps_its_mass(spark):
    opps = spark.createDataFrame([(1, "P", 1, M[0], 3, 100.0, None)], "id long, product string, rep_id long, created_month date, ramp_months int, quantity_units double, first_delivery_month date")
    snaps = spark.createDataFrame([(1, M[1], 3, 100.0, M[3], 1, 0, 0.5, True)], "opportunity_id long, snapshot_month date, stage int, quantity_units double, expected_close_month date, months_in_stage int, push_count int, rep_probability double, quote_issued boolean")
    nodes = spark.createDataFrame([(1, "A", "R", 0.7), (1, "B", "R", 0.3)], "opportunity_id long, oem string, region string, pct double")
    asof = F.lit(M[1])
    pipe = commercial.open_pipeline(opps, snaps, asof)
    up = commercial.uplift(pipe, nodes, commercial.slips(snaps), commercial.delays(opps, snaps, asof), asof, 48)
    assert _one(up.agg(F.sum("expected_units"))) == pytest.approx(0.30 * 100, abs=1e-4)
    draws = commercial.uplift_samples(pipe, nodes, commercial.slips(snaps), commercial.delays(opps, snaps, asof), asof, 48, samples=2000)
    assert _one(draws.agg(F.sum("units"))) / 2000 == pytest.approx(30, rel=0.08)


def test_rep_stats_do_not_see_their_own_month(spark):
    opps = spark.createDataFrame([(i, "P", 1, M[0], 1, 1.0, None) for i in (1, 2, 3)], "id long, product string, rep_id long, created_month date, ramp_months int, quantity_units double, first_delivery_month date")
    rows = [(i, M[m], 3, 0.5) for i in (1, 2, 3) for m in range(2)] + [(1, M[2], 6, 0.5), (2, M[2], 7, 0.5), (3, M[2], 3, 0.5), (3, M[3], 3, 0.5)]
    snaps = spark.createDataFrame(rows, "opportunity_id long, snapshot_month date, stage int, rep_probability double")
    got = {r.month: (r.rep_n_closed, r.rep_win_rate) for r in commercial.rep_stats(opps, snaps).collect()}
    assert got[M[2]] == (0, pytest.approx(0.3)) and got[M[3]] == (2, pytest.approx((1 + 0.3 * 6) / 8))


def test_models_and_bands(spark):
    r = np.random.default_rng(0)
    y = 100 + 30 * np.sin(2 * np.pi * np.arange(48) / 12) + r.normal(0, 3, 48)
    df = spark.createDataFrame([("a", M[i], float(v)) for i, v in enumerate(y)] + [("z", M[i], 0.0) for i in range(48)], "unique_id string, ds date, y double")
    out = models.forecast(df, tuple(models.MODELS)).collect()
    assert len(out) == 12 * 2 * 6 and all(0 <= x.q10 <= x.mean <= x.q90 for x in out)
    truth = 100 + 30 * np.sin(2 * np.pi * np.arange(48, 60) / 12)
    for m in ("AutoETS", "AutoARIMA", "SeasonalNaive"):
        f = np.array([x.mean for x in sorted(out, key=lambda x: x.h) if x.model == m and x.unique_id == "a"])
        assert np.abs(f - truth).mean() < 8
    bt = models.forecast(df, ("AutoETS",), first=18)
    assert bt.filter("unique_id = 'a'").select("origin").distinct().count() == 10
    status = {r.model: r.status for r in models.model_status(bt).collect()}
    assert status["AutoETS"] == "OK" and status["Chronos-2"] == "UNAVAILABLE" and status["TSB"] == "FAILED"


def test_champions_prefer_what_suits(spark):
    s = spark.createDataFrame([("smooth", 1, "Naive", 0.1, 9), ("smooth", 1, "TSB", 0.2, 9), ("smooth", 1, "AutoETS", 0.203, 9), ("lumpy", 1, "TSB", 0.3, 9), ("lumpy", 1, "AutoETS", 0.2, 9)], "segment string, bucket int, model string, wmape double, n long")
    got = {r.segment: (r.model, r.best_model) for r in backtest.champions(s, backtest.priors_table(spark, segments.PRIORS)).collect()}
    assert got == {"smooth": ("AutoETS", "TSB"), "lumpy": ("AutoETS", "AutoETS")}


def test_sales_files(spark, tmp_path):
    lines = ["Date,Client,SKU,Qty,Amount,Territory"] + [f"{2022 + m // 12}-{m % 12 + 1:02d}-{d},C{c},S{p},{5},{50},North" for m in range(30) for c in range(3) for p in range(2) for d in ("03", "28")]
    path = tmp_path / "sales.csv"
    path.write_text("\n".join(lines))
    df = sales_files.read_table(spark, str(path))
    columns = sales_files.suggest_columns("sales", df.columns)
    assert columns | {} == {"month": "Date", "customer": "Client", "product": "SKU", "units": "Qty", "revenue": "Amount", "price": None, "region": "Territory", "oem": None, "family": None}
    c = sales_files.canonical_sales(df, columns)
    s = sales_files.summarize_sales(c).first()
    assert (s.n_series, s.n_months, s.duplicates) == (6, 29, 29 * 6)  # the last month ends on its 28th
    few = sales_files.summary_issues(sales_files.summarize_sales(c.filter("month < '2022-11-01'")))
    assert "fewer than 18 months" in [r.issue for r in few.collect()]
    with pytest.raises(ValueError):
        sales_files.canonical_sales(df, {**columns, "units": None})
    with pytest.raises(ValueError):
        sales_files.read_table(spark, "a.xlsx")


def test_wide_daily_sales(spark):
    days = 40
    sales = spark.createDataFrame([("i1", "d1", "c1", "s1", "CA", *([1] * days)), ("i2", "d1", "c1", "s2", "TX", *([2] * days))], ["item_id", "dept_id", "cat_id", "store_id", "state_id", *(f"d_{k + 1}" for k in range(days))])
    calendar = spark.range(days).select(F.concat(F.lit("d_"), (F.col("id") + 1).cast("string")).alias("d"), F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), F.lit(1).alias("wm_yr_wk"))
    prices_ = spark.createDataFrame([("s1", "i1", 1, 2.5), ("s2", "i2", 1, 2.5)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    out = sales_files.wide_to_long(sales, calendar, prices_, ("item_id", "dept_id", "cat_id", "store_id", "state_id"), "dept_id")
    assert sorted((r.customer, r.month, r.units, r.revenue) for r in out.collect()) == [("s1", date(2024, 1, 1), 31, 77.5), ("s2", date(2024, 1, 1), 62, 155.0)]


def test_empty_tables(spark):
    none = estate.backlog(spark, "/root/testdata/sf0.001").filter("false")
    assert quality.snapshot_current(none, F.lit(M[0]), "x").first().severity == "INFO"
    history = risk.historical_coverage(none, none.select("month", "oem", "region", "product", F.col("units").alias("y")), F.lit(M[0]))
    assert history.count() == 0
    t = spark.createDataFrame([], "threshold_id int, product string, region string, min_coverage double, use_history boolean, concentration double, max_stage int, min_uplift_share double")
    plan = _plan(spark).withColumn("consensus_units", F.col("ai_units"))
    cover = risk.coverage_table(plan, none.drop("snapshot_month"), t, history)
    assert cover.count() == 12 and risk.revenue_gaps(cover).count() == 4
    zero = risk.coverage_table(plan.withColumn("consensus_units", F.lit(0.0)), none.drop("snapshot_month"), t, history)
    assert zero.filter("coverage is not null").count() == 0 and risk.revenue_gaps(zero).count() == 0


def test_prices(spark):
    rows = [("A", "R", "P", M[i], u, r) for i, (u, r) in enumerate([(0.0, 0.0), (10.0, 100.0), *[(0.0, 0.0)] * 8, (10.0, 120.0)])]
    df = spark.createDataFrame(rows, "oem string, region string, product string, month date, units double, revenue double")
    got = [r.asp for r in prices.asp_history(df).orderBy("month").collect()]
    assert got == [10, 10, 10, 10, 10, 10, 10, 10, 12, 12, 12]
    f = prices.price_forecast(prices.asp_history(df).filter("month < '2024-06-01'"), 3).collect()
    assert [r.asp for r in f] == [10, 10, 10] and {r.sigma for r in f} == {0.12}


def test_stream(spark, tmp_path):
    from tidecast.streaming.sales import monthly_sales, write_monthly

    rows = [("2024-01-05 10:00:00", "A", "R", "P", 1.0, 2.0), ("2024-01-05 12:00:00", "A", "R", "P", 1.0, 2.0), ("2024-06-05 12:00:00", "A", "R", "P", 9.0, 2.0)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "t string, oem string, region string, product string, units double, revenue double").withColumn("ship_ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)
    stream = monthly_sales(spark.readStream.schema(df.schema).parquet(src))
    write_monthly(stream, out, str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(out).groupBy("month").agg(F.sum("units").alias("u")).collect()
    assert [(str(r.month), r.u) for r in got] == [("2024-01-01", 2.0)]


def test_nearest_keeps_vectors_on_executors(spark, monkeypatch):
    from pyspark.sql import DataFrame

    for name, size in (("BLOCK", 11), ("QUERIES", 4), ("CELLS", 20)):
        monkeypatch.setattr(resolution, name, size)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("vectors in the driver"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("vectors in the driver"))
    rows = [(i, [float(i * 7 % 5 - 2), float(i * 3 % 4 - 1), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    near = resolution.nearest(df, df, 4, exclude_self=True)
    monkeypatch.undo()
    got = {(r.query, r.n): (r.id, r.sim) for r in near.collect()}
    m = np.array([v for _, v in rows])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for q in range(60):
        want = sorted((-round(float(m[q] @ m[i]), 12), i) for i in range(60) if i != q)[:4]
        assert [got[q, n][0] for n in range(1, 5)] == [i for _, i in want]
        assert [got[q, n][1] for n in range(1, 5)] == pytest.approx([-s for s, _ in want])


def test_fuzzy_mapping_scores_all_parts(spark):
    from tidecast.plans.resolution import fuzzy_mapping

    sf = "/root/testdata/sf0.001"
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    slip = {k: (n + " GmbH", n[:1] + "x" + n[2:], "Nord " + n)[k % 3] for k, n in parts.items()}
    texts = sorted({*parts.values(), *slip.values()})
    rows = spark.createDataFrame([(x,) for x in texts], "n string").select("n", hash_embedding(F.col("n")).alias("v")).collect()
    v = {r.n: np.array(r.v) for r in rows}
    aliases, mapped = sorted(set(parts.values())), sorted(k for k, n in parts.items() if n.split()[0] in ("red", "blue"))
    got = {}
    for r in fuzzy_mapping(spark, sf).collect():
        got.setdefault(r.account_id, {})[r.oem] = r
    assert set(got) == set(parts) and len(mapped) > 10
    for k, name in slip.items():
        near = {n: round(float(v[name] @ v[n]), 12) for n in aliases}
        eighth = sorted(near.values())[-8]
        best = sorted((-round(float(v[name] @ v[parts[m]]), 12), m) for m in mapped if m != k)[:5]
        total = sum(max(-s, 0) for s, _ in best)
        for oem, r in got[k].items():
            assert r.knn == pytest.approx(sum(max(-s, 0) / total for s, m in best if parts[m].split()[-1] == oem) if total else 0)
            if r.cosine:
                assert r.cosine == pytest.approx(max(s for n, s in near.items() if n.split()[-1] == oem)) and r.cosine >= eighth
        sure = {n.split()[-1] for n, s in near.items() if s > eighth} | {parts[m].split()[-1] for _, m in best}
        assert sure <= set(got[k])


def test_appended_entries_verify(spark):
    new = "seq long, user_id string, action string, entity_type string, entity_id string, before string, after string"
    rows = [(k, "u", "SET", "x", str(k), None if k % 2 else '{"b": 1, "a": [1, 2]}', '{"z": null, "k": "é"}') for k in range(30, 0, -1)]
    empty = spark.createDataFrame([], "entry_id long, user_id string, action string, entity_type string, entity_id string, before string, after string, prev_hash string, hash string")
    first = governance.append_entries(empty, spark.createDataFrame(rows, new))
    log = spark.createDataFrame(first.collect(), first.schema)
    assert [r.entity_id for r in log.orderBy("entry_id").collect()] == [str(k) for k in range(1, 31)]
    assert log.filter("entry_id = 2").first().before == '{"a":[1,2],"b":1}' and tuple(governance.verify_chain(log).first()) == (True, None)
    more = log.unionByName(governance.append_entries(log, spark.createDataFrame(rows[:3], new)))
    assert more.count() == 33 and tuple(governance.verify_chain(more).first()) == (True, None)
    assert governance.append_entries(log, spark.createDataFrame([], new)).count() == 0


def test_edits_of_mapping_lists(spark):
    oems = spark.createDataFrame([("ACME",), ("BOLT",)], "oem string")
    rules = [(1, "NAME_REGEX", 5, 1.0, "^ac", "ACME", None, True), (2, "NAME_REGEX", 5, 1.0, "(", "ACME", None, True), (3, "NAME_REGEX", 5, 1.0, "x", None, None, True), (4, "DOMAIN", 5, 1.0, None, "NONE", None, True), (5, "GUESS", 5, 1.0, None, None, None, True)]
    errors = resolution.rule_errors(spark.createDataFrame(rules, resolution.RULES_SCHEMA), oems).collect()
    assert {r.rule_id: r.error for r in errors} == {2: "the pattern cannot be read", 3: "a pattern needs a target", 4: "unknown oem", 5: "unknown kind of rule"}
    kind = "id_type string, id_value string, oem string"
    new = spark.createDataFrame([("DUNS", "1", "ACME"), ("DUNS", "2", "ACME"), ("DUNS", "3", "NONE"), ("TAX_ID", "9", "ACME"), ("TAX_ID", "9", "BOLT")], kind)
    errors = resolution.identifier_errors(new, spark.createDataFrame([("DUNS", "1", "BOLT")], kind), oems).collect()
    assert sorted((r.id_value, r.oem, r.error) for r in errors) == [("1", "ACME", "the identifier is taken"), ("3", "NONE", "unknown oem"), ("9", "ACME", "the identifier is taken"), ("9", "BOLT", "the identifier is taken")]
    aliases = resolution.add_aliases(spark.createDataFrame([("Acme Inc.", "ACME")], "alias string, oem string"), spark.createDataFrame([("ACME", "ACME"), ("Bolt GmbH", "BOLT"), ("X", "NONE")], "alias string, oem string"), oems)
    assert {(r.oem, r.normalized_alias) for r in aliases.collect()} == {("ACME", "acme"), ("BOLT", "bolt")}


def test_mapping_run(spark):
    account = "account_id long, name string, region string, account_type string, is_active boolean, global_ultimate_duns string, duns string, tax_id string, erp_parent_id string, domain string"
    rows = [(1, "Acme Works", "EMEA", "OEM", True, None, "D1", None, None, None), (2, "Bolt Motors GmbH", "EMEA", "OEM", True, None, None, None, None, None), (3, "Quite Other", "EMEA", "OEM", True, None, None, None, None, None), (4, "Acme Ltd", "APAC", "OEM", True, None, None, None, None, None), (5, "Shop", "APAC", "DISTRIBUTOR", True, None, "D1", None, None, None)]
    accounts = spark.createDataFrame(rows, account)
    mapping_now = spark.createDataFrame([(4, "ACME", "APAC", "ACTIVE")], "account_id long, oem string, region string, status string")
    aliases = spark.createDataFrame([("Acme", "ACME"), ("Bolt Motors", "BOLT")], "alias string, oem string")
    identifiers = spark.createDataFrame([("DUNS", "D1", "ACME")], "id_type string, id_value string, oem string")
    none = spark.createDataFrame([], "account_id long, oem string")
    new = resolution.mapping_run(accounts, mapping_now, resolution.default_rules(spark), identifiers, aliases, none)
    got = {r.account_id: (r.oem, r.source) for r in new.collect()}
    assert got[1] == ("ACME", "RULE_DUNS_EXACT") and got[2][0] == "BOLT" and 4 not in got and 5 not in got and 3 not in got
    assert resolution.run_summary(new).agg(F.sum("n")).first()[0] == len(got)
