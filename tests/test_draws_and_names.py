"""Resampling that sums to the number of rows, and names that are mapped until nothing changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.config import EngineConfig
from tidecast.operators import governance, resolution


def test_dealt_draws_sum_to_the_rows_and_spread_as_multinomials_do(spark, monkeypatch):
    monkeypatch.setattr(governance, "FAN", 4)
    sizes = [40, 10, 30, 20, 25, 35, 15, 5, 60, 10, 20]  # two levels of four, one of three
    counts = spark.createDataFrame([("a", b, n) for b, n in enumerate(sizes)] + [("b", 0, 7)], "key string, bucket long, n long")
    got = {(r["key"], r["bucket"]): np.array(r["times"]) for r in governance.dealt_draws(counts, 2000, 5).collect()}
    table = np.stack([got["a", b] for b in range(len(sizes))])
    n, share = sum(sizes), np.array(sizes) / sum(sizes)
    assert (table.sum(axis=0) == n).all() and (got["b", 0] == 7).all()
    assert np.abs(table.mean(axis=1) - n * share).max() < 5 * np.sqrt(n * share.max() / 2000)
    want = n * (np.diag(share) - np.outer(share, share))
    assert np.abs(np.cov(table) - want).max() < 0.15 * want.max()


@pytest.mark.parametrize("together", [1000, 20])
def test_intervals_are_those_of_a_plain_resample(spark, monkeypatch, together):
    monkeypatch.setattr(governance, "DRAWN_TOGETHER", together)
    rng = np.random.default_rng(3)
    y = rng.gamma(2, 10, 300)
    ai, consensus = y + rng.normal(0, 4, 300), y + rng.normal(0, 3, 300)
    rows = spark.createDataFrame([("k", float(a), float(b), float(c)) for a, b, c in zip(y, ai, consensus, strict=True)] + [("few", 1.0, 2.0, 3.0)] * 5, "oem string, y double, ai_units double, consensus_units double").repartition(5)
    got = governance.bootstrap(rows, ("oem",), draws=1000).collect()
    assert [r["oem"] for r in got] == ["k"]
    at = rng.integers(0, 300, (4000, 300))
    d = (np.abs(y - ai)[at].sum(axis=1) - np.abs(y - consensus)[at].sum(axis=1)) / y[at].sum(axis=1)
    low, high = np.quantile(d, [0.025, 0.975])
    assert abs(got[0]["ci_low"] - low) < 0.1 * (high - low) and abs(got[0]["ci_high"] - high) < 0.1 * (high - low)
    assert got[0]["significant"] == (low > 0 or high < 0)


def test_rows_that_are_all_equal_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(governance, "DRAWN_TOGETHER", 50)
    rows = spark.createDataFrame([("k", 10.0, 12.0, 11.0)] * 400, "oem string, y double, ai_units double, consensus_units double")
    got = governance.bootstrap(rows, ("oem",), draws=20).first()
    assert abs(got["ci_low"] - 0.1) < 1e-12 and abs(got["ci_high"] - 0.1) < 1e-12 and got["significant"]
    assert governance.bootstrap(rows.filter("false"), ("oem",), draws=5).collect() == []


WORDS = ["alphonse", "brubeck", "cirrocumulus", "dodecahedron", "ephemeral", "firmament", "gymnastics", "hyperborean"]


def chain(spark):
    """Six accounts, each of which shares a word with the one before it alone, and a mapped one before the first."""
    accounts = spark.createDataFrame([(i, f"{WORDS[i]} {WORDS[i + 1]}", None) for i in range(1, 7)], "account_id long, name string, region string")
    mapped = spark.createDataFrame([(100, f"{WORDS[0]} {WORDS[1]}", "EU", "X")], "account_id long, name string, region string, oem string")
    aliases = spark.createDataFrame([("quizzical", "X"), ("zzz", "Y")], "alias string, oem string")
    return accounts, mapped, aliases


def test_a_chain_of_six_accounts_is_mapped_whole(spark, monkeypatch):
    accounts, mapped, aliases = chain(spark)
    # only neighbours count, and only those that share a word
    real = resolution.mapped_neighbours
    monkeypatch.setattr(resolution, "mapped_neighbours", lambda a, m: real(a, m).filter("sim > 0.3"))
    config = EngineConfig(weight_name=0.0, weight_vector=0.0, weight_knn=1.0, fuzzy_auto=0.9)
    none = spark.createDataFrame([], "account_id long, oem string")
    scored = []
    plain = resolution.scores
    monkeypatch.setattr(resolution, "scores", lambda a, *more: (scored.append(sorted(r[0] for r in a.select("account_id").collect())), plain(a, *more))[1])
    got = {r["account_id"]: (r["oem"], r["region"], r["status"]) for r in resolution.map_by_name(accounts, aliases, mapped, none, config).collect()}
    assert got == {i: ("X", "EU", "ACTIVE") for i in range(1, 7)}
    assert scored == [[1, 2, 3, 4, 5, 6], [2], [3], [4], [5], [6], []]  # later rounds score what a new voter can change
    refused = spark.createDataFrame([(3, "X")], "account_id long, oem string")
    got = {r["account_id"] for r in resolution.map_by_name(accounts, aliases, mapped, refused, config).collect()}
    assert got == {1, 2}  # the chain breaks where its oem has been rejected


def test_rounds_give_what_scoring_all_again_gives(spark):
    rng = np.random.default_rng(4)
    names = [" ".join(rng.choice(WORDS, 3)) for _ in range(60)]
    accounts = spark.createDataFrame([(i, n, "EU" if i % 3 else None) for i, n in enumerate(names[12:])], "account_id long, name string, region string")
    mapped = spark.createDataFrame([(500 + i, n, "US", "XYZ"[i % 3]) for i, n in enumerate(names[:12])], "account_id long, name string, region string, oem string")
    aliases = spark.createDataFrame([(n, "XYZ"[i % 3]) for i, n in enumerate(names[:6])], "alias string, oem string")
    none = spark.createDataFrame([], "account_id long, oem string")
    config = EngineConfig(fuzzy_auto=0.7, fuzzy_review=0.4)
    got = sorted(tuple(r) for r in resolution.map_by_name(accounts, aliases, mapped, none, config).select("account_id", "oem", "region", F.round("confidence", 9), "status").collect())
    voters, left, want, waits = mapped.collect(), accounts.collect(), [], []
    while True:
        table = spark.createDataFrame(voters, mapped.schema)
        scored = resolution.score_accounts(spark.createDataFrame(left, accounts.schema), aliases, table, config).collect()
        best = {}
        for r in sorted(scored, key=lambda r: (-r["score"], r["oem"])):
            best.setdefault(r["account_id"], r)
        hit = [r for r in best.values() if r["region"] is not None and r["score"] >= config.fuzzy_review]
        sure = [r for r in hit if r["score"] >= config.fuzzy_auto]
        waits = [r for r in hit if r["score"] < config.fuzzy_auto]
        if not sure or not left:
            break
        name = {r["account_id"]: r["name"] for r in left}
        want += sure
        voters = [tuple(v) for v in voters] + [(r["account_id"], name[r["account_id"]], r["region"], r["oem"]) for r in sure]
        left = [r for r in left if r["account_id"] not in {s["account_id"] for s in sure}]
        if not left:
            waits = []
            break
    row = lambda r, status: (r["account_id"], r["oem"], r["region"], round(r["score"], 9), status)
    assert got == sorted([row(r, "ACTIVE") for r in want] + [row(r, "PENDING_REVIEW") for r in waits])


def test_accounts_of_one_name_are_searched_for_once(spark, monkeypatch):
    """Neighbours of accounts that share names are those of all pairs, but only different names are compared."""
    words = ("red bolt", "red nut", "blue bolt", "old plate")
    accounts = spark.createDataFrame([(i, words[i % 4] + (" Ltd" if i % 3 else ""), "EU") for i in range(48)], "account_id long, name string, region string")
    mapped = spark.createDataFrame([(i, words[i % 3], "US", "O" + str(i % 5)) for i in range(0, 48, 2)], "account_id long, name string, region string, oem string")
    own = lambda df: df.select(F.col("account_id").alias("id"), resolution.hash_embedding(F.col("name")).alias("v"))
    every = sorted((r["query"], r["id"]) for r in resolution.nearest(own(accounts), own(mapped), resolution.VOTERS, exclude_self=True).collect())
    compared, nearest = [], resolution.nearest
    monkeypatch.setattr(resolution, "nearest", lambda q, v, *a, **k: compared.append((q.count(), v.count())) or nearest(q, v, *a, **k))
    got = resolution.mapped_neighbours(resolution.keyed(accounts), resolution.keyed(mapped))
    assert sorted((r["account_id"], r["id"]) for r in got.collect()) == every
    assert compared == [(4, 3 * (resolution.VOTERS + 1))]
