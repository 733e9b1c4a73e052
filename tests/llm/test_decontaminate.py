import pyarrow as pa
import re
from collections import Counter

import numpy as np

from tidecast.llm import decontaminate as d
from tests.conftest import SF
from tests.llm.conftest import sentence


def _words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))


def _grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute_force(docs, items):
    """Every window of every document against every item."""
    grams = {i: _grams(_words(t)) for i, t in items}
    have = Counter(g for x in grams.values() for g in x)
    n = sum(bool(x) for x in grams.values())
    weight = lambda g: np.log(1 + n / have[g]) if g in have else np.log(1 + n)
    out = {}
    for doc, text in docs:
        words = _words(text)
        for i, t in items:
            size = min(len(_words(t)), len(words))
            if not size or not grams[i] or not set(_grams(words)) & set(grams[i]):
                continue
            for s in range(len(words) - size + 1):
                w = _grams(words[s : s + size])
                both = set(w) | set(grams[i])
                value = sum(weight(g) * min(w[g], grams[i][g]) for g in both) / sum(weight(g) * max(w[g], grams[i][g]) for g in both)
                if value >= 0.8 and value > out.get((doc, i), (0,))[0] + 1e-12:
                    out[doc, i] = (value, s, size)
    return out


def test_like_brute_force(spark):
    items = [(i, sentence(100 + i, 12 + 3 * i)) for i in range(12)] + [(20, None), (21, ""), (22, "short one"), (23, "É accents Über alles und mehr davon")]
    docs = []
    for i in range(40):
        w = sentence(i, 60).split()
        item = (items[i % 12][1]).split()
        if i % 3 == 1:
            item[len(item) // 2] = "changed"
        if i % 3 == 2:
            item = [x.upper() + "," for x in item[1:]]
        docs.append((i, " ".join(w[:20] + item + w[20:])))
    docs += [(50, None), (51, ""), (52, "Short ONE!"), (53, "x é ACCENTS über alles, und mehr davon y"), (54, items[11][1]), (55, " ".join(items[11][1].split()[:-1]))]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in d.matches(a, b).collect()}
    want = brute_force(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert (53, 23) in got and (52, 22) in got
    d_block = d.BLOCK_ITEMS
    try:
        d.BLOCK_ITEMS = 5  # weights are those of a block's items, so values may differ, not what holds an item whole
        blocks = {(r.doc_id, r.item_id) for r in d.matches(a, b).collect()}
    finally:
        d.BLOCK_ITEMS = d_block
    assert {k for k, v in want.items() if v[0] > 0.999} <= blocks


def test_query_finds_all_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in d.op4_decontaminate(spark, SF).collect()}
    plain = lambda t: " ".join(_words(t))
    held = {(x.doc_id, i.item_id) for x in docs for i in items if f" {plain(i.text)} " in f" {plain(x.text)} "}
    assert got == held and held


def test_radius_is_complete():
    """Whatever differs in at most RADIUS bits is found by the blocks."""
    rng = np.random.default_rng(3)
    index = d.Index([1], [sentence(5, 30)])
    for _ in range(200):
        bits = np.unpackbits(index.prints[0])
        flip = rng.choice(128, d.RADIUS, replace=False)
        bits[flip] ^= 1
        assert list(index.candidates(30, np.packbits(bits)[None])) == [(0, 0)]


def test_empty_tables_and_extra_columns(spark, no_docs, edge_docs):
    items = spark.createDataFrame([(1, sentence(3, 40))], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.matches(no_docs, items).count() == 0 == d.matches(edge_docs, none).count()
    assert {r.doc_id for r in d.matches(edge_docs, items).collect()} == {11}
    kept = d.clean(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert d.clean(edge_docs, none).count() == edge_docs.count()


def test_short_texts_are_one_shingle():
    (_, cut, grams, at, counts), = d.shingles(pa.array(["a b", None, "c", "a b", "one two three four five six"]))
    assert np.diff(cut).tolist() == [1, 0, 1, 1, 2] and counts.tolist() == [2, 0, 1, 2, 6]
    assert grams[0] == grams[2] != grams[1] and at.tolist() == [0, 0, 0, 0, 1]


def test_short_items_in_longer_documents(spark):
    items = spark.createDataFrame([(1, "Blue moon"), (2, "one two three four"), (3, "zebra"), (4, "moon blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "under a blue MOON we walk; a blue moon again"), (2, "zero one two three four five six"), (3, "moon, blue"), (4, "one two three and four"), (5, "zebra")], "doc_id long, text string")
    got = sorted(tuple(r) for r in d.matches(docs, items).collect())
    assert got == [(1, 1, 1.0, 2, 2), (2, 2, 1.0, 1, 4), (3, 4, 1.0, 0, 2), (5, 3, 1.0, 0, 1)]
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [4]


def test_blocks_do_not_change_similarities(spark, monkeypatch):
    common = "this very passage stands in each of the items"
    items = spark.createDataFrame([(k, f"{common} " + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(12)], "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(k, f"{common} " + " ".join(f"w{k}x{j}" for j in range(11)) + " other") for k in range(12)], "doc_id long, text string")
    whole = sorted(tuple(r) for r in d.matches(docs, items).collect())
    monkeypatch.setattr(d, "BLOCK_ITEMS", 1)
    assert len(whole) == 12 and sorted(tuple(r) for r in d.matches(docs, items).collect()) == whole
