import hashlib
import math
import re
import zlib
from collections import Counter

from tests.conftest import SF
from tests.oracle import connect, differences
from tidecast.llm import queries
from tidecast.llm import resample as R


def grams(text, order):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, order=1, buckets=10_000, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, order)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    out = []
    for doc_id, text in docs:
        n_words, own = grams(text, order)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def test_query_equals_its_sql(spark):
    assert differences(queries.QUERIES["op12_importance_resample"](spark, SF), connect(SF), queries.SQL["op12_importance_resample"]) == []


def test_orders_and_odd_rows_equal_brute_force(spark, edge_docs, edge_rows):
    target = spark.createDataFrame([(1, "river stone and the light"), (2, None), (3, "")], "item_id long, text string")
    texts = ["river stone and the light", None, ""]
    docs = [(r[0], r[1]) for r in edge_rows] + [(None, edge_rows[4][1]), (None, None)]
    table = edge_docs.select("doc_id", "text", "lang", "n", "uid").unionByName(spark.createDataFrame([(None, edge_rows[4][1], "x", 1, 2), (None, None, "x", 1, 2)], "doc_id long, text string, lang string, n int, uid int"))
    for order in (1, 2, 3):
        for buckets, percent, least in ((10_000, 50, 2), (7, 100, 0)):
            got = R.resample(table, target, order=order, buckets=buckets, percent=percent, least_words=least).collect()
            assert sorted(map(tuple, got), key=str) == brute(docs, texts, order, buckets, percent, least), (order, buckets)


def test_empty_tables(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(no_docs, none).collect() == []
    assert R.resample(no_docs, edge_docs).collect() == []
    assert all(r["weight"] <= 0 for r in R.resample(edge_docs, none).collect() if not r["n_features"])


def test_ranks_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 20)
    docs = [(i % 150, " ".join(["word"] * (20 + i % 7))) for i in range(400)]  # ties, and ids that come twice
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string"), percent=60).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, ["word"], percent=60)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 241))
