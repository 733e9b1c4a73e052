import hashlib
import random

import regex
import xxhash

from tidecast.llm import fingerprints as fp
from tests.conftest import SF
from tests.llm.conftest import sentence

ANCHORS = set(fp.ANCHORS.split())


def chains(text):
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    content = [w for w in words if w not in ANCHORS]
    out, k = set(), 0
    for w in words:
        if w in ANCHORS:
            if k + fp.CHAIN <= len(content):
                out.add(tuple(content[k : k + fp.CHAIN]))
        else:
            k += 1
    return out or {("whole", *words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def check(rows, docs):
    rank = lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh64_intdigest((d[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((d[1] or "").encode(), 42) >> 63), d[1] or "")
    texts = [t or "" for _, t in sorted(docs, key=rank)]
    ids = [i for i, _ in sorted(docs, key=rank)]
    want = []
    for k, t in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        changed = t[: len(t) - cut] + following[:cut]
        want.append((ids[k], len(t), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(chains(t), chains(changed)), 9), round(jaccard(chains(t), chains(following)), 9)))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=order) == sorted(want, key=order)


def digests(docs):
    rows = fp.edited(docs)
    near = {"near_edited": fp.likeness(rows.spots, rows.edited_spots), "near_next": fp.likeness(rows.spots, rows.next_spots)}
    from pyspark.sql import functions as F

    return rows.withColumns(near | {"edited_sha256": F.sha2("edited", 256), "fingerprint": fp.written(rows.spots)}).collect()


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = fp.op10_spot_signatures(spark, SF).collect()
    check(rows, docs)
    text, seen = dict(docs), {}
    for r in rows:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    near = sorted(r.near_edited for r in rows)
    assert near[len(near) // 2] > 0.5 and sum(r.near_next for r in rows) / len(rows) < 0.05


def test_edge_rows(spark, edge_docs, no_docs, monkeypatch):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(digests(edge_docs), docs)
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    monkeypatch.setattr(fp, "FINE", 1)
    check(digests(edge_docs), docs)
    far = [(7, "a"), (10**12, "the b c d e"), (None, "null id"), (-5, sentence(1, 50))]
    check(digests(spark.createDataFrame(far, "doc_id long, text string")), far)
    check(digests(spark.createDataFrame([(3, "the only document of a table here")], "doc_id long, text string")), [(3, "the only document of a table here")])
    assert digests(no_docs) == [] and fp.near_groups(no_docs).count() == 0
    assert len(digests(edge_docs)) == edge_docs.count() == fp.fingerprints(edge_docs).count()


def test_ranges_are_even_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 40)
    docs = [(k if k < 600 else None if k < 1000 else 7 if k < 1400 else 10**15 + k, f"text {k} {k * k}") for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = df.select(fp.order_key().alias("key"))
    sizes = [r["count"] for r in keys.groupBy(fp.range_of("key", keys.schema["key"].dataType, fp.range_starts(keys, fp.RANGE_ROWS, fp.FINE, fp.PICKED)).alias("range")).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 200
    check(digests(df), docs)


def test_near_by_partitions_and_prefixes(spark):
    r = random.Random(8)
    rows = []
    for k in range(400):
        a = set(r.sample(range(10**6), r.randint(1, 60)))
        keep = r.sample(sorted(a), max(1, round(len(a) * r.choice([0.5, 0.7, 0.8, 0.9, 1.0]))))
        b = {*keep, *r.sample(range(10**6), r.randint(0, max(0, len(a) // 5)))}
        rows.append((k, sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    from pyspark.sql import functions as F

    a, b = F.col("a"), F.col("b")
    got = {x.k: x.near for x in df.select("k", fp.near(a, b, fp.likeness(a, b)).alias("near")).collect()}
    assert got == {k: jaccard(set(a), set(b)) >= 0.8 for k, a, b in rows} and 40 < sum(got.values()) < 360


def test_near_groups(spark):
    r = random.Random(6)
    rows = []
    for g in range(12):
        words = sentence(g, 150 + 20 * g).split()
        for k in range(8):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = f"edit{r.randrange(30)}"
            rows.append((len(rows) * 2, " ".join(w)))
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    sets = [chains(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                if jaccard(sets[a], sets[b]) >= 0.8:
                    group[a] = group[b] = min(group[a], group[b])
    got = {x.doc_id: x.group_id for x in fp.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[group[k]][0] for k, (i, _) in enumerate(rows)}
    assert len(set(got.values())) < len(rows)


def test_no_python_in_the_plan(spark, capsys):
    fp.op10_spot_signatures(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
