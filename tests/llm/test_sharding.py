import itertools
import zlib
from collections import defaultdict

from tidecast.llm import sharding as sh
from tests.conftest import SF


def _check(rows, docs, shards):
    size = defaultdict(list)
    for r in rows:
        size[r.shard].append(r.slot)
    n = len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in size.values())
    assert all(n // shards <= len(size[k]) <= -(-n // shards) for k in range(shards))
    want = sorted((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}
    curve = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in curve] == sorted(r.hilbert for r in rows)


def test_query(spark):
    _check(sh.op8_hilbert_sharding(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet").collect(), 40)


def test_edge_rows(spark, edge_docs, no_docs):
    for k in (1, 3, 40):
        _check(sh.shard(edge_docs, k).collect(), edge_docs.collect(), k)
    assert sh.shard(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 5, "doc_id long, text string, lang string, source string")
    _check(sh.shard(nulls, 2).collect(), nulls.collect(), 2)


def test_ranges_are_even_however_ids_lie(spark, monkeypatch):
    """One id far from all others, and a source, language and size that all rows share: the one cell is cut."""
    monkeypatch.setattr(sh, "RANGE_ROWS", 40)
    docs = spark.createDataFrame([(k if k else 10**15, f"text {k:05}", "en", "hot") for k in range(3000)], "doc_id long, text string, lang string, source string")
    _check(sh.shard(docs, 7).collect(), docs.collect(), 7)
    rows = sh.placed(docs)
    starts = sh.range_starts(rows.select("key"), sh.RANGE_ROWS, sh.FINE, sh.PICKED)
    sizes = [r["count"] for r in rows.groupBy(sh.range_of("key", rows.schema["key"].dataType, starts)).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 200
    assert rows.select("key.hilbert").distinct().count() == 16  # ids are cut at quantiles


def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark):
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        names = [f"a{i}" for i in range(d)]
        grid = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=d)), ", ".join(f"{n} int" for n in names))
        path = sorted((r.h, tuple(r[n] for n in names)) for r in sh.hilbert_index(grid, names, bits, "h").collect())
        assert [h for h, _ in path] == list(range(1 << (bits * d)))
        assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(path, path[1:], strict=False))


def test_shards_cover_small_boxes(spark):
    """A filter on a source leaves fewer shards to read than an order by id does."""
    rows = sh.op8_hilbert_sharding(spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    both = rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"shard": "approx_count_distinct"})
    spread = sorted(r[1] for r in both.collect())
    assert spread[len(spread) // 2] < 25


def test_no_python_in_the_plan(spark, capsys):
    sh.op8_hilbert_sharding(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
