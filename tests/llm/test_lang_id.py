import zlib

import numpy as np

from tidecast.llm import lang_id
from tests.conftest import SF


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = lang_id.op3_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    with_letters = [r for r in held if any(map(str.isalpha, docs[r.doc_id].text or ""))]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in with_letters]) > 0.97


def test_edge_rows(edge_docs):
    rows = lang_id.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r.doc_id in (0, 1, 2, 12):  # null, empty, blank, no letter
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 < r.score <= 1


def test_nothing_to_learn_from(spark, no_docs):
    assert lang_id.identify(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in lang_id.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_own_columns_are_no_input(spark):
    """The same texts under other ids, languages and sources get the same predictions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, model).collect()}
    changed = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'none' as source")
    b = {r.doc_id - 1000000: (r.lang_pred, r.score) for r in lang_id.predict(changed, model).collect()}
    assert a == b


def test_long_text_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    table = rng.normal(size=(3, lang_id.DIMS)).astype(np.float32)
    model = lang_id.Model(["a", "b", "c"], table, np.zeros(3))
    text = "".join(rng.choice(list("abcdeé 1"), 5000))
    whole = list(model.probabilities(pa.array([text, "kurz"])))
    monkeypatch.setattr(lang_id, "BLOCK", 700)
    parts = list(model.probabilities(pa.array([text, "kurz"])))
    assert np.allclose(whole, parts)


def test_counts_by_brute_force():
    import pyarrow as pa

    text = "Ab1 éa"
    got = next(lang_id.document_counts(pa.array([text])))
    letters = [c.lower() if c.isalpha() else " " for c in text]
    runs = [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1) if any(x != " " for x in letters[i : i + n])]
    assert got.sum() == len(runs)


def test_keep(edge_docs):
    kept = lang_id.keep(edge_docs, lang_id.fit(edge_docs), 0.0)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 4
