import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidecast.llm import lang_id, secrets
from tests.conftest import SF
from tests.llm.test_decontaminate import _words
from tests.llm.test_near_dup import brute_force


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scratch = cp.Scratch(spark, "test")
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        kept.append({r.doc_id: r for r in docs.collect()})
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert kept[0].keys() == {i for i, r in first.items() if any(map(str.isalpha, r.text))} and all(r == first[i] for i, r in kept[0].items())
    want = {i for i, _, c in brute_force([(i, r.text) for i, r in kept[0].items()], 5) if i == c}
    assert kept[1].keys() == want
    held = {i for i, r in kept[1].items() if any(f" {' '.join(x)} " in f" {' '.join(_words(r.text))} " for x in items)}
    assert kept[2].keys() == kept[1].keys() - held and held
    assert kept[3].keys() == kept[2].keys()
    for i, r in kept[3].items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(kept[2][i].text):
            assert r.text == kept[2][i].text
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept[3].keys()
    for r in rows[::5]:
        ids = t.encode(kept[3][r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark, edge_docs, no_docs):
    docs = edge_docs
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert stage(spark, no_docs, SF).count() == 0
    assert docs.count() > 0


def test_sure_documents_stay(edge_docs):
    model = lang_id.fit(edge_docs)
    assert {r.doc_id for r in lang_id.keep(edge_docs, model, 0.0).collect()} == {r.doc_id for r in edge_docs.collect()} - {0, 1, 2, 12}
