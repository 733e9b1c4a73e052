import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecast.llm import bpe
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(open(PATH, encoding="utf-8").read())


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_like_the_library(library, own, text):
    assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghinorstuv' é<|>", max_size=80))
def test_letters_like_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_edge_rows(library, edge_docs, spark):
    got = sorted(tuple(r) for r in bpe.round_trip(spark, edge_docs, PATH).collect())
    assert got == sorted((r.doc_id, *_digests(library, r.text)) for r in edge_docs.collect())


def test_query(library, spark):
    rows = {r.doc_id: tuple(r)[1:] for r in bpe.op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[r.doc_id] == _digests(library, r.text) for r in docs)


def test_encode_then_decode(library, edge_docs, no_docs, spark):
    out = bpe.decode(spark, bpe.encode(spark, edge_docs, PATH), PATH)
    assert set(out.columns) == {*edge_docs.columns, "decoded"}
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark, no_docs, PATH).count() == 0 == bpe.round_trip(spark, no_docs, PATH).count()
