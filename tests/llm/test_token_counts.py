import random

import public_tokenizers
import pytest

from tidecast.llm import token_counts as tc
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", " ", "  ", "'s", "'", "x1", "\n", "\n\n", "é", "re", "...", "12", "  b", "'r", "e", "日本", "word ", "\t"]


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(open(PATH, "rb").read())


def test_edits_like_a_full_count(counter):
    r = random.Random(3)
    for k in range(400):
        text = "".join(r.choices(PARTS, k=r.randint(0, 40 if k % 4 else 900)))
        tree = tc.TokenTree.of(text, counter)
        for _ in range(4):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 0, 1, 3, 30, 500]))
            text, _ = tree.edit(text, a, b, "".join(r.choices(PARTS, k=r.choice([0, 1, 3, 30, 900]))), counter)
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(text))
            assert tree.flat() == tc.TokenTree.of(text, counter).flat()


def test_an_edit_touches_its_surroundings_only(counter):
    text = "some plain words of a text " * 4000
    tree = tc.TokenTree.of(text, counter)
    text, n = tree.edit(text, 50_000, 50_003, "new", counter)
    assert n < 10 and tree.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_offsets_are_cut_to_the_text(counter):
    tree = tc.TokenTree.of("abc", counter)
    assert tree.edit("abc", -5, 99, "xyz", counter)[0] == "xyz"
    assert tc.TokenTree.of("", counter).edit("", 3, 1, "new", counter)[0] == "new"


def test_query(spark, counter):
    docs = {r.doc_id: r for r in tc.sample_edits(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rows = tc.op5_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows[::7]:
        text = docs[r.doc_id].text
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text))
        for e in docs[r.doc_id].edits:
            a = min(max(e.start, 0), len(text))
            b = min(max(e.end, a), len(text))
            text = text[:a] + e.replacement + text[b:]
        assert r.n_tokens_edited == len(counter.encoding.encode_ordinary(text))


@pytest.mark.parametrize("size", [1000, 2])
def test_edit_log(spark, edge_docs, counter, monkeypatch, size):
    monkeypatch.setattr(tc, "ROUND", size)
    r = random.Random(8)
    log = [(r.choice([0, 1, 4, 4, 4, 11, 77]), k, r.randint(-2, 300), r.randint(0, 400), r.choice(["", None, "a b", "x's "])) for k in range(40)]
    edits = spark.createDataFrame(log, "doc_id long, seq long, start long, `end` long, replacement string")
    got = sorted((x.doc_id, x.text, x.n_tokens) for x in tc.apply_edits(tc.build(edge_docs, PATH), edits, PATH).collect() if x.doc_id in (0, 1, 4, 9, 11))
    want = []
    for d in edge_docs.collect():
        if d.doc_id in (0, 1, 4, 9, 11):
            text, changed = d.text or "", False
            for i, _, a, b, new in sorted(log, key=lambda e: e[1]):
                if i == d.doc_id:
                    a = min(max(a, 0), len(text))
                    text, changed = text[:a] + (new or "") + text[max(min(b, len(text)), a) :], True
            want.append((d.doc_id, text if changed or d.text is not None else None, len(counter.encoding.encode_ordinary(text))))
    assert got == sorted(want)


def test_empty(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "doc_id long, seq long, start long, `end` long, replacement string")
    assert tc.build(no_docs, PATH).count() == 0 == tc.recount(tc.sample_edits(no_docs), PATH).count()
    assert tc.apply_edits(tc.build(edge_docs, PATH), none, PATH).count() == edge_docs.count()
    assert tc.recount(tc.sample_edits(edge_docs), PATH).count() == edge_docs.count()
