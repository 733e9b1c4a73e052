import base64
import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidecast.llm import align as A

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return a, ranks, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def whole(text, tools):
    """Tokens of the whole text with their ends, by the libraries alone; None where they do not spell it."""
    a, ranks, b = tools
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each = []
    for ids, of in ((ids_a, ranks.get), (ids_b, spell)):
        parts = [of(i) for i in ids]
        if None in parts or b"".join(parts) != (" " + text).encode():
            return None
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        each.append(list(zip(ids, ends, strict=True)))
    return each


def brute(docs, tools):
    found, count = [], Counter()
    for doc_id, text in docs:
        if (each := whole(text, tools)) is None:
            found.append((doc_id, 0, 0, [], []))
            continue
        x, y = each
        ends = sorted({e for _, e in x} & {e for _, e in y})
        links = [(i, j) for i, e in x for j, f in y if e == f] if len(x) < 3000 else at_ends(x, y)
        groups = []
        for low, e in zip([0, *ends], ends, strict=False):
            groups.append(",".join(str(i) for i, f in x if low < f <= e) + "|" + ",".join(str(j) for j, f in y if low < f <= e) if len(ends) < 3000 else None)
        count.update(links)
        found.append((doc_id, len(x), len(y), links, groups))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, n_a, n_b, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), digest))
    return sorted(out, key=str)


def at_ends(x, y):
    at = {e: i for i, e in x}
    return [(at[e], j) for j, e in y if e in at]


def odd_texts():
    pick = random.Random(3)
    alphabet = "ab cdE  \n\t  é日本語😀½'s’▁\x00\x1c\xa0 1290,.-_<|>̈　"
    out = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 60))) for _ in range(400)]
    return [*out, "<|endoftext|>", "a <|endoftext|> b<s>", "<unk> <0x0A>", " ", "  x", "x  ", "\n\n x", "it's we'll 's", "of the of the of the", "x" * 3000]


def test_texts_cut_into_chunks_give_the_tokens_of_whole_texts(tools):
    aligner = A.Aligner(*A.vocabularies(*FILES))
    for text in odd_texts():
        chunks, each = aligner.chunks([text])[0], whole(text, tools)
        if each is None:
            assert any(c.groups is None for c in chunks), text
        else:
            joined = ";".join(c.groups for c in chunks)
            assert [int(i) for g in joined.split(";") for i in g.split("|")[0].split(",")] == [i for i, _ in each[0]], text
            assert [int(j) for g in joined.split(";") for j in g.split("|")[1].split(",")] == [j for j, _ in each[1]], text


def test_chunks_that_are_met_again_are_not_learned_again(tools, monkeypatch):
    monkeypatch.setattr(A, "CHUNKS", 40)
    aligner, learned, learn = A.Aligner(*A.vocabularies(*FILES)), Counter(), A.Aligner.learn
    monkeypatch.setattr(A.Aligner, "learn", lambda self, chunks: learned.update(chunks) or learn(self, chunks))
    for k in range(10):
        words = [f"word{k}x{i}" for i in range(30)]
        text = " ".join(["the river", *words, "stone", *words])
        joined = ";".join(c.groups for c in aligner.chunks([text])[0])
        assert [int(i) for g in joined.split(";") for i in g.split("|")[0].split(",")] == tools[0].encode(" " + text, add_special_tokens=False).ids
        assert len(aligner.known) + len(aligner.older) <= A.CHUNKS + 2 * 33
    assert learned["the"] == learned["river"] == learned["stone"] == learned["word0x0"] == 1


def test_encoding_by_ranks_is_taken_only_where_ids_follow_merges(tools):
    a, b = A.vocabularies(*FILES)
    aligner = A.Aligner(a, b)
    spec = json.loads(a)
    fast = aligner.ranked(spec)
    assert all(fast(t) == tools[0].encode(t, add_special_tokens=False).ids for t in odd_texts())
    assert aligner.ranked({**spec, "normalizer": {"type": "NFC"}}) is None
    assert aligner.ranked({**spec, "model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}) is None


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("split", [100_000, 5])
def test_counts_equal_brute_force(spark, tools, split, monkeypatch):
    monkeypatch.setattr(A, "SPLIT", split)
    docs = [(i % 300, t) for i, t in enumerate([*odd_texts(), None, "", "the river and the stone", "the river and the stone"])]
    assert rows_of(A.alignment(spark.createDataFrame(docs, "doc_id long, text string"), *A.vocabularies(*FILES))) == brute(docs, tools)


def test_odd_rows_and_empty_tables(spark, tools, edge_docs, edge_rows, no_docs):
    got = rows_of(A.alignment(edge_docs, *A.vocabularies(*FILES)))
    want = brute([(r[0], r[1]) for r in edge_rows], tools)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if w[7])  # of very long texts brute force gives no hash
    assert A.alignment(no_docs, *A.vocabularies(*FILES)).collect() == []


def test_batches_may_end_anywhere(spark, tools):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "3")
    try:
        docs = [(i, t) for i, t in enumerate(["the river and the stone", "stone of the river", "a river, a stone", "the the the"] * 3)]
        assert rows_of(A.alignment(spark.createDataFrame(docs, "doc_id long, text string"), *A.vocabularies(*FILES))) == brute(docs, tools)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
