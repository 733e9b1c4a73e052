import numpy as np

from tidecast.llm import licenses as li
from tests.conftest import SF
from tests.llm.conftest import sentence


def _scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.license, r.start, r.end, r.coverage) for r in li.scan(docs).collect())


def test_every_template_is_found_as_itself(spark):
    own = [(name, t) for name, ts in li.TEMPLATES.items() for t in ts]
    texts = ["Éé " + sentence(k, 30) + ".\n" + t + "\n" + sentence(k + 50, 30) for k, (_, t) in enumerate(own)]
    got = _scan(spark, texts)
    assert [(i, n) for i, n, *_ in got] == [(i, n) for i, (n, _) in enumerate(own)]
    for (i, _, s, e, coverage), (_, t) in zip(got, own, strict=True):
        assert coverage == 1.0 and t.startswith(texts[i][s:e]) and len(t) - (e - s) <= 2


def test_changed_and_partial_templates(spark):
    mit = li.TEMPLATES["MIT"][2]
    words = mit.split()
    changed = " ".join("CHANGED" if k % 20 == 10 else w for k, w in enumerate(words))
    put_in = " ".join([*words[:40], "three", "more", "words", *words[40:]])
    half = " ".join(words[: len(words) // 2])
    got = _scan(spark, [changed, put_in, half, mit.upper(), None, "", sentence(4, 3000), "license license license"])
    assert [(i, n) for i, n, *_ in got] == [(0, "MIT"), (1, "MIT"), (3, "MIT")]
    assert got[0][2:4] == (0, len(changed) - 1) and got[1][2:4] == (0, len(put_in) - 1)


def test_several_in_a_text_and_the_better_of_two_alike(spark):
    a, b = "Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3"
    text = f"{a}. {sentence(1, 40)} {b}. {sentence(2, 9)} {a}!"
    got = sorted(_scan(spark, [text]), key=lambda r: r[2])
    assert [(n, text[s:e]) for _, n, s, e, _ in got] == [("CC-BY-NC-4.0", a), ("GPL-3.0", b), ("CC-BY-NC-4.0", a)]


def test_alignment_like_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(100):
        t = rng.integers(0, 6, 12).astype(np.uint64)
        d = np.insert(t, 5, rng.integers(0, 6, rng.integers(0, 3)).astype(np.uint64))
        table = np.zeros((len(t) + 1, len(d) + 1), int)
        for i in range(len(t)):
            for j in range(len(d)):
                table[i + 1, j + 1] = table[i, j] + 1 if t[i] == d[j] else max(table[i, j + 1], table[i + 1, j])
        matched, first, last = li.align(t, d, 0)
        assert matched == table[-1, -1] if len(d) <= len(t) + li.BAND - 4 else matched <= table[-1, -1]
        assert 0 <= first <= last < len(d)


def test_query(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License": "MIT",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    }
    want = sorted((r.doc_id, name) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for line, name in lines.items() for _ in range(r.text.count(line)))
    assert sorted((r.doc_id, r.license) for r in li.op6_license_scan(spark, SF).collect()) == want and want


def test_edge_rows(edge_docs, no_docs):
    assert li.scan(no_docs).count() == 0
    assert li.scan(edge_docs).count() == 0
    assert li.scan(edge_docs, {}).count() == 0
    got = li.scan(edge_docs, {"own": [sentence(1, 120), "", "x"]}).collect()
    assert sorted(r.doc_id for r in got if r.template == 0) == [4, 4, 5, 6, 7, 8]
