import random
import re
from collections import Counter, defaultdict

import pytest

from tidecast.llm import near_dup
from tests.conftest import SF
from tests.llm.conftest import sentence

_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, width, threshold=80):
    """{row number: (set size, component)} with every pair compared on shingles as tuples."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[ \t-\r]+", (text or "").translate(_LOWER)) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    places = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            places[g].append(k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in places[g] if j < k).items():
            if 100 * c >= threshold * (len(s) + len(sets[j]) - c):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def _got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("width", [4, 5])
def test_edge_rows(edge_docs, width):
    out = near_dup.near_duplicates(edge_docs, width)
    assert _got(out) == brute_force([(r.doc_id, r.text) for r in edge_docs.collect()], width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_empty(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _got(near_dup.op2_near_dedup(spark, SF)) == brute_force([(r.doc_id, r.text) for r in docs.collect()], 4)


@pytest.mark.parametrize("sides", [48, 0])
def test_groups_whose_members_link_in_chains(spark, monkeypatch, sides):
    """A group with edits of many sizes: leaders link a part of it only; small blocks make pairs meet in several of them."""
    monkeypatch.setattr(near_dup, "BLOCK", 3000)
    monkeypatch.setattr(near_dup, "SIDES", sides)
    r = random.Random(5)
    words = sentence(9, 150).split()
    rows = []
    for i in range(250):
        w = list(words)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        rows.append((i * 3, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows, 4)
    assert len({c for *_, c in want}) > 5
    assert _got(near_dup.near_duplicates(docs, 4)) == want


def test_bounds():
    assert near_dup.least_matches(32, 0.8, 1e-9) < near_dup.least_matches(32, 0.8, 1e-3) <= 32
    assert near_dup.least_matches(128, 0.8, 1e-9) > 4 * near_dup.least_matches(32, 0.8, 1e-9)


def test_keep_first(edge_docs):
    kept = near_dup.keep_first(edge_docs, width=5)
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 6 not in ids and 5 not in ids and {0, 1, 2, 3, 4} <= set(ids)


def test_sieve(spark):
    """All ids pass, null ones too, and of others few; without ids nothing passes."""
    rows = spark.range(20_000).selectExpr("nullif(id, 7) AS v", "id AS n")
    ids = rows.filter("n < 500").select("v")
    passed = {r.n for r in near_dup.Sieve(ids, "v").sifted(rows, "v").collect()}
    assert set(range(500)) <= passed and len(passed) < 500 + 19_500 / 32
    assert near_dup.Sieve(ids.limit(0), "v").sifted(rows, "v").count() == 0
