import math

import numpy as np
import pytest

from tidecast.llm import embed_dup as E

SCHEMA = "vec_id long, embedding array<double>, label int, v int, cell string, k1 long"


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept), by all pairs."""
    good = [r is not None and len(r) > 0 and all(x is not None and math.isfinite(x) for x in r) and any(r) for _, r in rows]
    unit = [np.array(r) / max(map(abs, r)) / np.linalg.norm(np.array(r) / max(map(abs, r))) if g else None for (_, r), g in zip(rows, good, strict=True)]
    to = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in to[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((v, len(to[i]), least, v == least))
    return sorted(out, key=str)


def cluster(rng, centre, n, spread):
    return [centre + spread * rng.standard_normal(len(centre)) / math.sqrt(len(centre)) for _ in range(n)]


def found(spark, rows, threshold=0.95):
    table = spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, 2, "c", 3) for i, x in rows], SCHEMA)
    return sorted(map(tuple, E.embedding_links(table, threshold).collect()), key=str)


def test_links_of_groups_near_and_far_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    unit = [x / np.linalg.norm(x) for x in rng.standard_normal((12, 48))]
    vectors = [x for c, spread in zip(unit, (0.02, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0), strict=True) for x in cluster(rng, c, 40, spread)]
    vectors += [3.0 * vectors[0], vectors[1], vectors[1], 1e-200 * vectors[2], *rng.standard_normal((200, 48))]
    rows = [(3 * i % 997, x) for i, x in enumerate(vectors)]
    got, want = found(spark, rows), brute(rows)
    links, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # none below the threshold
    assert links >= 0.99 * all_links
    assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in want]


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * z
    got = found(spark, list(enumerate(np.concatenate([x, y]))))
    assert sum(g[1] for g in got) >= 2 * 0.95 * len(x)


def test_odd_vectors(spark):
    rng = np.random.default_rng(7)
    a = list(rng.standard_normal(8))
    odd = [None, [], [0.0] * 8, [None, *a[1:]], [float("nan"), *a[1:]], [float("inf"), *a[1:]], a, a, [2 * x for x in a], a[:4], [*a, 0.0], [1e300 * x for x in a], [5e-324] * 8, [1.0] * 8, [-x for x in a]]
    rows = [*enumerate(odd), (6, a), (None, a), (None, None), (None, list(rng.standard_normal(8)))]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(4, a)]) == [(4, 0, 4, True)]
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_one_group_of_a_third_of_all_rows_is_one_cell(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    rows = [*enumerate(cluster(rng, centre / np.linalg.norm(centre), 600, 0.05)), *enumerate(rng.standard_normal((1200, 32)), 600)]
    got = {g[0]: g[1:] for g in found(spark, rows)}
    assert all(got[i] == (599, 0, i == 0) for i in range(600))


@pytest.mark.parametrize("threshold", [0.8, 0.99])
def test_other_thresholds(spark, threshold):
    rng = np.random.default_rng(9)
    base = [x / np.linalg.norm(x) for x in rng.standard_normal((4, 40))]
    rows = list(enumerate([x for c in base for x in cluster(rng, c, 30, 0.3 if threshold < 0.9 else 0.1)]))
    got, want = found(spark, rows, threshold), brute(rows, threshold)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_rotation_lowers_the_distance_to_signs_and_bits_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16)) * np.linspace(2, 0.5, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    loss = lambda r: np.square(np.sign(x @ r) - x @ r).sum()
    first, last = E.rotation(x, np.random.default_rng(2), 0), E.rotation(x, np.random.default_rng(2), 50)
    assert np.allclose(last @ last.T, np.eye(16)) and loss(last) < loss(first)
    model = E.fit(x, 5000)
    assert model.recall >= E.RECALL and abs(model.signs(x).mean(axis=0) - 0.5).max() < 0.1
