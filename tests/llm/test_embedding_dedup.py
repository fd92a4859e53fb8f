"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from gleaner.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_brute_force(rows):
    """(vec_id, n_links, component_id, kept) of each row, over all pairs in double precision."""
    good = [i for i, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = (np.array(np.array(rows[k][1], np.float32), np.float64) for k in (i, j))
            if i < j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((own, len(links[i]), least, own == least))
    return sorted(out, key=repr)


def planted(groups, alone, size=16, noise=0.05, seed=3):
    made = np.random.default_rng(seed)
    vectors = []
    for n in groups:
        centre = made.standard_normal(size)
        vectors += [(centre + noise * np.linalg.norm(centre) * made.standard_normal(size) / np.sqrt(size)) * made.uniform(0.1, 9) for _ in range(n)]
    vectors += list(made.standard_normal((alone, size)))
    order = made.permutation(len(vectors))
    return [(int(k), [float(x) for x in np.float32(vectors[i])], 0) for k, i in enumerate(order)]


def got(spark, rows, **how):
    return sorted((tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def test_equals_all_pairs(spark):
    rows = planted([40, 5, 2], 60)
    assert got(spark, rows) == by_brute_force(rows)


def test_large_buckets_in_chunks_lose_and_repeat_no_link(spark):
    rows = planted([60, 30], 10, noise=0.1)
    assert got(spark, rows, chunk=7) == got(spark, rows) == by_brute_force(rows)


def test_odd_vectors_link_with_nothing_and_repeated_rows_with_each_other(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, v, 0), (1, v, 0), (2, [2.0, 4.0, 6.0, 8.0], 1), (3, None, 0), (4, [0.0] * 4, 0), (5, [1.0, None, 3.0, 4.0], 0), (6, [1.0, float("nan"), 3.0, 4.0], 0),
        (7, [1.0, float("inf"), 3.0, 4.0], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 0), (None, v, None), (10, [1e-30, 2e-30, 3e-30, 4e-30], 0), (11, [1e30, 2e30, 3e30, 4e30], 0), (None, None, 0), (12, [-1.0, -2.0, -3.0, -4.0], 0),
    ]
    assert got(spark, rows) == by_brute_force(rows)


def test_empty_table_clashing_names_and_long_vectors(spark):
    assert got(spark, []) == []
    long = [float(x % 7 + 1) for x in range(3000)]
    rows = spark.createDataFrame([(1, long, 5, 6, 7), (2, long, 5, 6, 7)], "vec_id long, embedding array<float>, node int, row int, root int")
    assert sorted(map(tuple, ed.near_duplicates(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_is_what_the_family_promises(spark):
    """Pairs at cosine 0.95 to 0.97 only, the hardest: nine in ten at least are found, and none below 0.95."""
    made = np.random.default_rng(8)
    rows = []
    for k in range(0, 600, 2):
        a = made.standard_normal(64)
        a /= np.linalg.norm(a)
        b = made.standard_normal(64)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = made.uniform(0.951, 0.97)
        rows += [(k, a.tolist(), 0), (k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    for k in range(600, 800, 2):
        a = made.standard_normal(64)
        rows += [(k, a.tolist(), 0), (k + 1, (a + 0.35 * np.linalg.norm(a) * made.standard_normal(64) / 8).tolist(), 0)]  # cosine about 0.94
    found, want = got(spark, rows), by_brute_force(rows)
    links, true = sum(r[1] for r in found), sum(r[1] for r in want)
    assert 0.95 * true <= links <= true
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))


def test_meeting_probability():
    assert ed.meets(1.0) == 1 and ed.meets(0.95) > 0.97 and ed.meets(0.97) > 0.995 and ed.meets(0.0) < 0.001


def test_equal_vectors_share_all_buckets():
    v = np.random.default_rng(1).standard_normal((5, 8))
    units, ok = ed.normalised(np.concatenate([v, 3 * v, np.zeros((1, 8))]))
    assert ok.tolist() == [True] * 10 + [False]
    assert units == pytest.approx(np.concatenate([units[:5], units[:5], np.zeros((1, 8))]))
