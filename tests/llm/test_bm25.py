import math

import pytest

from gleaner.llm import bm25
from gleaner.llm.queries import op3_bm25


def plain(data, k=10, every=50):
    words = [(i, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()) for i, t in data]
    n, mean = len(words), max(sum(len(w) for _, w in words), 1) / max(len(words), 1)
    df, tfs = {}, []
    for i, w in words:
        tf = {}
        for x in w:
            tf[x] = tf.get(x, 0) + 1
        tfs.append(tf)
        for x in tf:
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    out = {}
    for (q, _), query in zip(words, tfs):
        if q is None or q % every:
            continue
        found = []
        for (d, w), tf in zip(words, tfs):
            if d is not None and (both := query.keys() & tf.keys()):
                norm = 1.2 * (0.25 + 0.75 * len(w) / mean)
                found.append((-sum(query[x] * idf[x] * tf[x] * 2.2 / (tf[x] + norm) for x in both), d))
        out[q] = [(d, -s) for s, d in sorted(found)[:k]]
    return out


def same(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert found.keys() == {q for q, w in want.items() if w}
    for q, rows in found.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], rel=1e-8)
        assert len({d for d, _ in rows} ^ {d for d, _ in want[q]}) == 0 or rows[-1][1] == pytest.approx(want[q][-1][1], rel=1e-8)


def test_search_over_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(op3_bm25(spark, sf).collect(), plain(data))


def test_many_shards(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 3, 7)
    same(bm25.search(docs.repartition(5), every=7, k=3).collect(), want)
    monkeypatch.setattr(bm25, "GROUP_POSTINGS", 1)  # each shard a group: floors from three of seven
    same(bm25.search(docs.repartition(7), every=7, k=3).collect(), want)


def test_hard_rows(spark):
    data = [(0, "a b"), (50, None), (100, ""), (None, "a a"), (1, "A b c"), (2, "z"), (150, "z z z"), (200, "only"), (3, "é " * 3000)]
    docs = spark.createDataFrame([(*r, 0.0) for r in data], "doc_id long, text string, score double")
    same(bm25.search(docs).collect(), plain(data))
    assert bm25.search(docs.limit(0)).count() == 0


def test_repeated_query_ids_ask_for_themselves(spark):
    data = [(50, "a b c"), (50, "x y z"), (1, "a"), (2, "x y"), (3, "q")]
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in bm25.search(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(50, 1, 50), (50, 1, 50), (50, 2, 1), (50, 2, 2)]


def test_pruning_skips_blocks():
    import numpy as np

    rng = np.random.default_rng(0)
    docs = [(np.unique(np.concatenate([[5], rng.integers(10 + 400 * (d % 4), 400 + 400 * (d % 4), 30)])), None) for d in range(4000)]
    docs = [(i, np.ones(len(i), np.int64)) for i, _ in docs]
    df = np.bincount(np.concatenate([i for i, _ in docs]), minlength=1700)
    shard = bm25.Shard(np.arange(4000), docs, np.arange(1700), np.maximum(df, 1), 4000, 31.0)
    query = docs[17][0]
    [(keys, scores)], blocks = shard.top([(query, np.ones(len(query)))], 5)
    assert keys[0] == 17 and blocks < 63 and list(scores) == sorted(scores, reverse=True)
