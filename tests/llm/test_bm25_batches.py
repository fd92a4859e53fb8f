"""Batches of queries: what a row of them holds, and which documents of a shard are looked at for them."""

import numpy as np
import pyarrow as pa

from gleaner.llm import bm25


def shard_and_queries():
    rng = np.random.default_rng(3)
    docs = [np.unique(np.concatenate([rng.integers(0, 40, 20), rng.integers(40, 4000, 60)])) for _ in range(3000)]
    docs = [(d, rng.integers(1, 4, len(d))) for d in docs]
    docs += [docs[17], docs[18]]
    df = np.maximum(np.bincount(np.concatenate([d for d, _ in docs]), minlength=4000), 1)
    return bm25.Shard(np.arange(len(docs)), docs, np.arange(4000), df, len(docs), 150.0), docs, df


def all_scores(docs, df, query):
    weights = np.zeros(4000)
    weights[query[0]] = query[1]
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    return np.array([(weights[d] * idf[d] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * c.sum() / 150.0))).sum() for d, c in docs])


def test_best_of_a_batch_equals_all_scores_with_and_without_floors():
    shard, docs, df = shard_and_queries()
    queries = [docs[i] for i in range(0, 3000, 60)]
    want = [all_scores(docs, df, q) for q in queries]
    for floors in (None, np.array([np.sort(w)[-4] - 1e-6 for w in want])):
        for (keys, scores), w in zip(shard.top(queries, 4, floors)[0], want, strict=True):
            first = np.lexsort((np.arange(len(w)), -np.round(w, 9)))[:4]
            assert keys.tolist() == first.tolist()
            assert np.allclose(scores, w[first])


def test_few_documents_are_scored_where_a_floor_is_known():
    shard, docs, df = shard_and_queries()
    query = docs[120]
    floor = np.array([np.sort(all_scores(docs, df, query))[-3] - 1e-6])
    asked = []
    real = shard._reached
    shard._reached = lambda *a: [(j, asked.append(len(d)) or d) for j, d in real(*a)]
    shard.top([query], 3, floor)
    assert sum(asked) < len(docs) / 64  # by whole blocks it was all of them


def test_queries_of_a_row_come_back():
    rng = np.random.default_rng(4)
    queries = [(i << 33 | 5, np.unique(rng.integers(0, 1 << 36, i % 7)), i / 8) for i in range(300)]
    counts = [rng.integers(1, 1 << 20, len(g)).astype("<u4") for _, g, _ in queries]
    batch = pa.table({"ask": [a for a, _, _ in queries], "ids": [g.astype("<i8").tobytes() for _, g, _ in queries], "counts": [c.tobytes() for c in counts], "floor": [f for _, _, f in queries]}).to_batches()[0]
    got = []
    for row in (r for b in bm25._pack(iter([batch])) for r in b.to_pylist()):
        q = len(row["head"]) // 16
        gids, of, often = np.cumsum(bm25._from_planes(row["ids"], "<i8")), np.frombuffer(row["of"], np.uint8), bm25._from_planes(row["counts"], "<u4")
        asks, floors = np.frombuffer(row["head"][: 8 * q], "<i8"), np.frombuffer(row["head"][8 * q :], "<f8")
        got += [(int(asks[j]), gids[of == j].tolist(), often[of == j].tolist(), float(floors[j])) for j in range(q)]
    assert got == [(a, g.tolist(), c.tolist(), f) for (a, g, f), c in zip(queries, counts, strict=True)]
