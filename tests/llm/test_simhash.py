import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.operators import graph as components
from gleaner.llm.queries import op5_simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """From (id, fingerprint): least id reachable over at most 4 differing bits, by comparing all pairs."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=repr)


def test_near_duplicates_match_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op5_simhash(spark, sf).collect()), key=repr)
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in texts])


def test_hard_rows(spark):
    data = [(5, None), (3, ""), (None, " \n"), (7, "A b"), (8, "a\tB"), (None, "solo text here"), (9, " "), (9, " "), (10, "w " * 30000)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in data])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, _, c in got}, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_dense_and_chunked_groups_lose_no_link(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):  # clusters in which most pairs are near, around a few centres
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 15, 31, (1 << 64) - 1, 1 << 63}
    prints = sorted(prints)
    signed = spark.createDataFrame([(simhash.signed(f),) for f in prints], "fp long")
    for chunk in (7, 2048):
        links = simhash.near_links(signed, chunk=chunk)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in links.collect())
        roots = {r.node: r.root for r in components.least_labels(links).collect()}
        by_root = {}
        for f in prints:
            s = simhash.signed(f)
            by_root.setdefault(roots.get(s, s), set()).add(f)
        want = {}
        for i, f, c in plain_components(list(enumerate(prints))):
            want.setdefault(c, set()).add(int(f, 16))
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_split_frontier_gives_the_same_components(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) | np.uint64(5), rng.integers(0, 1 << 63, 50, np.uint64)]))
    whole = simhash.trie_links(fps, np.array([0]), np.array([len(fps)]), 4)
    monkeypatch.setattr(simhash, "MOST_PAIRS", 50)
    split = simhash.trie_links(fps, np.array([0]), np.array([len(fps)]), 4)
    label = lambda x: [a.tolist() for a in simhash._forest(*x, len(fps))]
    assert label(whole) == label(split)
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in zip(*whole, strict=True))


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in components.least_labels(edges).collect()} == {0}
    assert components.least_labels(edges.limit(0)).count() == 0
