import hashlib
import random

import pytest

from gleaner.llm import substring_dedup as sd


def plain(data, k=13):
    words = [(i, (t or "").encode().split()) for i, t in data]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - k + 1):
                key = tuple(w[a : a + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = b" ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in data], "doc_id long, text string, m string, spans int")


def test_supplied_documents(spark):
    from gleaner.llm.queries import op1_substring_dedup

    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(op1_substring_dedup(spark, "/root/testdata/sf0.01")) == plain(data)


def test_hard_rows(spark):
    p = " ".join(f"w{i}" for i in range(13))
    data = [
        (5, p), (4, p.replace(" ", "\n\t ")), (9, f"a {p} b"), (None, p), (None, None), (3, ""), (2, " \n"), (9, p + " z"), (9, p + " z"),
        (11, " ".join(["of"] * 40)), (10, " ".join(["of"] * 20)), (12, "x " * 5000 + p), (13, "y" * 40000), (14, " ".join(p.split()[:12])), (1, " ".join(p.split())), (20, None),
    ]
    docs = frame(spark, data)
    assert got(sd.dedup_substrings(docs)) == plain(data)
    kept = {r.doc_id: r.kept for r in sd.dedup_substrings(docs, keep_text=True).filter("doc_id IN (9, 12)").collect()}
    assert kept[12].split() == ["x"] * 5000
    assert sd.dedup_substrings(docs.limit(0)).count() == 0


def test_forced_equal_digests_are_found_out(spark, monkeypatch):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(5)]
    data = []
    for i in range(40):  # paths of one minimizer that differ, so digests of one bit collide
        data.append((i, " ".join([f"u{rng.randrange(9)}" for _ in range(8)] + common + [f"u{rng.randrange(9)}" for _ in range(8)])))
    data += [(100 + i, t) for i, t in data[:10]]
    assert got(sd.dedup_substrings(frame(spark, data), first_bits=1)) == plain(data)
    monkeypatch.setattr(sd, "TRIES", 1)
    with pytest.raises(RuntimeError, match="digests"):
        sd.dedup_substrings(frame(spark, data), first_bits=1)


def test_random_overlaps(spark):
    rng = random.Random(11)
    for words in (3, 40):
        base = [f"v{rng.randrange(words)}" for _ in range(400)]
        data = []
        for i in rng.sample(range(1000), 60):
            parts = []
            for _ in range(rng.randint(0, 4)):
                a = rng.randrange(380)
                parts += base[a : a + rng.randint(5, 60)] + [f"u{rng.randrange(1000)}" for _ in range(rng.randint(0, 3))]
            data.append((i, " ".join(parts)))
        assert got(sd.dedup_substrings(frame(spark, data))) == plain(data)
