import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import exact_dedup, mixing
from gleaner.llm.queries import op10_mixing

DOCS = "doc_id long, text string, source string, kept string, name string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in data], DOCS)


def plain_exact(data):
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, _ in data:
        groups.setdefault(flat(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t, _ in data:
        g = groups[flat(t)]
        out.append((i, min(g)[3], len(g), hashlib.sha256(flat(t).encode()).hexdigest()))
    return sorted(out, key=repr)


EDGE = [
    (5, "a b", "s"), (3, "ab", "s"), (4, "a  b", None), (9, None, "t"), (8, "", "t"), (7, " \n\t", None), (None, "ab", "s"), (None, None, "q"),
    (6, "x" * 9001, "s"), (1, "x" * 9000 + " x", "s"), (2, "x" * 9002, "s"), (10, "é\u00a0b", "s"), (11, "é b", "s"), (3, "ab", "s"), (12, "a b" * 5000, "s"), (13, "ab " * 5000, "s"),
]


def test_exact_groups_match_plain_grouping(spark):
    got = exact_dedup.exact_groups(rows(spark, EDGE), block_bytes=64).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain_exact(EDGE)
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each text, repeated rows too


def test_exact_kept_documents_and_empty_table(spark):
    docs = rows(spark, EDGE)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in exact_dedup.exact_groups(docs).filter("kept").collect())
    assert exact_dedup.exact_groups(rows(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(rows(spark, [])).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n", max_size=20), max_size=30))
def test_exact_random(spark, texts):
    data = [(i, t, "s") for i, t in enumerate(texts)]
    got = exact_dedup.exact_groups(rows(spark, data), block_bytes=3).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == plain_exact(data)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By cutting and sharing again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1, None: 70}, {"a": 10}, {"a": 1, "b": 1000, "c": 2, "d": 1, "é": 50}, {"a": 0, "b": 0}):
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_mix_meets_targets_and_repeats(spark):
    data = [(i, "w " * (1 + i * 7 % 50), "abcd"[i % 3 if i % 2 else 3]) for i in range(600)] + [(None, None, None), (7, "", "a"), (7, "", "a")]
    docs = rows(spark, data)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 + 0.01 * target[s] for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.source or "", r.size, r.doc_id or 0, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(rows(spark, [])).count() == 0


def test_mixing_query_is_whole(spark, sf_dir):
    assert op10_mixing(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
