"""Spelling variants against plain edit distance."""

import random
import re
import zlib
from collections import Counter

from gleaner.llm import spelling


def plain_words(docs, damage):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_brute_force(docs, damage=False):
    words = plain_words(docs, damage)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def got(spark, docs, damage=False, **how):
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS word", "2 AS n", "3 AS form")
    found = spelling.variants(table, damage=damage, **how)
    return sorted(tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed, n=60):
    made = random.Random(seed)
    stems = ["".join(made.choice("abé") for _ in range(made.randint(6, 8))) for _ in range(25)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(120):
            w = made.choice(stems[: made.choice([3, 25])])
            if made.random() < 0.2:
                at = made.randrange(len(w))
                w = made.choice([w[:at] + w[at + 1 :], w[:at] + made.choice("abé×") + w[at:], w[:at] + made.choice("abC") + w[at + 1 :]])
            words.append(w)
        docs.append((i, " ".join(words)))
    return docs


def test_equals_edit_distance(spark):
    docs = corpus(1)
    assert got(spark, docs) == by_brute_force(docs)


def test_damage_and_odd_rows(spark):
    docs = [*corpus(2, 40), (None, "Strasse Strasse strasse"), (7, None), (8, ""), (9, "Straßen,Straßen STRASSE"), (9, "Straßen,Straßen STRASSE"), (10, "wörterbuch wörterbücher Ünderung ünderung Ünderung")]
    assert got(spark, docs, damage=True) == by_brute_force(docs, damage=True)


def test_small_shards_and_rounds_change_nothing(spark):
    docs = corpus(3)
    assert got(spark, docs, shard_words=7, round_bytes=2000) == got(spark, docs, shard_chars=30) == by_brute_force(docs)


def test_chains_of_forms_end_at_the_root(spark):
    words = {"letterbox": 2000, "letterbix": 200, "letterbixx": 20, "leterbixx": 2, "solitary": 3}
    found = got(spark, [(1, " ".join(w for w, n in words.items() for _ in range(n)))])
    assert [(r[0], r[5]) for r in found] == [(w, "solitary" if w == "solitary" else "letterbox") for w in sorted(words)]


def test_empty_table_and_very_long_words(spark):
    assert got(spark, []) == []
    long = "ab" * 40_000
    docs = [(1, f"{long} {long} {long}x {long}x"), (2, f"{'a' * 50_000} {'a' * 50_000} {'a' * 50_001} {'a' * 50_001}")]
    assert got(spark, docs) == by_brute_force(docs)


def test_trie_gives_each_neighbour_once():
    made = random.Random(5)
    words = sorted({"".join(made.choice("ab") for _ in range(made.randint(1, 7))) for _ in range(150)})
    trie = spelling.Trie(words, list(range(1, len(words) + 1)))
    for w in [*words, "", "abababab", "c"]:
        assert sorted(x for _, x in trie.near(w)) == [x for x in words if one_edit(w, x)], w
        assert all(words[n - 1] == x for n, x in trie.near(w))
