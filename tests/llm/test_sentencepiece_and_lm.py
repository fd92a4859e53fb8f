import hashlib
import math
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import lm_score, pieces, sentencepiece_codec
from gleaner.llm.queries import op7_lm_score, op8_sentencepiece

V = pieces.load(pieces.model_path())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
CODEC = sentencepiece_codec.Codec(V)
TOY = pieces.Vocabulary({p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "bab"])}, {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -2.7, "▁a": -2.2, "ba": -3.0, "bab": -3.3}, (), 7, False)


@settings(max_examples=1500, deadline=None)
@given(st.text() | st.text("aeinrst ▁\n .,TH日本éß\0\t😀", max_size=60))
def test_ids_equal_the_librarys_and_decode_back(text):
    ids = CODEC.encode(text)
    assert list(ids) == LIBRARY.encode(text)
    assert CODEC.decode(ids).decode() == text.replace("▁", " ")


def segmentations(s, known):
    if not s:
        yield []
    for k in range(1, len(s) + 1):
        if s[:k] in known:
            for rest in segmentations(s[k:], known):
                yield [s[:k], *rest]


@given(st.text("ab", min_size=1, max_size=9))
def test_unigram_viterbi_and_lattice_over_all_segmentations(word):
    every = list(segmentations("▁" + word, TOY.scores))
    codec = sentencepiece_codec.Codec(TOY)
    best = max(sum(TOY.scores[p] for p in x) for x in every)
    got = codec.split("▁" + word)
    assert math.isclose(sum(TOY.scores[p] for p in got), best) and "".join(got) == "▁" + word
    lattice = lm_score.Lattice(TOY)
    assert math.isclose(lattice.forward(word), math.log(sum(math.exp(sum(lattice.logs[p] for p in x)) for x in every)), rel_tol=1e-9)


@given(st.text("ab", min_size=1, max_size=8), st.integers(1, 5))
def test_expected_pieces_over_all_segmentations(word, times):
    every = list(segmentations("▁" + word, TOY.scores))
    lattice = lm_score.Lattice(TOY)
    weights = [math.exp(sum(lattice.logs[p] for p in x)) for x in every]
    want = {p: sum(times * w * x.count(p) for x, w in zip(every, weights, strict=True)) / sum(weights) for p in TOY.scores}
    for how in (lattice.expect, lambda *a: lattice._expect_long("▁" + word, lattice.arcs("▁" + word), *a[1:])):
        counts = [0.0] * (len(TOY.scores) + 1)
        how(word, times, counts)
        assert counts == pytest.approx([*(want[p] for p in lattice.pieces), 0.0])


def test_codec_query_over_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.round_trip and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_codec_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a  b\n", 0), (2, "x" * 30000, 0), (2, "é" * 5000 + " q", 0)], "doc_id long, text string, ids int")
    encoded = sentencepiece_codec.encode_documents(docs, V)
    back = sentencepiece_codec.decode_documents(encoded, V)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert encoded.filter("doc_id IS NOT NULL").count() == 4 and sentencepiece_codec.encode_documents(docs.limit(0), V).count() == 0


BYTE, END = ("byte",), ("end",)  # no pieces


def plain_learned(c, ends):
    """Piece probabilities after two rounds of expected counts, by dynamic programming over every start and end."""
    start = dict(zip([*V.scores, BYTE, END], np.exp(lm_score.Lattice.from_scores(V)), strict=True))
    p, longest = start, max(map(len, V.scores))
    for _ in range(2):
        counts = dict.fromkeys(p, 0.0)
        for w, n in c.items():
            if w is None:
                continue
            s = "▁" + w.decode()
            arcs = [(a, b, s[a:b] if s[a:b] in V.scores else BYTE) for b in range(1, len(s) + 1) for a in range(max(0, b - longest), b) if s[a:b] in V.scores or (b == a + 1 and s[a] not in V.scores)]
            log = {x: math.log(p[x[2]]) * (len(s[x[0] : x[1]].encode()) if x[2] == BYTE else 1) for x in arcs}
            f, g = [0.0] + [-math.inf] * len(s), [-math.inf] * len(s) + [0.0]
            for x in arcs:
                f[x[1]] = np.logaddexp(f[x[1]], f[x[0]] + log[x])
            for x in reversed(arcs):
                g[x[0]] = np.logaddexp(g[x[0]], g[x[1]] + log[x])
                counts[x[2]] += n * math.exp(f[x[0]] + log[x] + g[x[1]] - f[-1]) * (len(s[x[0] : x[1]].encode()) if x[2] == BYTE else 1)
        counts[END] = ends
        total = sum(counts.values())
        counts[BYTE] /= 256
        p = {k: 0.99 * n / total + 0.01 * start[k] for k, n in counts.items()} if total else start
    return p


def plain_lm(data):
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c, n = {}, 0
    for i, t in data:
        if not held(i):
            for w in [*lower(t), None]:
                c[w] = c.get(w, 0) + 1
                n += 1
    v, out = len(c), []
    learned = plain_learned(c, c.get(None, 0))
    lattice = lm_score.Lattice(V, np.log(np.array([learned[k] for k in [*V.scores, BYTE, END]])))
    a = 0.5 * (v + 1)
    for i, t in data:
        tokens = [*lower(t), None]
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + a)) for w in tokens)
        g = lambda w: lattice.end10 * math.log(10) if w is None else lattice.forward(w.decode())
        mixed = sum(math.log10((c[w] + a * math.exp(g(w))) / (n + a)) if w in c else (math.log10(a / (n + a)) + g(w) / math.log(10)) for w in tokens)
        out.append((i, held(i), len(tokens), sum(w in c for w in tokens), n, base, sum(map(g, tokens)) / math.log(10), mixed))
    return out


def same(got, want):
    key = lambda r: (repr(r[:5]), r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:8] == pytest.approx(w[5:8], rel=1e-9)


def test_lm_matches_plain_counting(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same([tuple(r)[:8] for r in op7_lm_score(spark, sf_dir).collect()], plain_lm(data))


def test_lm_hard_rows(spark):
    data = [(1, None), (1, ""), (None, "a A b"), (2, "日本 é x " + "y" * 20000), (3, "a a"), (3, "a a"), (4, "▁ unseen"), (5, "b"), (6, "zz"), (7, "zz b")]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, word string")
    same([tuple(r)[:8] for r in lm_score.lm_scores(docs, V).collect()], plain_lm(data))
    assert lm_score.lm_scores(docs.limit(0), V).count() == 0


def test_lattice_is_a_distribution_over_words():
    """The sum over all words is the geometric series of the pieces that go on, after one that begins; longer words hold nearly nothing."""
    import itertools

    lattice = lm_score.Lattice(TOY)
    begin, go_on = (sum(math.exp(x) for p, x in lattice.logs.items() if p.startswith("▁") is first) for first in (True, False))
    total = sum(math.exp(lattice.forward("".join(w))) for n in range(10) for w in itertools.product("ab", repeat=n))
    assert math.isclose(total, begin / (1 - go_on), rel_tol=1e-5) and total <= 1
    assert math.isclose(begin + go_on + 256 * math.exp(lattice.byte) + lm_score.END_PROBABILITY, 1, rel_tol=1e-12)
