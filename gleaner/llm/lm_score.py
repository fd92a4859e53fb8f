"""LM scoring by subword lattice likelihood.

The scores of an existing subword vocabulary weight all segmentations of a
word; a forward recursion in log space sums them, which gives the word's
marginal probability under the lattice. A document's probability is the
product over its words, since no piece reaches over a space, times that of the
end of text.

The lattice learns from the training part of the corpus: starting at the
vocabulary's scores, ROUNDS rounds count how often each piece is expected in
the distinct training words (forward and backward sums over their lattices,
times the words' counts). The counts are summed in Spark, a row per task and
piece, and become the next weights, a share PRIOR of the old scores staying in
them. The new weights are as many as the vocabulary has pieces, and are all that
the driver sees.

mixed_score sharpens that by whole words: with c of N training tokens and V
distinct ones, P(word) = (c + a * lattice(word)) / (N + a), a = 0.5 * (V + 1).

The words of a corpus grow with it and are never broadcast. Tasks number the
words of a block of documents (BLOCK_BYTES of text); one row per block and
word is joined with the corpus counts and the lattice, and goes back to its
block as a vector, from which the block's documents are summed in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.pieces import SPACE, Vocabulary
from gleaner.llm.shared import crc_bucket, text_or_empty, written

HELD_OUT_OF, HELD_OUT = 5, 1
BLOCK_BYTES = 32 << 20
#: Lattice probability of the end of a text, and the Zipf shift for merge ranks.
END_PROBABILITY, ZIPF_SHIFT = 0.002, 10.0
SMOOTHING = 0.5
#: Rounds of learning, and the share of the vocabulary's own scores in what was learned.
ROUNDS, PRIOR = 2, 0.01

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _log_sum(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y > -math.inf else x


class Lattice:
    """Marginal probability of words over all their segmentations into pieces.

    A unigram model's scores are log-probabilities. A BPE model's scores are
    merge ranks r, which count as frequencies by Zipf's law, 1 / (r + shift).
    All pieces, the 256 bytes and the end of text sum to 1. learned: the
    logarithms that took their place (pieces, one byte, end).
    """

    def __init__(self, vocabulary: Vocabulary, learned: np.ndarray | None = None):
        self.pieces = list(vocabulary.scores)
        if learned is None:
            learned = self.from_scores(vocabulary)
        *logs, self.byte, end = learned.tolist()
        self.logs = dict(zip(self.pieces, logs, strict=True))
        self.number = {piece: i for i, piece in enumerate(self.pieces)}
        self.end10 = end / math.log(10)
        self.alphabet = frozenset("".join(self.logs))
        self.automaton = ahocorasick.Automaton()
        for i, (piece, log) in enumerate(self.logs.items()):
            self.automaton.add_word(piece, (log, len(piece), math.exp(log), i))
        self.automaton.make_automaton()

    @staticmethod
    def from_scores(vocabulary: Vocabulary) -> np.ndarray:
        scores = list(vocabulary.scores.values())
        if vocabulary.by_merge:
            floor = min(s for s in scores if s > -1e8)
            weights = [1 / (-max(s, floor) + ZIPF_SHIFT) for s in scores]
            byte = 1 / (-floor + ZIPF_SHIFT)
        else:
            weights = [math.exp(s) for s in scores]
            byte = min(weights, default=1.0)
        total = (sum(weights) + 256 * byte) / (1 - END_PROBABILITY)
        return np.log(np.array([*(np.array(weights) / total), byte / total, END_PROBABILITY]))

    def arcs(self, s: str) -> list[tuple[int, int, float]]:
        """(start, end, log) of all pieces in s, by end; characters in no piece are taken by their bytes."""
        found = [(end + 1 - length, end + 1, log) for end, (log, length, _, _) in self.automaton.iter(s)]
        if not self.alphabet.issuperset(s):
            found += [(k, k + 1, self.byte * len(c.encode())) for k, c in enumerate(s) if c not in self.logs]
            found.sort(key=lambda a: a[1])
        return found

    def expect(self, word: str, times: float, counts: list[float]) -> None:
        """Add to counts how often each piece, and last a byte, is expected in `times` of the word."""
        s = SPACE + word
        ahead, back = [0.0] * (len(s) + 1), [0.0] * (len(s) + 1)
        ahead[0] = back[-1] = 1.0
        if self.alphabet.issuperset(s):
            used = []
            for end, (_, length, w, i) in self.automaton.iter(s):
                a = end + 1 - length
                if x := ahead[a] * w:
                    ahead[end + 1] += x
                    used.append((a, end + 1, w, i, x))
            if ahead[-1] > 1e-250:
                scale = times / ahead[-1]
                for a, b, w, i, x in reversed(used):
                    if y := back[b]:
                        counts[i] += x * y * scale
                        back[a] += y * w
                return
        self._expect_long(s, self.arcs(s), times, counts)

    def _expect_long(self, s: str, arcs: list[tuple[int, int, float]], times: float, counts: list[float]) -> None:
        """The same in log space, for words whose probability is too small to write or that have characters in no piece."""
        ahead, back = [-math.inf] * (len(s) + 1), [-math.inf] * (len(s) + 1)
        ahead[0] = back[-1] = 0.0
        for a, b, log in arcs:
            ahead[b] = _log_sum(ahead[b], ahead[a] + log)
        for a, b, log in reversed(arcs):
            back[a] = _log_sum(back[a], back[b] + log)
            if (x := ahead[a] + log + back[b] - ahead[-1]) > -700:
                i = self.number.get(s[a:b])
                counts[-1 if i is None else i] += times * math.exp(x) * (len(s[a:b].encode()) if i is None else 1)

    def forward(self, word: str) -> float:
        """Natural log of the word's probability, the space mark before it included."""
        s = SPACE + word
        log1p, exp = math.log1p, math.exp
        a: list[float | None] = [None] * (len(s) + 1)
        a[0] = 0.0
        known = self.alphabet.issuperset(s)
        for start, end, log in ((e + 1 - n, e + 1, x) for e, (x, n, _, _) in self.automaton.iter(s)) if known else self.arcs(s):
            before = a[start]
            if before is None:
                continue
            x, y = before + log, a[end]
            a[end] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return a[-1] if a[-1] is not None else self.byte * len(s.encode())


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (ids as uint32 bytes) and, at the end of each block, of its words (number, training count)."""
    names = ["block", "doc_id", "held_out", "ids", "word", "number", "train"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    block = TaskContext.get().partitionId() << 20
    numbers, train, size = _Numbers(), np.zeros(0, np.int64), 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names)

    def words() -> Iterator[pa.RecordBatch]:
        listed = list(numbers)
        for lo in range(0, len(listed), 1 << 16):
            n = len(part := listed[lo : lo + (1 << 16)])
            yield rows(n, block=pa.array(np.full(n, block)), word=pa.array(part, pa.binary()).cast(pa.string()), number=pa.array(np.arange(lo, lo + n, dtype=np.int32)), train=pa.array(train[lo : lo + n]))

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            held = part.column("held_out").to_numpy(zero_copy_only=False)
            ids, learned = [], []
            for h, t in zip(held, part.column("text").cast(pa.large_binary()), strict=True):
                text = t.as_py() or b""
                size += len(text)
                found = np.array([numbers[w] for w in text.translate(_LOWER).split()], "<u4")
                ids.append(found.tobytes())
                if not h:
                    learned.append(found)
            counts = np.bincount(np.concatenate(learned) if learned else np.zeros(0, np.int64), minlength=len(numbers))
            counts[: len(train)] += train
            train = counts.astype(np.int64)
            n = part.num_rows
            yield rows(n, block=pa.array(np.full(n, block)), doc_id=part.column("doc_id"), held_out=part.column("held_out"), ids=pa.array(ids, pa.binary()))
            if size >= BLOCK_BYTES:
                yield from words()
                block, numbers, train, size = block + 1, _Numbers(), np.zeros(0, np.int64), 0
    yield from words()


def _expectations(shared):
    """Rows (word, c); gives (piece, n), a row per piece and task. A piece of -1 is all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        counts = [0.0] * (len(lattice.pieces) + 1)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                lattice.expect(word, c, counts)
        some = [(i if i < len(lattice.pieces) else -1, n) for i, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([n for _, n in some], pa.float64())], ["piece", "n"])

    return run


def learn(words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Weights of a Lattice after some rounds over the words (word, c) and so many ends of text; without any, the vocabulary's own."""
    start = Lattice.from_scores(vocabulary)
    now = start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((vocabulary, now))
        found = words.filter("c > 0").mapInArrow(_expectations(shared), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(start))
        for r in found:  # a row per piece of the vocabulary at most
            counts[r.piece if r.piece >= 0 else -2] = r.n
        counts[-1] = ends
        if not (total := counts.sum()):
            return start
        counts[-2] /= 256
        now = np.log((1 - prior) * counts / total + prior * np.exp(start))
    return now


def _with_lattice(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            logs = [lattice.forward(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logs, pa.float64())], ["word", "c", "log_lattice"])

    return run


def _score_block(train_tokens: int, distinct: int, train_docs: int, end10: float):
    def log10p(c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        a = SMOOTHING * (distinct + 1)
        return np.log10((c + a * np.exp(lattice)) / (train_tokens + a))

    def base10(c):
        return np.log10((c + SMOOTHING) / (train_tokens + SMOOTHING * (distinct + 1)))

    end = np.array([float(train_docs)])
    end_score, end_base = float(log10p(end, np.array([end10 * math.log(10)]))[0]), float(base10(end)[0])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        n = len(words)
        at = words.column("number").to_numpy()
        c, lattice = np.zeros(n), np.zeros(n)
        c[at], lattice[at] = words.column("c").to_numpy(), words.column("log_lattice").to_numpy()
        # A word of no representable probability but with counts, or none at all: the lattice in log space.
        a = SMOOTHING * (distinct + 1)
        model = np.where(c > 0, log10p(np.maximum(c, 1e-300), lattice), math.log10(a / (train_tokens + a)) + lattice / math.log(10))
        base, pure, known = base10(c), lattice / math.log(10), (c > 0)
        out = []
        for ids in docs.column("ids"):
            i = np.frombuffer(ids.as_py(), "<u4")
            out.append((len(i) + 1, int(known[i].sum()) + (train_docs > 0), float(base[i].sum()) + end_base, float(pure[i].sum()) + end10, float(model[i].sum()) + end_score))
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
        held = docs.column("held_out").combine_chunks()
        total = pa.array(np.full(len(docs), train_tokens, np.int64))
        return pa.table([docs.column("doc_id").combine_chunks(), held, columns[0], columns[1], total, *columns[2:]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"])

    return run


def lm_scores(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score.

    Tokens are words with A-Z lower-cased, then one end. Rows whose crc32 of
    the id as text, mod 5, is 1 are held out; the rest are learned from, every
    repeated row too. base_score is the sum of log10((c + 0.5) / (N + 0.5 *
    (V + 1))), score the log10 probability of the whole text under the lattice
    that was learned, mixed_score that with whole words mixed in. Null text is
    empty: one end token. A null id counts as empty text in crc32. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_bucket(id_col, HELD_OUT_OF) == HELD_OUT).alias("held_out"), text_or_empty(text_col).alias("text"))
    numbered = written(rows.mapInArrow(_number_words, "block long, doc_id long, held_out boolean, ids binary, word string, number int, train long"), "lm-blocks")
    by_block, texts = numbered.filter("number IS NOT NULL"), numbered.filter("number IS NULL").select("block", "doc_id", "held_out", "ids")
    counted = written(by_block.groupBy("word").agg(F.sum("train").alias("c")), "lm-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = texts.filter(~F.col("held_out")).count()
    weights = learn(counted, ends, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    corpus = written(counted.mapInArrow(_with_lattice(shared), "word string, c long, log_lattice double"), "lm-words")
    score = _score_block(total + ends, distinct + (ends > 0), ends, float(weights[-1]) / math.log(10))
    vectors = by_block.select(F.col("block").alias("of_block"), "word", "number").join(corpus, "word").select("of_block", "number", "c", "log_lattice")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double"
    return texts.groupBy("block").cogroup(vectors.groupBy("of_block")).applyInArrow(score, schema)
