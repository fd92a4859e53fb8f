"""Spelling variant grouping: words one edit apart, and the form that each is a variant of.

Words and their counts come from all texts by an aggregate with map-side
combine. The sorted words are cut into shards of bounded size, each a compact
(path-compressed) trie built by the task that holds its range. The shards are
broadcast, some at a time, and every word's distance-one Levenshtein automaton
is run against every one of them, depth-first: as long as no edit is spent
there is one path to follow, and what leaves it has spent the edit and must
spell the rest of the word. Counts lie in the tries, so a word's number of
neighbours and its best form are known where it is searched; pairs are never
written. What the shards give is then reduced per word.

Broadcasts are bounded: a shard holds SHARD_WORDS words and SHARD_CHARS code
points (one longer word alone may exceed that), a round ROUND_BYTES. A larger
vocabulary takes more rounds, each read from the written shards.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import text_or_empty, written

#: Least code points of a word, least occurrences, and how many times more often a form must occur.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One occurrence in so many loses a letter, as the contract's test of the operator has it.
DAMAGE = 31
SHARD_WORDS, SHARD_CHARS = 1 << 16, 4 << 20
#: Bytes of shards that are broadcast at once.
ROUND_BYTES = 48 << 20
#: Words that meet a shard in one go, and those of a task about.
BLOCK_WORDS, TASK_WORDS = 1 << 16, 1 << 14


def damaged(doc_id, run):
    """The lower-cased run, without one code point if DAMAGE divides the crc32 of "<doc_id>:<run>"."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(DAMAGE)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False) -> DataFrame:
    """word, n: runs of Latin letters, A-Z in lower case, of LEAST_LENGTH code points and LEAST_COUNT occurrences at least.

    Null and empty texts have none. damage: the runs lose letters as damaged() has it.
    """
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run"))
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = found.select(F.col("doc_id"), run.alias("run")).select((damaged(F.col("doc_id"), F.col("run")) if damage else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie over sorted words. Node i: the first letters of its children (heads), their numbers (from base on),
    the rest of the edge that leads to it (rests), and how often the word that ends there occurs (counts, 0 for none)."""

    def __init__(self, words: list[str], counts: list[int]):
        self.heads: list[str] = [""]
        self.rests: list[str] = [""]
        self.base, self.counts = array("l", [0]), array("q", [0])
        todo = [(0, 0, len(words), 0)]
        for node, lo, hi, depth in todo:
            if len(words[lo]) == depth:
                self.counts[node] = counts[lo]
                lo += 1
            self.base[node] = len(self.rests)
            heads = []
            while lo < hi:
                first = words[lo]
                end = bisect_right(words, first[: depth + 1] + chr(0x10FFFF), lo, hi)
                last = words[end - 1]
                to = depth + 1
                while to < len(first) and to < len(last) and first[to] == last[to]:
                    to += 1
                heads.append(first[depth])
                todo.append((len(self.rests), lo, end, to))
                self.rests.append(first[depth + 1 : to])
                self.heads.append("")
                self.base.append(0)
                self.counts.append(0)
                lo = end
            self.heads[node] = "".join(heads)

    def spelled(self, node: int, word: str, at: int) -> int:
        """The count at the end of word[at:], read from node on; 0 where it isn't a word."""
        heads, rests, base = self.heads, self.rests, self.base
        while at < len(word):
            k = heads[node].find(word[at])
            if k < 0:
                return 0
            node = base[node] + k
            if not word.startswith(rests[node], at + 1):
                return 0
            at += 1 + len(rests[node])
        return self.counts[node]

    def near(self, word: str) -> list[tuple[int, str]]:
        """(count, word) of the words at distance one, each once: every edit is made where the two words first differ."""
        heads, rests, base, spelled = self.heads, self.rests, self.base, self.spelled
        found, node, i, n = [], 0, 0, len(word)
        while True:
            if i == n - 1 and self.counts[node]:
                found.append((self.counts[node], word[:i]))
            here = word[i] if i < n else ""
            after = word[i + 1] if i + 1 < n else ""
            child = base[node]
            for c in heads[node]:
                if c != here:
                    rest = rests[child]
                    if here and word.startswith(rest, i + 1) and (times := spelled(child, word, i + 1 + len(rest))):
                        found.append((times, word[:i] + c + word[i + 1 :]))
                    if word.startswith(rest, i) and (times := spelled(child, word, i + len(rest))):
                        found.append((times, word[:i] + c + word[i:]))
                    if c == after and word.startswith(rest, i + 2) and (times := spelled(child, word, i + 2 + len(rest))):
                        found.append((times, word[:i] + word[i + 1 :]))
                child += 1
            k = heads[node].find(here) if here else -1
            if k < 0:
                return found
            child = base[node] + k
            rest = rests[child]
            if word.startswith(rest, i + 1):
                node, i = child, i + 1 + len(rest)
                continue
            m = 0  # the two part within the edge, after m letters of the rest
            while i + 1 + m < n and rest[m] == word[i + 1 + m]:
                m += 1
            p = i + 1 + m
            beyond = rest[m + 1 :]
            if p < n and word.startswith(beyond, p + 1) and (times := spelled(child, word, p + 1 + len(beyond))):
                found.append((times, word[:p] + rest[m] + word[p + 1 :]))
            if word.startswith(beyond, p) and (times := spelled(child, word, p + len(beyond))):
                found.append((times, word[:p] + rest[m] + word[p:]))
            if p < n and word.startswith(rest[m:], p + 1) and (times := spelled(child, word, p + 1 + len(rest) - m)):
                found.append((times, word[:p] + word[p + 1 :]))
            return found


def _shards(shard_words: int, shard_chars: int):
    """Rows (word, n) come sorted by word. Gives compact tries of bounded size."""

    def blob(words: list[str], counts: list[int]) -> pa.RecordBatch:
        data = pickle.dumps(Trie(words, counts), pickle.HIGHEST_PROTOCOL)
        return pa.RecordBatch.from_arrays([pa.array([words[0]]), pa.array([len(data)], pa.int64()), pa.array([data], pa.large_binary())], ["first", "bytes", "trie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, chars = [], [], 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if words and (len(words) >= shard_words or chars + len(word) > shard_chars):
                    yield blob(words, counts)
                    words, counts, chars = [], [], 0
                words.append(word)
                counts.append(n)
                chars += len(word)
        if words:
            yield blob(words, counts)

    return run


def _search(shards):
    """Rows (word, n). Gives word, n, n_near, and less (minus its count) and form of the best neighbour, over the shards of this round."""

    def block(words: list[str], counts: list[int]) -> pa.RecordBatch:
        near = [0] * len(words)
        best: list[tuple[int, str] | None] = [None] * len(words)
        for data in shards.value:
            trie = pickle.loads(data)
            for at, word in enumerate(words):
                for times, other in trie.near(word):
                    near[at] += 1
                    if best[at] is None or (-times, other) < best[at]:
                        best[at] = (-times, other)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(near, pa.int64()), pa.array([b and b[0] for b in best], pa.int64()), pa.array([b and b[1] for b in best], pa.string())],
            ["word", "n", "n_near", "less", "form"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            counts += batch.column("n").to_pylist()
            if len(words) >= BLOCK_WORDS:
                yield block(words, counts)
                words, counts = [], []
        if words:
            yield block(words, counts)

    return run


def rounds(shards: DataFrame, most: int) -> Iterator[list[bytes]]:
    """The tries of the written shards, as many at a time as `most` bytes hold; the list of shards has a row for SHARD_WORDS words."""
    batch, held = [], 0
    for first, size in [(r["first"], r["bytes"]) for r in shards.select("first", "bytes").orderBy("first").collect()]:
        if batch and held + size > most:
            yield [r["trie"] for r in shards.filter(F.col("first").between(batch[0], batch[-1])).select("trie").collect()]
            batch, held = [], 0
        batch.append(first)
        held += size
    if batch:
        yield [r["trie"] for r in shards.filter(F.col("first").between(batch[0], batch[-1])).select("trie").collect()]


def neighbours(words: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """From distinct words (word, n), which are written: word, n, n_near, less (minus the best neighbour's n), form (that neighbour, or null)."""
    spark: SparkSession = words.sparkSession
    total = words.count()
    shards = written(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_shards(shard_words, shard_chars), "first string, bytes long, trie binary"), "tries")
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_WORDS))
    dealt = words.repartition(tasks, "word")
    schema = "word string, n long, n_near long, less long, form string"
    found = None
    for tries in rounds(shards, round_bytes):
        shared = spark.sparkContext.broadcast(tries)
        part = written(dealt.mapInArrow(_search(shared), schema), "near-words")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form"))).alias("best"))
    return best.select("word", "n", "n_near", "best.less", "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form): (word, root), following forms to the last; a form is TIMES as frequent, so chains are short and each round halves them."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = written(now.join(then, now.root == then.via, "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False, **how) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A word's form is its most frequent neighbour at distance one (of equal
    ones the first in code-point order), if that occurs TIMES as often; root
    is the end of the chain of forms, the word itself where it has none. Null
    and empty texts have no words, repeated rows count each time, an empty
    table gives no rows, other columns are ignored. Very long runs are words
    like others.
    """
    words = written(vocabulary(docs, id_col, text_col, damage), "words")
    found = neighbours(words, **how)
    formed = F.when(-F.col("less") >= TIMES * F.col("n"), F.col("form"))
    known = written(found.select("word", "n", "n_near", formed.alias("form"), F.when(formed.isNotNull(), -F.col("less")).alias("form_n")), "word-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
