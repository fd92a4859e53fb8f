"""Exact top-k search: a sharded inverted index with block-max pruning for BM25.

A shard is a block of documents (SHARD_BYTES of text) with its own postings.
Document frequencies, document count and mean length are those of the whole
table, so scores of different shards compare and the merged top k is exact.

In a shard documents lie in blocks of BLOCK_DOCS. For a query, postings of rare
terms are summed for all documents; of common terms only the largest impact in
each block is known at first. Both give an upper bound of every block; without
a floor the blocks of the highest bounds are scored first, and the rest is
skipped where a bound falls below the k-th best score (block-max WAND, a block
at a time). In a block that is not, a document is scored only if its own rare
terms with the block's bound reach that score. To make bounds tight, documents
are laid out by their most frequent terms.

Queries stream past the indexes of a group of shards in batches, each of which
is a row; those and a batch of queries is all that a task holds. The square root of the groups is
searched first: a query's k-th best score there is its floor in the others,
which name only documents that reach it. So each query gathers some
2 * k * sqrt(groups) candidates rather than k from every group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import text_or_empty, written

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES = 48 << 20
BLOCK_DOCS = 64
#: Shards of small input partitions are searched together, up to so many postings.
GROUP_POSTINGS = 6_000_000
#: Queries that are scored at once, 256 at most.
BATCH_QUERIES = 128
#: A term is common in a shard if it is in at least this share of its documents.
COMMON = 1 / 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = "shard long, kind int, key long, ids binary, counts binary, word string, number int, df long"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _number_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a shard's words with their numbers and document counts; kind 1: documents as (numbers, counts), df being their words."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    shard, numbers, df, size = TaskContext.get().partitionId() << 20, _Numbers(), np.zeros(0, np.int64), 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names)

    def words() -> Iterator[pa.RecordBatch]:
        listed = list(numbers)
        for lo in range(0, len(listed), 1 << 16):
            n = len(part := listed[lo : lo + (1 << 16)])
            yield rows(n, shard=pa.array(np.full(n, shard)), kind=pa.array(np.zeros(n, np.int32)), word=pa.array(part, pa.binary()).cast(pa.string()), number=pa.array(np.arange(lo, lo + n, dtype=np.int32)), df=pa.array(df[lo : lo + n]))

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            ids, counts, seen = [], [], []
            lengths = []
            for t in part.column("text").cast(pa.large_binary()):
                text = t.as_py() or b""
                size += len(text)
                which, often = np.unique(np.array([numbers[w] for w in text.translate(_LOWER).split()], "<u4"), return_counts=True)
                ids.append(which.tobytes())
                counts.append(often.astype("<u4").tobytes())
                seen.append(which)
                lengths.append(int(often.sum()))
            now = np.bincount(np.concatenate(seen), minlength=len(numbers))
            now[: len(df)] += df
            df, n = now, part.num_rows
            yield rows(n, shard=pa.array(np.full(n, shard)), kind=pa.array(np.ones(n, np.int32)), key=part.column("doc_id"), ids=pa.array(ids, pa.binary()), counts=pa.array(counts, pa.binary()), df=pa.array(lengths, pa.int64()))
            if size >= SHARD_BYTES:
                yield from words()
                shard, numbers, df, size = shard + 1, _Numbers(), np.zeros(0, np.int64), 0
    yield from words()


class Shard:
    """The index of one shard; terms are global numbers, impacts hold idf and length."""

    def __init__(self, keys: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], gids: np.ndarray, df: np.ndarray, n_docs: int, mean: float):
        n = len(docs)
        lengths = np.array([int(c.sum()) for _, c in docs], np.float64)
        # most frequent terms first: documents of one kind or language lie together
        lead = [tuple(np.sort(i[np.lexsort((gids[i], -df[i]))[:3]])) if len(i) else () for i, _ in docs]
        top = [int(gids[i[np.argmax(c)]]) if len(i) else -1 for i, c in docs]
        order = sorted(range(n), key=lambda d: (lead[d], top[d], lengths[d]))
        self.keys = keys[order]
        by = np.argsort(gids, kind="stable")
        self.gids = gids[by]
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[order] / mean) if n else np.zeros(0)
        term = np.concatenate([docs[d][0] for d in order]) if n else np.zeros(0, np.uint32)
        impact = np.concatenate([docs[d][1] for d in order]).astype(np.float64) if n else np.zeros(0)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(docs[d][0]) for d in order])
        # in place, one temporary at a time: tf * (K1 + 1) / (tf + norm) * idf
        scale = norm[doc]
        scale += impact
        np.divide(impact, scale, out=impact)
        np.multiply(impact, K1 + 1, out=impact)
        np.take(idf, term, out=scale)
        np.multiply(impact, scale, out=impact)
        del scale
        term = rank[term]
        sort = np.argsort(term, kind="stable").astype(np.int32)  # documents stay in order within a term
        term, self.doc, self.impact = term[sort], doc[sort], impact[sort]
        self.start = np.searchsorted(term, np.arange(len(gids) + 1))
        del term, doc, impact, sort
        local = np.diff(self.start)
        common = np.flatnonzero(local >= max(8, COMMON * n))
        self.column = np.full(len(gids), -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((n, len(common)))
        for c, t in enumerate(common):
            self.dense[self.doc[self.start[t] : self.start[t + 1]], c] = self.impact[self.start[t] : self.start[t + 1]]
        self.blocks = np.arange(0, n, BLOCK_DOCS)
        self.most = np.maximum.reduceat(self.dense, self.blocks, axis=0) if n else self.dense
        self.single = self.dense.astype(np.float32)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (global terms, weights) keys and scores of the k best documents that share a term (ties: least key); and how many blocks were scored.

        floors: scores below which a document does not matter to a query.
        Bounds of all blocks come from one matrix product. For queries without
        a floor the four blocks of the highest bounds are looked at first, then
        for all queries the blocks whose bound reaches the k-th best score.
        """
        sizes = [len(gids) for gids, _ in queries]
        gids, weights = (np.concatenate(x) for x in zip(*queries, strict=True))
        return self.best(gids, weights, np.repeat(np.arange(len(queries)), sizes), len(queries), k, floors)

    def best(self, gids: np.ndarray, weights: np.ndarray, of: np.ndarray, q: int, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """top() for q queries whose terms lie in one row: gids[i] with weights[i] is a term of query of[i]."""
        n, nb = len(self.keys), len(self.blocks)
        floors = np.zeros(q) if floors is None else floors.astype(np.float64)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q, 0
        at = np.searchsorted(self.gids, gids)
        here = at < len(self.gids)
        here[here] = self.gids[at[here]] == gids[here]
        at, weights, of = at[here], weights[here], of[here]
        column = self.column[at]
        common = column >= 0
        dense = np.zeros((q, self.dense.shape[1]))
        dense[of[common], column[common]] = weights[common]
        at, weights, of = at[~common], weights[~common], of[~common]
        by = np.argsort(of, kind="stable")
        at, weights, cuts = at[by], weights[by], np.searchsorted(of[by], np.arange(q + 1)).tolist()
        start, counts = self.start[at], self.start[at + 1] - self.start[at]
        exact = np.full((q, nb * BLOCK_DOCS), -np.inf)  # the last block is filled up with what no bound reaches
        for j in range(q):
            mine = slice(cuts[j], cuts[j + 1])
            many, often = counts[mine], weights[mine]
            ends = np.cumsum(many)
            index = np.repeat(start[mine] - (ends - many), many)
            index += np.arange(len(index))
            impact = self.impact[index]
            if (often != 1).any():
                impact *= np.repeat(often, many)
            exact[j, :n] = np.bincount(self.doc[index], impact, n)
        of_block = dense @ self.most.T
        bound = exact.reshape(q, nb, BLOCK_DOCS).max(axis=2)
        bound += of_block
        asked, docs, scores, done = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        open_ = bound > 0
        # a bound is a sum in another order than a score: allow for rounding
        for loose in (bound, of_block):
            loose *= 1 + 1e-9
            loose += 1e-9
        new = np.flatnonzero(floors <= 0)
        rounds = [np.zeros((q, nb), np.bool_)] if len(new) else []
        if len(new):
            first = np.argpartition(-bound[new], min(4, nb - 1), axis=1)[:, :4]
            rounds[0][np.repeat(new, first.shape[1]), first.ravel()] = True
        for turn in [*rounds, np.ones((q, nb), np.bool_)]:
            turn &= open_ & (bound >= floors[:, None])
            open_ &= ~turn
            done += int(turn.sum())
            found = [(asked, docs, scores)]
            for j, some in self._reached(exact, of_block, dense, turn, floors):
                for lo in range(0, len(some), 1024):
                    d = some[lo : lo + 1024]
                    score = np.round(exact[j, d] + self.dense[d] @ dense[j], 9)
                    ok = (score > 0) & (score >= floors[j])
                    found.append((np.full(int(ok.sum()), j), d[ok], score[ok]))
            asked, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((self.keys[docs], -scores, asked))
            asked, docs, scores = asked[by], docs[by], scores[by]
            place = np.arange(len(asked)) - np.searchsorted(asked, asked)
            kth = place == k - 1
            floors[asked[kth]] = np.maximum(floors[asked[kth]], scores[kth])
            stay = place < k
            asked, docs, scores = asked[stay], docs[stay], scores[stay]
        cuts = np.searchsorted(asked, np.arange(q + 1)).tolist()
        return [(self.keys[docs[x:y]], scores[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], done

    def _reached(self, exact: np.ndarray, of_block: np.ndarray, dense: np.ndarray, turn: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, documents of its blocks in this turn that may reach its floor).

        A document's bound is its rare terms and its block's common ones. Of a
        query whose floor very many reach, all common terms are summed in
        single precision, for all such queries by one matrix product.
        """
        n, many, floor = len(self.keys), [], np.maximum(floors, 0.0)
        for j in np.flatnonzero(turn.any(axis=1)).tolist():
            blocks = np.flatnonzero(turn[j])
            rows = exact[j].reshape(-1, BLOCK_DOCS)[blocks]
            i, d = np.nonzero(rows + of_block[j, blocks, None] >= floor[j])
            docs = blocks[i] * BLOCK_DOCS + d
            if len(docs) * 32 > n:
                many.append((j, docs))
            else:
                yield j, docs
        for lo in range(0, len(many), 16):
            some = many[lo : lo + 16]
            near = dense[[j for j, _ in some]].astype(np.float32) @ self.single.T
            for (j, docs), sums in zip(some, near, strict=True):
                # sums of positive products: the relative error is the number of terms times 2^-24 at most, and some more of the roundings before
                slack = 1 + 2.0**-22 * (self.dense.shape[1] + 8)
                yield j, docs[exact[j, docs] + sums[docs] * slack + 1e-9 >= floor[j]]


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, so that those that are nearly always zero compress."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ask, ids, counts, floor), a query each, as rows of BATCH_QUERIES queries: what is asked and from which floor; and the terms of all, by their numbers (as differences), with the place of the query in its row and the count."""
    names, held = ["head", "ids", "of", "counts"], []

    def row() -> pa.RecordBatch:
        asks, ids, counts, floors = zip(*held, strict=True)
        gids, often = np.concatenate([np.frombuffer(x, "<i8") for x in ids]), np.concatenate([np.frombuffer(x, "<u4") for x in counts])
        of = np.repeat(np.arange(len(held), dtype=np.uint8), [len(x) // 8 for x in ids])
        by = np.argsort(gids, kind="stable")
        head = np.array(asks, "<i8").tobytes() + np.array(floors, "<f8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (head, _planes(np.diff(gids[by], prepend=0)), of[by].tobytes(), _planes(often[by]))], names)

    for batch in batches:
        for query in zip(*(batch.column(c).to_pylist() for c in ("ask", "ids", "counts", "floor")), strict=True):
            held.append(query)
            if len(held) == BATCH_QUERIES:
                yield row()
                held = []
    if held:
        yield row()


def _search(n_docs: int, mean: float, k: int):
    """Rows sorted by (grp, asks, shard, kind): a shard's words (key: global number) and documents, shard by shard, then the queries, BATCH_QUERIES in a row, as _pack() has them."""
    names, types = ["query_id", "doc_id", "score"], [pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = (None, None)
        indexes: list[Shard] = []
        words: list[tuple] = []
        keys: list[int] = []
        docs: list[tuple] = []

        def build() -> None:
            if keys:
                number, gid, df = (np.concatenate(x) for x in zip(*words, strict=True)) if words else (np.zeros(0, np.int64),) * 3
                gids, dfs = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                gids[number], dfs[number] = gid, df
                indexes.append(Shard(np.array(keys, np.int64), docs, gids, dfs, n_docs, mean))
            words.clear()
            keys.clear()
            docs.clear()

        for batch in batches:
            groups, shards, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "shard", "kind"))
            fresh = (groups[1:] != groups[:-1]) | (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])
            cuts = np.flatnonzero(np.concatenate([[True], fresh])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if (groups[lo], shards[lo]) != now:
                    build()
                    if groups[lo] != now[0]:
                        indexes.clear()
                    now = (groups[lo], shards[lo])
                if kinds[lo] == 0:
                    words.append(tuple(part.column(c).to_numpy() for c in ("number", "key", "df")))
                elif kinds[lo] == 1:
                    keys += part.column("key").to_pylist()
                    docs += [(np.frombuffer(i.as_py(), "<u4"), np.frombuffer(c.as_py(), "<u4")) for i, c in zip(part.column("ids"), part.column("counts"), strict=True)]
                else:
                    for row in range(part.num_rows):
                        head, ids, of, counts = (part.column(c)[row].as_py() for c in ("head", "ids", "of", "counts"))
                        q = len(head) // 16
                        asks, least = np.frombuffer(head[: q * 8], "<i8"), np.frombuffer(head[q * 8 :], "<f8")
                        terms = np.cumsum(_from_planes(ids, "<i8")), _from_planes(counts, "<u4").astype(np.float64), np.frombuffer(of, np.uint8).astype(np.int64)
                        best = [(np.zeros(0, np.int64), np.zeros(0))] * q
                        for index in indexes:
                            floors = np.maximum(least, [s[-1] if len(s) == k else 0.0 for _, s in best])
                            for j, (more, score) in enumerate(index.best(*terms, q, k, floors)[0]):
                                if len(more):
                                    both, scores = np.concatenate([best[j][0], more]), np.concatenate([best[j][1], score])
                                    first = np.lexsort((both, -scores))[:k]
                                    best[j] = both[first], scores[first]
                        out = [(np.full(len(found), ask), found, score) for ask, (found, score) in zip(asks.tolist(), best, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _global_ids(docs: pa.Table, words: pa.Table) -> pa.Table:
    """A shard's queries with global instead of shard numbers."""
    gids = np.zeros(len(words), np.int64)
    gids[words.column("number").to_numpy()] = words.column("key").to_numpy()
    ids = [gids[np.frombuffer(i.as_py(), "<u4")].astype("<i8").tobytes() for i in docs.column("ids")]
    return pa.table([docs.column("key").combine_chunks(), pa.array(ids, pa.binary()), docs.column("counts").combine_chunks()], ["key", "ids", "counts"])


def search(docs: DataFrame, every: int = 50, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents by BM25 for each document whose id is divisible by `every`.

    Whole texts are queries and documents alike; words are lower-cased (A-Z),
    a query's word counts as often as it stands there. Returns query_id,
    rank, doc_id, score; documents that share no word do not appear, ties go
    to the least id, the query's own document is among the found. Null texts
    are empty: they find nothing and are not found. Rows with a null id are
    counted but neither ask nor are found; of rows that repeat an id each
    asks for itself, with ranks of its own, and each is found once. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    numbered = written(rows.mapInArrow(_number_words, _ROWS), "bm25-shards")
    words, texts = numbered.filter("kind = 0"), numbered.filter("kind = 1")
    corpus = written(words.groupBy("word").agg(F.sum("df").alias("df")).withColumn("gid", F.monotonically_increasing_id()), "bm25-words")
    n_docs = texts.count()
    total = texts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    placed = words.select("shard", "word", "number").join(corpus, "word").select("shard", F.lit(0).alias("kind"), F.col("gid").alias("key"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("counts"), "number", "df")
    placed = written(placed, "bm25-placed")
    found = texts.filter(F.col("key").isNotNull())
    asked = found.filter(F.pmod("key", F.lit(every)) == 0).select("shard", "key", "ids", "counts")
    of = placed.select(F.col("shard").alias("of_shard"), "key", "number")
    queries = written(asked.groupBy("shard").cogroup(of.groupBy("of_shard")).applyInArrow(_global_ids, "key long, ids binary, counts binary").withColumn("ask", F.monotonically_increasing_id()), "bm25-queries")
    # A row per shard: its index size says which shards are searched together. Every query goes to every group, which is what the query set asks for.
    sizes = found.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("ids")) / 4).alias("postings"))
    before = F.coalesce(F.sum("postings").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    together = sizes.withColumn("together", F.floor(before / F.lit(GROUP_POSTINGS)))
    groups = written(together.withColumn("grp", F.dense_rank().over(Window.orderBy("together")) - 1).select("shard", "grp"), "bm25-groups")
    group = groups.agg(F.coalesce(F.max("grp"), F.lit(0))).first()[0]
    none = lambda kind: F.lit(None).cast(kind)
    order = ["grp", "asks", "shard", "kind", "key", "ids", "counts", "number", "df", "of", "head"]
    indexed = placed.unionByName(found.select("shard", "kind", "key", "ids", "counts", none("int").alias("number"), "df")).join(groups, "shard").withColumn("asks", F.lit(0)).withColumn("of", none("binary")).withColumn("head", none("binary")).select(*order)
    step = math.ceil((group + 1) / math.ceil(math.sqrt(group + 1)))
    first = F.pmod("grp", F.lit(step)) == 0

    def searched(these: Column, queries: DataFrame) -> DataFrame:
        """The k best of each of these groups for each query, as far as they reach its floor."""
        packed = written(queries.select("ask", "ids", "counts", "floor").mapInArrow(_pack, "head binary, ids binary, of binary, counts binary"), "bm25-asked")
        asking = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(group)))).filter(these)
        asking = asking.select("grp", F.lit(1).alias("asks"), F.lit(-1).cast("long").alias("shard"), F.lit(2).alias("kind"), none("long").alias("key"), "ids", "counts", none("int").alias("number"), none("long").alias("df"), "of", "head")
        # Groups are dealt by number, not by a hash under which several could meet in one task.
        return indexed.filter(these).unionByName(asking).repartitionById(group + 1, F.col("grp")).sortWithinPartitions("grp", "asks", "shard", "kind").mapInArrow(_search(n_docs, max(total, 1) / max(n_docs, 1), k), "query_id long, doc_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = searched(first, queries.withColumn("floor", F.lit(0.0)))
    if step > 1:
        best = written(best, "bm25-first")
        kth = best.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("ask"), F.col("score").alias("floor"))
        best = best.unionByName(searched(~first, queries.join(kth, "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))))
    top = best.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("query_id", "ask")
    return top.join(queries.select("ask", F.col("key").alias("query_id")), "ask").select("query_id", "rank", "doc_id", "score")
