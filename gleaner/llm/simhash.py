"""SimHash near-dedup by binary trie self-join.

Fingerprints are 64-bit majority votes over XXH64 values of word shingles.
Equal fingerprints are one node. To find all pairs within the Hamming budget,
the 64 bits are cut into BLOCKS blocks: a pair that differs in at most
MOST_BITS bits agrees on at least BLOCKS - MOST_BITS whole blocks, so for each
choice of that many blocks the fingerprints that agree on them meet in a group.
In a group the sorted fingerprints are a binary trie, whose nodes are runs of
the sorted array. Pairs of nodes are traversed together, bit by bit; the bits
in which two nodes differ add up, and a pair of nodes is dropped as soon as
they exceed the budget. All groups of a batch are traversed at once in numpy.

A group emits a spanning forest of its links, never all of its pairs. A group
of more than CHUNK fingerprints is cut into chunks, and each pair of chunks is
a group of its own, so no task's memory grows with a group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.graph import least_labels
from gleaner.llm.shared import SPACE_PATTERN, null_safe, text_or_empty, whole_row, written

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BLOCKS = 6
CHUNK = 2048
#: Fingerprints, at least, that are traversed at once, and pairs of nodes at most in a step.
BATCH_NODES = 1 << 16
MOST_PAIRS = 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half of the XXH64 values of the text's shingles; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], ">u8")
        return int(hashes[0])
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the (unsigned) hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column("text").cast(pa.large_binary())
                found = [signed(fingerprint(t.as_py() or b"", shingle)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fp (the 64 bits as a signed long). Null text has no words: 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def block_masks(blocks: int, most_bits: int) -> list[int]:
    """64-bit masks, one for each choice of blocks - most_bits blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - most_bits)]


def _leaves(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, labels: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one group that differ in at most `budget` bits, some at a time.

    fps: unsigned, sorted within each group; groups are runs [start, end).
    The frontier holds pairs of trie nodes (runs that share a prefix) and the
    bits in which their prefixes differ. A frontier of more than MOST_PAIRS is
    split and its parts go down one after the other.

    Without labels the fingerprints of a group are distinct. With labels they
    may be equal, and only pairs of different labels are given; a pair of
    nodes is dropped as soon as both hold one label only, the same, so a large
    set of copies that are linked already costs little.
    """
    change = None if labels is None else np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
    many = ends - starts > 1
    ones: dict[int, np.ndarray] = {}
    stack = [(63, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if change is not None:
            apart = (change[a1 - 1] != change[a0]) | (change[b1 - 1] != change[b0]) | (labels[a0] != labels[b0])
            a0, a1, b0, b1, diff = (x[apart] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if len(a0) > MOST_PAIRS:
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, diff))), (bit, *(x[half:] for x in (a0, a1, b0, b1, diff)))]
            continue
        if bit < 0:  # leaves, of one value each
            if change is not None:
                a0, b0 = _spelled(a0, a1, b0, b1)
                differ = labels[a0] != labels[b0]
                a0, b0 = a0[differ], b0[differ]
            yield np.minimum(a0, b0), np.maximum(a0, b0)
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps & (np.uint64(1) << np.uint64(bit))) != 0)])
        one = ones[bit]
        # Within a node the values share all higher bits, so those with the bit set are its tail.
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])
        same = (a0 == b0) & (a1 == b1)
        kept = []
        for x0, x1, y0, y1, more, skip in (
            (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, same),
        ):
            ok = (x0 < x1) & (y0 < y1) & (diff + more <= budget)
            if skip is not None:
                ok &= ~skip
            ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))  # a leaf with itself
            kept.append((x0[ok], x1[ok], y0[ok], y1[ok], diff[ok] + more))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def trie_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join, over each group, all (distinct) fingerprints within the budget.

    Links are reduced to a spanning forest each time there are MOST_PAIRS of them.
    """
    found_i, found_j, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j in _leaves(fps, starts, ends, budget, None):
        found_i.append(i)
        found_j.append(j)
        found += len(i)
        if found > MOST_PAIRS:
            i, j = _forest(np.concatenate(found_i), np.concatenate(found_j), len(fps))
            found_i, found_j, found = [i], [j], 0
    return np.concatenate(found_i), np.concatenate(found_j)


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of different labels within the budget, some at a time; fingerprints may be equal."""
    return _leaves(fps, starts, ends, budget, labels)


def _spelled(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs of runs [a0, a1) x [b0, b1), of a run with itself each pair once."""
    width, count = b1 - b0, (a1 - a0) * (b1 - b0)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width, same = np.repeat(width, count), np.repeat(a0 == b0, count)
    i, j = np.repeat(a0, count) + k // np.maximum(width, 1), np.repeat(b0, count) + k % np.maximum(width, 1)
    once = ~same | (i < j)
    return i[once], j[once]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components of the links (i, j) over n nodes: every node to its least one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, label):
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return label[nodes], nodes


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], least: int = BATCH_NODES) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows that come sorted by the first one, `least` rows or more at a time, no group being cut."""
    held, rows = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in columns))
        rows += batch.num_rows
        if rows >= least:
            found = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            groups = found[0]
            cut = int(np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[-1])  # where the last group begins
            if cut:
                yield tuple(x[:cut] for x in found)
            held, rows = [tuple(x[cut:] for x in found)], rows - cut
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def by_group(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows that sorts unsigned fingerprints within each group (groups stay in place), and where groups start and end."""
    fresh = np.concatenate([[True], groups[1:] != groups[:-1]])
    starts = np.flatnonzero(fresh)
    return np.lexsort((fps.view(np.uint64), fresh.cumsum())), starts, np.append(starts[1:], len(fps))


def _join_groups(budget: int):
    """Rows (grp, fp) come sorted by grp. Gives links (a, b) that join each group's near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, fps in whole_groups(batches, ("grp", "fp")):
            order, starts, ends = by_group(groups, fps)
            fps = fps[order]
            i, j = trie_links(fps.view(np.uint64), starts, ends, budget)
            low, high = _forest(i, j, len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(fps[low]), pa.array(fps[high])], ["a", "b"])

    return run


def in_chunks(keyed: DataFrame, key: list[str], item: str, chunk: int) -> DataFrame:
    """keyed with the group `grp` in which a row meets the others of its key; keys of one row fall out.

    A key within the bound is one group; else its items are dealt to chunks,
    and a chunk meets every chunk, itself included, in a group of their own.
    """
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n_of_key")).filter("n_of_key > 1")
    return dealt(keyed.join(sizes, key), key, item, chunk)


def dealt(sized: DataFrame, key: list[str], item: str, chunk: int) -> DataFrame:
    """in_chunks for rows that have n_of_key, the rows of their key."""
    mine = F.pmod(F.xxhash64(F.lit(7), item), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y")))
    rows = sized.withColumn("chunks", F.ceil(F.col("n_of_key") / F.lit(chunk)).cast("int")).withColumn("mine", mine).withColumn("pair", F.explode(meets))
    return rows.withColumn("grp", F.xxhash64(*key, "pair.x", "pair.y"))


def near_links(distinct: DataFrame, most_bits: int = MOST_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """From distinct fingerprints (fp): links (a, b) that join all that are within most_bits of one another.

    Each group gives a spanning forest of its links, so the components over
    the result are those over all pairs. blocks must exceed most_bits.
    """
    if not most_bits < blocks <= 64:
        raise ValueError("blocks must exceed most_bits")
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, most_bits)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value"))
    groups = in_chunks(keyed, ["choice", "value"], "fp", chunk).select("grp", "fp")
    return groups.repartition("grp").sortWithinPartitions("grp", "fp").mapInArrow(_join_groups(most_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    fingerprint is 16 hex digits. Texts whose fingerprints differ in at most
    most_bits bits are linked; component_id is the smallest doc_id of those
    reachable, the row's own included (null ids are left out unless all are
    null). Null and empty texts have fingerprint zero and link like others.
    Repeated rows share a component; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(least_labels(near_links(nodes.select("fp"), most_bits, blocks)), "roots")
    # Tables are written before they are joined: only so does Spark split a hot key of a join.
    rooted = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    labels = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "labels")
    of = written(rooted.join(labels, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that stay when one of each component does: the least id.

    Of rows that repeat that id, the one with the least text hash stays; rows
    without an id stay only if their whole component has none.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay by found (doc_id, component_id), as drop_near_copies has it."""
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*null_safe("doc_id")).distinct()
    rows = docs.select(whole_row(docs), *null_safe(id_col, "long"), F.xxhash64(F.regexp_replace(text_or_empty(text_col), SPACE_PATTERN, " ")).alias("order"))
    kept = rows.join(stay, ["key", "none"], "left_semi")  # the window below lies as this join does: texts move once
    again = F.row_number().over(Window.partitionBy("key", "none").orderBy("order"))
    return kept.withColumn("again", again).filter("again = 1").select("row.*")
