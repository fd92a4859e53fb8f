"""Near duplicates by 64-bit hashes: representatives, links, groups, distances.

Both sides of every join grow with the input, so all are merge joins: a file of
hashes that is small enough to be broadcast is many times as large in memory,
and comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.paths import hamming, hex_to_long
from gleaner.operators.graph import least_labels
from gleaner.storage import written

THRESHOLD = 8


#: Words whose hashes a task remembers at most, and bytes of texts that it is handed at once.
REMEMBERED, HANDED = 1 << 16, 4 << 20


class _Digests(dict):
    """The first 64 bits of words' MD5 values, those of REMEMBERED words at most."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8]
        return found


def _majority(text: str | None, known: _Digests) -> str | None:
    words = set((text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "))
    words.discard("")
    if not words:
        return None
    votes, left = np.zeros(64, np.int64), iter(words)
    while some := b"".join(map(known.__getitem__, islice(left, 1 << 12))):
        votes += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(words)).tobytes().hex()


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Digests()
    for whole in batches:
        found = [_majority(text.as_py(), known) for text in whole.column(1)]
        made = pa.RecordBatch.from_arrays([whole.column(0), pa.array(found, pa.string())], ["key", "perceptual_hash"])
        yield made.filter(made.column(1).is_valid())


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of HANDED bytes, or of one row, for what is run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_hash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, perceptual_hash: each bit is the majority over the MD5 values of a text's distinct words; texts without words have no row.

    One pass over the texts in Arrow batches, without a shuffle: as DataFrame
    operations the 64 sums need a row per word and took twelve times as long.
    A task holds a batch, one text's words and REMEMBERED hashes; written
    inside small_batches(), a batch is of HANDED bytes.
    """
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    return rows.mapInArrow(_majorities, f"key {docs.schema[key].dataType.simpleString()}, perceptual_hash string").withColumnRenamed("key", key)


def with_hash(files: DataFrame, session: int) -> DataFrame:
    return files.filter((F.col("session_id") == session) & (F.col("status") == "active") & F.col("perceptual_hash").isNotNull())


def needing_hash(files: DataFrame, session: int) -> DataFrame:
    return files.filter((F.col("session_id") == session) & (F.col("status") == "active") & F.col("perceptual_hash").isNull())


def representatives(files: DataFrame) -> DataFrame:
    """The first file (least id) of each pixel hash, with its own perceptual hash; rows without a pixel hash do not count.

    An aggregate with map-side combine, so a hash that very many files share is no burden of one task.
    """
    first = F.min(F.struct("id", "perceptual_hash")).alias("first")
    return files.filter(F.col("pixel_hash").isNotNull()).groupBy("pixel_hash").agg(first).select("first.id", "pixel_hash", "first.perceptual_hash")


def _choices(threshold: int) -> list[int]:
    """Masks of each two of threshold + 2 blocks: within the threshold, two blocks at least are equal."""
    n = threshold + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


def _in_chunks(keyed: DataFrame, chunk: int) -> DataFrame:
    """From (choice, part, h): grp, side, h: h in each group in which it meets the others of its block; lone ones fall out.

    A block's hashes are one group if there are `chunk` at most. Else they are
    dealt to chunks, and each pair of chunks is a group, so that no task holds
    a block that very many hashes share.
    """
    sizes = written(keyed.groupBy("choice", "part").agg(F.count("*").alias("size")).filter("size > 1"), "block-sizes")
    chunks = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "h"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.struct(F.least(k, mine).alias("x"), F.greatest(k, mine).alias("y")))
    dealt = keyed.join(sizes.hint("merge"), ["choice", "part"]).withColumn("pair", F.explode(others))
    side = F.when(F.col("pair.x") == F.col("pair.y"), F.lit(-1)).otherwise(mine)
    return dealt.select(F.xxhash64("choice", "part", "pair.x", "pair.y").alias("grp"), side.alias("side"), "h")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, other) that join the components of the links (i, j) over n items."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, label):
            others = np.flatnonzero(label != np.arange(n))
            return label[others], others
        label = new


def _near_in_groups(threshold: int, forest: bool):
    """Rows (grp, side, h) come sorted by grp and side. Gives pairs (a, b) of a group's near hashes: all, or a spanning forest.

    side is -1 throughout where a group's rows all meet, else there are two sides that meet each other.
    """

    def links(h: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        if side[0] < 0:
            near = np.triu(np.bitwise_count(h[:, None] ^ h[None, :]) <= threshold, 1)
            i, j = np.nonzero(near)
        else:
            cut = int(np.searchsorted(side, side[-1]))
            i, j = np.nonzero(np.bitwise_count(h[:cut, None] ^ h[None, cut:]) <= threshold)
            j = j + cut
        if forest and len(i):
            i, j = _forest(i, j, len(h))
        a, b = h[i].view(np.int64), h[j].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("grp", "side", "h")))
            grp, side, h = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            yield from _whole(starts, side, h)
            held = [(grp[starts[-1] :], side[starts[-1] :], h[starts[-1] :])]
        if held:
            yield from _whole(np.array([0, len(held[0][0])]), held[0][1], held[0][2])

    def _whole(starts: np.ndarray, side: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        unsigned = h.view(np.uint64)
        found = [links(unsigned[lo:hi], side[lo:hi]) for lo, hi in zip(starts[:-1], starts[1:], strict=True) if hi - lo > 1]
        found = [f for f in found if f.num_rows]
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    return run


def _near_hashes(nodes: DataFrame, threshold: int, forest: bool, chunk: int) -> DataFrame:
    """From distinct hashes (h, long): pairs (a, b), some of them more than once, of those within the threshold."""
    keyed = nodes.select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in _choices(threshold)])).alias("choice", "part"))
    return _join_groups(_in_chunks(keyed, chunk), threshold, forest)


def _join_groups(groups: DataFrame, threshold: int, forest: bool) -> DataFrame:
    return groups.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(_near_in_groups(threshold, forest), "a long, b long")


#: Hashes that meet in one group, at most, on either side.
CHUNK = 1024


def hash_nodes(reps: DataFrame, key: str = "pixel_hash", value: str = "perceptual_hash") -> DataFrame:
    """h (long), node, keys: each distinct hash with the least of its keys and their number."""
    return reps.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), hex_to_long(F.col(value)).alias("h")).groupBy("h").agg(F.min("k").alias("node"), F.count("*").alias("keys"))


def hamming_links(reps: DataFrame, threshold: int = THRESHOLD, key: str = "pixel_hash", value: str = "perceptual_hash", chunk: int = CHUNK) -> DataFrame:
    """Pairs (a < b) of keys whose hashes differ in at most `threshold` bits, with the distance.

    Equal hashes are one node, whose key is the least of theirs; its other
    keys are linked to that one only. So all links between different hashes
    are there, and copies are not expanded into pairs.
    """
    nodes = written(hash_nodes(reps, key, value), "hash-nodes")
    pairs = _near_hashes(nodes.select("h"), threshold, False, chunk).distinct()
    of = nodes.select(F.col("h").alias("a"), F.col("node").alias("x"))
    to = nodes.select(F.col("h").alias("b"), F.col("node").alias("y"))
    named = pairs.join(of.hint("merge"), "a").join(to.hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming(F.col("a"), F.col("b")).alias("distance"))
    return named.unionByName(_equal(reps, nodes, key, value).withColumn("distance", F.lit(0)))


def _equal(reps: DataFrame, nodes: DataFrame, key: str, value: str) -> DataFrame:
    many = nodes.filter("keys > 1").select("h", "node")
    return reps.select(F.col(key).alias("k"), hex_to_long(F.col(value)).alias("h")).join(many.hint("merge"), "h").filter("k <> node").select(F.col("node").alias("a"), F.col("k").alias("b"))


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    of, to = nodes.select(F.col("h").alias("a"), F.col("node").alias("x")), nodes.select(F.col("h").alias("b"), F.col("node").alias("y"))
    return pairs.join(of.hint("merge"), "a").join(to.hint("merge"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def hamming_forest(reps: DataFrame, threshold: int = THRESHOLD, key: str = "pixel_hash", value: str = "perceptual_hash", chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between keys that join exactly what hamming_links() joins; each group gives a spanning forest, so their number grows with the hashes and not with their pairs."""
    nodes = written(hash_nodes(reps, key, value), "hash-nodes")
    pairs = _near_hashes(nodes.select("h"), threshold, True, chunk).distinct()
    return _named(pairs, nodes).unionByName(_equal(reps, nodes, key, value))


def similarity_groups(files: DataFrame, session: int, threshold: int = THRESHOLD) -> DataFrame:
    """Members of groups of at least two pixel hashes: group_id, file_id, pixel_hash, distance, member_count.

    Links join hashes whose representatives are near, and reach on from one to
    the next; every file of a hash is a member. group_id is the least id of
    the least hash in the group, and distance is measured to that file.
    """
    mine = written(with_hash(files, session).select("id", "pixel_hash", "perceptual_hash").filter("pixel_hash IS NOT NULL"), "hashed-files")
    reps = written(representatives(mine), "representatives")
    return members_of(mine, reps, least_labels(hamming_forest(reps, threshold)))


def members_of(mine: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of groups, from files, representatives and labels (node, root) of linked hashes, as similarity_groups() gives them."""
    lead = reps.select(F.col("pixel_hash").alias("root"), F.col("id").alias("group_id"), F.col("perceptual_hash").alias("lead_hash"))
    led = written(roots.join(lead.hint("merge"), "root"), "similar")
    distance = F.coalesce(hamming(hex_to_long(F.col("perceptual_hash")), hex_to_long(F.col("lead_hash"))), F.lit(0))
    joined = written(mine.join(led.hint("merge"), mine.pixel_hash == led.node).select("group_id", F.col("id").alias("file_id"), "pixel_hash", distance.alias("distance")), "similar-files")
    counts = written(joined.groupBy("group_id").agg(F.count("*").alias("member_count")), "similar-counts")
    return joined.join(counts.hint("merge"), "group_id").select("group_id", "file_id", "pixel_hash", "distance", "member_count")


def links_of_new(reps: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """From representatives with a flag `new`: links (a, b) that join all near hashes of which one at least is new, over the blocks that new ones are in."""
    rows = reps.filter("perceptual_hash IS NOT NULL").select(F.col("pixel_hash").alias("k"), hex_to_long(F.col("perceptual_hash")).alias("h"), "new")
    nodes = written(rows.groupBy("h").agg(F.min("k").alias("node"), F.count("*").alias("keys"), F.bool_or("new").alias("new")), "hash-nodes")
    keyed = nodes.select("h", "new", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in _choices(threshold)])).alias("choice", "part"))
    blocks = keyed.filter("new").select("choice", "part").distinct()
    pairs = _join_groups(_in_chunks(keyed.drop("new").join(blocks.hint("merge"), ["choice", "part"], "left_semi"), chunk), threshold, True).distinct()
    return _named(pairs, nodes).unionByName(_equal(reps, nodes, "pixel_hash", "perceptual_hash"))


def group_table(members: DataFrame, session: int) -> DataFrame:
    """The stored form of the groups: id, session_id, status, member_count, representative_file_id."""
    return members.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("member_count")).select("id", F.lit(session).cast("long").alias("session_id"), F.lit("pending").alias("status"), "member_count", F.col("id").alias("representative_file_id"))

