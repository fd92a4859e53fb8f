"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised, so cosine c is the Euclidean distance sqrt(2 - 2c). A
table hashes a vector by DRAWS Gaussian projections, each shifted and cut into
steps of WIDTH; two vectors at distance d agree on one of them with
probability p(d) = 1 - 2 N(-w/d) - 2 / (sqrt(2 pi) w/d) (1 - exp(-(w/d)^2 / 2)),
on a bucket with p(d)^DRAWS, and meet in one of TABLES tables with
1 - (1 - p(d)^DRAWS)^TABLES: 0.98 at cosine 0.95, 0.999 at 0.97. Random
vectors (distance sqrt 2) meet in a table with probability 10^-5.

Whoever shares a bucket is compared exactly, in double precision. A pair is
counted in the first table in which it meets, so counts of links need no list
of pairs: a bucket gives each vector's number of new links, and a spanning
forest of them for the components. A bucket of more than CHUNK vectors is cut
into chunks and each pair of chunks is a group of its own; a group whose
vectors have all met in an earlier table is passed over. Equal vectors are one
node with a weight, so exact copies are not compared with one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.shared import written
from gleaner.operators.graph import least_labels

LEAST_COSINE = 0.95
TABLES, DRAWS, WIDTH, SEED = 32, 16, 2.0, 42
#: Vectors of a chunk; rows of groups that are read at once, about.
CHUNK, BATCH_ROWS = 1024, 4096


def meets(cosine: float, tables: int = TABLES, draws: int = DRAWS, width: float = WIDTH) -> float:
    """The probability that two vectors of this cosine share a bucket of some table."""
    if cosine >= 1:
        return 1.0
    r = width / math.sqrt(2 - 2 * cosine)
    p = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return 1 - (1 - p**draws) ** tables


def projections(size: int, tables: int, draws: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (size x tables * draws) in units of the width, and shifts in [0, 1); fixed by the seed."""
    made = np.random.Generator(np.random.PCG64([seed, size]))
    return made.standard_normal((size, tables * draws)) / width, made.random(tables * draws)


def buckets(units: np.ndarray, tables: int = TABLES, draws: int = DRAWS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """A 64-bit bucket of each unit vector in each table. Vectors whose buckets have equal hashes count as of one bucket."""
    directions, shifts = projections(units.shape[1], tables, draws, width, seed)
    steps = np.floor(units @ directions + shifts).astype(np.int64).reshape(len(units), tables, draws)
    mix = np.random.Generator(np.random.PCG64([seed, 1])).integers(1, 1 << 62, (tables, draws)) * 2 + 1
    found = (steps * mix).sum(axis=2)
    return found ^ (found >> 29)


def normalised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: those that are finite and not zero."""
    most = np.abs(vectors).max(axis=1, initial=0)
    ok = np.isfinite(most) & (most > 0)
    scaled = vectors / np.where(ok, most, 1)[:, None]  # so that squares neither overflow nor vanish
    scaled[~ok] = 0
    return scaled / np.where(ok, np.sqrt((scaled * scaled).sum(axis=1)), 1)[:, None], ok


def _hash(tables: int, draws: int, width: float, seed: int):
    """Rows (node, weight, embedding) to node, weight, vector (its unit vector) and keys, for those that can be hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                part = whole.slice(lo, 2048)
                node, weight, lists = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "embedding"))
                sizes = np.array([len(x) for x in lists])
                for size in np.unique(sizes[sizes > 0]):  # vectors of different sizes never meet
                    at = np.flatnonzero(sizes == size)
                    units, ok = normalised(np.stack([lists[i] for i in at]).astype(np.float64))
                    at, units = at[ok], units[ok]
                    if not len(at):
                        continue
                    keys = buckets(units, tables, draws, width, seed) ^ (int(size) << 48)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at]), pa.array(weight[at]), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "weight", "vector", "tables"],
                    )

    return run


def _compare(least: float):
    """Rows (grp, crossed, part, t, node, weight, vector, tables) come sorted by grp and part. A group is a bucket, a chunk of one, or two chunks (crossed).

    Gives (a, null, n): n new links of a; and (a, b, null): links that join each group's near vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, crossed, part, table, node, weight, vector, tables in _groups(batches):
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            counts, low, high = np.zeros(len(node), np.int64), [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(groups)), strict=True):
                t, keys = int(table[lo]), tables[lo:hi]
                if hi - lo < 2 or (t and (keys[:, :t] == keys[0, :t]).all(axis=0).any()):
                    continue  # all of them have met before
                units = np.frombuffer(b"".join(vector[lo:hi]), np.float64).reshape(hi - lo, -1)
                if not crossed[lo]:
                    i, j = np.nonzero(np.triu(units @ units.T >= least, 1))
                else:  # two chunks: those within a chunk meet in its own group
                    cut = int(np.searchsorted(part[lo:hi], part[hi - 1]))
                    i, j = np.nonzero(units[:cut] @ units[cut:].T >= least)
                    j = j + cut
                if t:
                    fresh = np.ones(len(i), np.bool_)
                    for earlier in range(t):
                        fresh &= keys[i, earlier] != keys[j, earlier]
                    i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                np.add.at(counts, lo + i, weight[lo + j])
                np.add.at(counts, lo + j, weight[lo + i])
                x, y = simhash._forest(i, j, hi - lo)
                low.append(lo + x)
                high.append(lo + y)
            linked = np.flatnonzero(counts)
            if not len(linked):
                continue
            of, where = np.unique(node[linked], return_inverse=True)
            n = np.bincount(where, weights=counts[linked]).astype(np.int64)
            a, b = node[np.concatenate(low)], node[np.concatenate(high)]
            none = pa.nulls(len(of), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(of), none, pa.array(n)], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[tuple]:
    """Columns of rows that come sorted by grp, `rows` or more at a time, no group being cut; `tables` as a matrix, vectors as bytes."""
    held, n = [], 0

    def columns(batch: pa.RecordBatch) -> tuple:
        lists = batch.column("tables")
        matrix = lists.flatten().to_numpy().reshape(len(lists), -1)
        return (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "crossed", "part", "t", "node", "weight")), batch.column("vector").to_pylist(), matrix)

    def joined() -> tuple:
        return tuple(sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*held, strict=True))

    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            held.append(columns(whole.slice(lo, 1024)))
            n += len(held[-1][0])
            if n >= rows:
                found = joined()
                grp = found[0]
                cut = int(np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))[-1])
                if cut:
                    yield tuple(x[:cut] for x in found)
                held = [tuple(x[cut:] for x in found)]
                n = len(held[0][0])
    if n:
        yield joined()


def found_links(nodes: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, draws: int = DRAWS, width: float = WIDTH, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """From distinct vectors (node, weight, embedding), written: rows (a, null, n) whose n add up to a's links, and rows (a, b, null) whose components are those of all links found."""
    hashed = written(nodes.mapInArrow(_hash(tables, draws, width, seed), "node long, weight long, vector binary, tables array<long>"), "hashed")
    keyed = hashed.select("node", F.posexplode("tables").alias("t", "bucket"))
    sizes = keyed.groupBy("t", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(keyed.join(written(sizes, "buckets"), ["t", "bucket"]), "in-buckets")  # who is alone in a bucket needs no vector there
    chunks = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(23), "node"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.struct(F.least(k, mine).alias("x"), F.greatest(k, mine).alias("y")))
    dealt = shared.join(hashed, "node").withColumn("pair", F.explode(others)).withColumn("size_of", F.octet_length("vector")).select(F.xxhash64("t", "bucket", "size_of", "pair.x", "pair.y").alias("grp"), (F.col("pair.x") != F.col("pair.y")).alias("crossed"), mine.alias("part"), "t", "node", "weight", "vector", "tables")
    return dealt.repartition("grp").sortWithinPartitions("grp", "part").mapInArrow(_compare(least), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    n_links counts the other rows within the least cosine that are found;
    component_id is the smallest vec_id reachable, the row's own included
    (null ids are left out unless all are null); kept is whether the row has
    that id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different sizes. Repeated
    rows link with each other. An empty table gives no rows; other columns
    are ignored, and vectors may be of any size.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = F.when(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0.0), vector)
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), usable.alias("embedding"), F.monotonically_increasing_id().alias("row")), "vectors")
    nodes = written(rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "distinct-vectors")
    found = written(found_links(nodes.select("node", "weight", "embedding"), **how), "links")
    counts = found.filter("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    roots = written(least_labels(found.filter("n IS NULL").select("a", "b")), "vector-roots").select(F.col("node").alias("of"), "root")
    rooted = written(nodes.select("node", "weight", "least").join(roots, F.col("node") == F.col("of"), "left").select("node", "weight", "least", F.coalesce("root", "node").alias("root")), "rooted-vectors")
    labels = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "vector-labels")
    counted = rooted.join(labels, "root").join(counts, F.col("node") == F.col("a"), "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    labelled = written(counted.join(nodes.select("node", "embedding"), "node").select("embedding", "n_links", F.struct("component_id").alias("c")), "labelled-vectors")
    joined = rows.join(labelled, "embedding", "left")  # a null vector has no partner
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("c.component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
