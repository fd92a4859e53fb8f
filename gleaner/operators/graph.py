"""Connected components over an edge table, by joins, with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.storage import written

MOST_ROUNDS = 60


def least_labels(edges: DataFrame) -> DataFrame:
    """From edges (a, b): one row (node, root) for each node, root being its component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes. The least neighbour of a node comes from a min() with
    map-side combine and neighbour lists are never collected. It is dealt out
    anew before the join that gives it back to the edges, so both sides of the
    join lie behind shuffles of their own and the adaptive planner can split
    the edges of a hub. No side is broadcast, however small its file: nodes
    grow with the input. Every round is written to the shared folder.
    """
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = (-1, -1)
    for turn in range(MOST_ROUNDS):
        # large star: every neighbour above the node is linked to the least of node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")).repartition(tasks)
        large = both.join(least.hint("merge"), both.a == least.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every neighbour at or below the node, and the node, are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m").repartition(tasks)
        small = large.join(least.hint("merge"), large.a == least.n).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = written(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct(), f"edges-{turn}")
        stars = now.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(stars) == before:
            break
        before = tuple(stars)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
