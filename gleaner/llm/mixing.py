"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the
source's target over its size. Documents lie in order of size within their
source; the prefix sum of expected copies, shifted by one random offset, is
emitted once for each integer it crosses. The size order spreads the draw
over short and long texts alike, so taken words come close to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import WORD_PATTERN, null_safe, text_or_empty, whole_row, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """From rows (source, source_size): each source's target in words.

    Sources in code-point order, null last, get the weights in turn. The
    targets share `share` times all words by weight, none above `most` times
    its source's size; what is cut off is shared again by weight. The fixed
    point of that is target = min(most * size, level * weight): with sources
    in order of most * size / weight, the capped ones are a prefix of it.
    The windows run over one row per source, not over documents, and in one
    task: sources are names that someone weighs, some millions at most.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = capped.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    # The level that holds is that of the first source which stays below its cap; after it levels fall.
    holds = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return leveled.withColumn("holds", holds).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("holds") * F.col("weight")), F.col("cap")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken.

    size counts words (null text: 0), taken is size times the copies drawn, 0
    to `most`. Null sources form one source. Rows that repeat a doc_id are
    documents of their own. The draw depends on seed, source, sizes and ids
    alone, so reruns agree. An empty table gives no rows.

    Documents are dealt by ranges of (source, size, id), so a source with a
    third of all rows lies in many partitions; a partition's first rank is
    the sum of the counts of those before it, of which there is one row per
    partition and source.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text_or_empty(text_col), F.lit(WORD_PATTERN)).cast("long").alias("size"), F.col(source_col).alias("source"))
    dealt = sized.repartitionByRange(F.col("source").isNull(), "source", "size", "doc_id").withColumn("part", F.spark_partition_id())
    # Written once: what follows must see one dealing of rows to partitions.
    ranked = written(dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id"))), "mix-ranks")
    parts = ranked.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    start = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("start", start).select(F.col("source").alias("s1"), F.col("part").alias("p1"), "start")
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source")).cast("binary"))  # a null source is left out, with its colon
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    targets = source_targets(sizes, weights, share, most).withColumn("offset", offset).withColumnRenamed("source", "s2")
    per_part = starts.join(targets, F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("start") + F.col("rank")
    copies = F.floor(at * each + F.col("offset")) - F.floor((at - 1) * each + F.col("offset"))
    joined = ranked.join(per_part, F.col("source").eqNullSafe(F.col("s1")) & (F.col("part") == F.col("p1")))
    return joined.withColumn("copies", F.least(copies, F.lit(most)).cast("int")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, all columns whatever their names, each as often as the mix takes it.

    Rows that repeat a doc_id are told apart by their size alone; of several
    with one id and one size, each gets the copies of one of them. Null texts
    have no words; an empty table gives no rows.
    """
    key = ["key", "none", "words", "of", "unsourced"]
    source = null_safe(source_col, "string", ("of", "unsourced"))
    drawn = mix(docs, id_col, text_col, source_col, **how).filter("copies > 0").select(*null_safe("doc_id"), F.col("size").alias("words"), *null_safe("source", "string", ("of", "unsourced")), "copies")
    numbered = drawn.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("copies")))
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD_PATTERN)).cast("long").alias("words")
    rows = docs.select(whole_row(docs), *null_safe(id_col), words, *source, F.xxhash64(text_or_empty(text_col)).alias("order"))
    mine = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("order")))
    # n = k is tested on the joined row, so that the join lies as both windows do and texts move once.
    taken = mine.join(numbered, key).filter(F.col("n") - F.col("k") == 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
