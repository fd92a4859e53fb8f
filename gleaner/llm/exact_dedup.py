"""Exact dedup by deterministic block naming.

A normalised text is cut into fixed-size byte blocks. Sorting the distinct
blocks gives each an integer name; then the distinct pairs of neighbouring
names are sorted and named in the same way, round after round, until one name
is left for each document. Names come from sorted contents, not from hashes,
so two texts share a name (and the round it was given in) only if they are
equal byte for byte.

Only distinct blocks are sorted, after a map-side combine. The HOT most
frequent ones are named apart and joined back by a broadcast of them (HOT
blocks at most), so a text that fills a third of the corpus is not shuffled
under one key: no key of the shuffled join holds more than 1 / HOT of the rows.
Hashes only tell which blocks are frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.llm.shared import SPACE_PATTERN, null_safe, text_or_empty, whole_row, written

BLOCK_BYTES = 4096
#: So many blocks (or pairs) at most are joined by broadcast, and only those that so many rows have.
HOT, HOT_LEAST = 1000, 1000
#: Stands for the missing neighbour of an odd last name.
NO_NAME = -1


def _named(table: DataFrame, cols: list[str]) -> DataFrame:
    """table (written, h being a hash of cols) with an integer name for each distinct value of cols.

    The distinct values lie hash-partitioned and are sorted in each partition,
    so a value's partition and place, which make the name, are the same when a
    lost task runs again. The caller writes the result before using it twice.
    """
    often = table.groupBy("h").agg(F.count("*").alias("times")).filter(F.col("times") >= HOT_LEAST).orderBy(F.desc("times"), "h").limit(HOT).select("h")
    # Hot names are negative, the others are not.
    hot = written(table.join(F.broadcast(often), "h", "left_semi").select(*cols).distinct().withColumn("name", F.lit(NO_NAME - 1) - F.monotonically_increasing_id()), "hot-names")
    found = table.join(F.broadcast(hot), cols, "left")
    rest = found.filter("name IS NULL").drop("name")
    names = rest.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())
    return found.filter("name IS NOT NULL").unionByName(rest.join(names, cols)).drop("h")


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, code_points, text_sha256, row (its number), level, name.

    Rows have equal (level, name) exactly when their texts are equal after
    white space is deleted. Null text is empty text, which is one empty block.
    """
    whole = text_or_empty(text_col)
    flat = docs.select(
        F.col(id_col).alias("doc_id"), F.length(whole).alias("code_points"), F.regexp_replace(whole, SPACE_PATTERN, "").cast("binary").alias("flat"), F.monotonically_increasing_id().alias("row"),
    )
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("flat") / F.lit(block_bytes))).cast("int")
    cut = flat.select("row", "doc_id", "code_points", F.sha2("flat", 256).alias("text_sha256"), "flat", n.alias("n")).select(
        "row", "doc_id", "code_points", "text_sha256", "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("flat"), i * block_bytes + 1, F.lit(block_bytes)))).alias("i", "block"),
    )
    blocks = written(cut.withColumn("h", F.xxhash64("block")), "blocks")  # normalised once; row numbers are fixed from here on
    first = written(_named(blocks, ["block"]).drop("block"), "block-names")
    rows = first.filter("i = 0").select("row", "doc_id", "code_points", "text_sha256", "n", "name")
    most = first.agg(F.max("n")).first()[0] or 1

    done = None
    left = first.filter("n > 1").select("row", "n", "i", "name")
    level = 0
    while most > 1:
        level += 1
        most = (most + 1) // 2
        pairs = (
            left.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("i", 1).alias("i"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("b"))
        )
        paired = written(pairs.withColumn("h", F.xxhash64("a", "b")), f"pairs-{level}")
        named = written(_named(paired, ["a", "b"]).drop("a", "b"), f"pair-names-{level}")
        whole_now = named.filter("n = 1").select("row", F.lit(level).alias("level"), "name")
        done = whole_now if done is None else done.unionByName(whole_now)
        left = named.filter("n > 1")

    short = rows.filter("n = 1").select("doc_id", "code_points", "text_sha256", "row", F.lit(0).alias("level"), "name")
    if done is None:
        return short
    long = rows.filter("n > 1").drop("name").join(done, "row")
    return short.unionByName(long.select(*short.columns))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, code_points, level, name.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id (a null id comes last); of rows that are
    repeated with the same id, one stays. An empty table gives no rows; other
    columns are ignored.
    """
    named = written(block_names(docs, id_col, text_col, block_bytes), "identities")
    best = named.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("code_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")).alias("best"),
    )
    joined = named.join(written(best, "best"), ["level", "name"])  # two written tables: Spark splits a hot key of this join
    return joined.select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "code_points", "level", "name"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose texts stay after exact dedup; one of repeated rows.

    Null text is empty text; an empty table gives no rows.
    """
    key = ["key", "none", "size", "sha"]
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(*null_safe("doc_id"), F.col("code_points").alias("size"), F.col("text_sha256").alias("sha"))
    flat = F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE_PATTERN, "").cast("binary"), 256)
    rows = docs.select(whole_row(docs), *null_safe(id_col), F.length(text_or_empty(text_col)).alias("size"), flat.alias("sha"), F.xxhash64(text_or_empty(text_col)).alias("order"))
    kept = rows.join(stay, key, "left_semi")  # the window below lies as this join does: texts move once
    again = F.row_number().over(Window.partitionBy(*key).orderBy("order"))
    return kept.withColumn("again", again).filter("again = 1").select("row.*")
