"""Near hashes in chunks, their groups, and the stored form of these, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import similarity, stored_groups
from gleaner.operators.graph import least_labels

SCHEMA = "id long, session_id long, path string, size long, pixel_hash string, perceptual_hash string, status string"


def pairs_of(values, threshold):
    """Index pairs within the threshold, a block of rows at a time."""
    v = np.array(values, np.uint64)
    found = []
    for lo in range(0, len(v), 1000):
        i, j = np.nonzero(np.bitwise_count(v[lo : lo + 1000, None] ^ v[None, :]) <= threshold)
        found += [(int(a) + lo, int(b)) for a, b in zip(i, j, strict=True) if a + lo < b]
    return found


def table(spark, values):
    return spark.createDataFrame([(f"{i:06d}", f"{int(x):016x}") for i, x in enumerate(values)], "pixel_hash string, perceptual_hash string")


@pytest.mark.parametrize("chunk", [7, 1024])
def test_links_equal_all_pairs(spark, chunk):
    made = np.random.default_rng(2)
    base = made.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [int(x) for x in np.concatenate([base, base ^ np.uint64(0xFF), base ^ np.uint64(1 << 63), base[:10]])]
    got = {(r.a, r.b, r.distance) for r in similarity.hamming_links(table(spark, values), 8, chunk=chunk).collect()}
    least = {}
    for i, x in enumerate(values):
        least.setdefault(x, i)
    want = {(f"{min(i, j):06d}", f"{max(i, j):06d}", (values[i] ^ values[j]).bit_count()) for i, j in pairs_of(values, 8) if values[i] != values[j] and least[values[i]] == i and least[values[j]] == j}
    want |= {(f"{least[x]:06d}", f"{i:06d}", 0) for i, x in enumerate(values) if least[x] != i}
    assert got == want


def test_one_block_that_very_many_hashes_share(spark):
    """12,000 hashes agree on their upper 26 bits: one group of each of three choices is cut into chunks, and no task holds it whole."""
    made = np.random.default_rng(5)
    centres = made.integers(0, 1 << 38, 300, dtype=np.uint64)
    values = np.unique(np.concatenate([made.integers(0, 1 << 38, 11_000, dtype=np.uint64), centres, centres ^ np.uint64(0x10101), centres ^ np.uint64(1 << 30)]) | np.uint64(0x5A5A5A << 40))
    reps = table(spark, values)
    labels = {r.node: r.root for r in least_labels(similarity.hamming_forest(reps, 4, chunk=512)).collect()}
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i, j in pairs_of(values, 4):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
        linked |= {i, j}
    assert labels == {f"{i:06d}": f"{top(i):06d}" for i in linked}
    groups = similarity._in_chunks(similarity.hash_nodes(reps).select("h").select("h", F.lit(0).alias("choice"), F.lit(0).cast("long").alias("part")), 512)
    assert groups.groupBy("grp").count().agg(F.max("count")).first()[0] < 1300  # two chunks of about 512


def files_of(spark, rows):
    return spark.createDataFrame([(i, 1, f"/p/{i}", 1, h, p, "active") for i, h, p in rows], SCHEMA)


def as_rows(tables):
    groups, members = tables
    return sorted((r.id, r.member_count, r.representative_file_id) for r in groups.collect()), sorted(map(tuple, members.collect()))


def test_merged_groups_equal_a_rerun_and_keep_their_status(spark, tmp_path):
    made = np.random.default_rng(9)
    centres = [int(x) for x in made.integers(0, 1 << 63, 12, dtype=np.uint64)]
    rows = [(i, f"h{(i * 37) % 90:02d}", f"{centres[i % 12] ^ (1 << (i % 3)):016x}") for i in range(80)]
    rows += [(200 + k, f"a{k}", f"{centres[0] ^ centres[1] if k else centres[2] ^ 0b11111:016x}") for k in range(2)]  # one lone, one of a lesser hash for a group
    whole, first = files_of(spark, rows), files_of(spark, rows[:50])
    store = str(tmp_path / "store")
    assert stored_groups.version(spark, store) == 0
    groups, members = stored_groups.build(first, 1, "may", *stored_groups.empty(spark))
    assert stored_groups.commit(store, stored_groups.set_status(groups, groups.select("id"), "reviewed"), members) == 1
    fresh = whole.filter("id >= 50").select("id")
    merged = stored_groups.merge_new(whole, fresh, 1, "june", *stored_groups.stored(spark, store))
    assert stored_groups.commit(store, *merged) == 2
    merged = stored_groups.stored(spark, store)
    again = stored_groups.build(whole, 1, "june", *stored_groups.empty(spark))
    assert as_rows(merged) == as_rows(again)
    before = {g: {m.file_id for m in members.filter(F.col("group_id") == g).collect()} for g in [r.id for r in groups.collect()]}
    for g in merged[0].collect():
        same = before.get(g.id) == {m.file_id for m in merged[1].filter(F.col("group_id") == g.id).collect()}
        assert (g.status, g.created_at) == (("reviewed", "may") if same else ("pending", "june"))
    nothing = stored_groups.merge_new(whole, fresh.limit(0), 1, "july", *merged)
    assert as_rows(nothing) == as_rows(merged) and {r.created_at for r in nothing[0].collect()} <= {"may", "june"}


def test_clear_and_status(spark):
    groups, members = stored_groups.build(files_of(spark, [(1, "a", "0" * 16), (2, "b", "0" * 15 + "1")]), 1, "may", *stored_groups.empty(spark))
    assert as_rows((groups, members)) == ([(1, 2, 1)], [(1, 1, 0), (1, 2, 1)])
    assert as_rows(stored_groups.clear(groups, members, 2)) == as_rows((groups, members))
    assert as_rows(stored_groups.clear(groups, members, 1)) == ([], [])
    with pytest.raises(ValueError):
        stored_groups.set_status(groups, groups.select("id"), "done")


def test_the_edges_of_a_hub_are_split(spark, monkeypatch):
    """A star of 60,000 edges: the join that gives its hub the least neighbour is planned with the hub's partition split."""
    from gleaner.operators import graph

    plans = []
    plain = graph.written

    def seen(df, name):
        out = plain(df, name)
        df.collect()  # runs this very plan
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "written", seen)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("16k", "16k", "-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        star = spark.range(1, 60_001).select(F.lit(1 << 40).alias("a"), "id").withColumnRenamed("id", "b").unionByName(spark.range(100_000, 103_000).select(F.col("id").alias("a"), (F.col("id") + 10_000).alias("b")))
        labels = graph.least_labels(star)
        assert labels.count() == 60_001 + 6_000 and labels.filter("root = 1").count() == 60_001
        assert any("skew=true" in p for p in plans)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_no_table_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    """Small tables as these would all be broadcast if their joins left that to the planner."""
    from gleaner.operators import graph

    plans = []
    plain = similarity.written

    def seen(df, name):
        df.collect()  # runs this very plan
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    for module in (graph, similarity, stored_groups):
        monkeypatch.setattr(module, "written", seen)
    rows = [(i, f"h{i // 2:02d}", f"{(i // 4) << 40 | 1 << i % 3:016x}") for i in range(40)]
    whole, store = files_of(spark, rows), str(tmp_path / "store")
    stored_groups.commit(store, *stored_groups.build(files_of(spark, rows[:20]), 1, "may", *stored_groups.empty(spark)))
    for table in stored_groups.merge_new(whole, whole.filter("id >= 20").select("id"), 1, "june", *stored_groups.stored(spark, store)):
        seen(table, "merged")
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_hashes_of_texts_hold_little_at_once(spark, tmp_path, monkeypatch):
    """Batches are of some MB however many rows come, few words are remembered, and the hashes are those of a plain program."""
    import hashlib

    from gleaner.plans import similarity_queries

    texts = [*(f"Ab\tcd{i}\n\r e\x0bf  {i % 7} " * 30 for i in range(300)), None, "", " \n", "x"]
    rows = [(i, t, "en", "src1", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain, told = similarity._majorities, str(tmp_path / "told")

    def noted(batches):
        def told_of(some):
            for b in some:
                with open(told, "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b

        return plain(told_of(batches))

    monkeypatch.setattr(similarity, "_majorities", noted)
    monkeypatch.setattr(similarity, "HANDED", 1 << 14)
    got = {r.doc_id: r.perceptual_hash for r in similarity_queries._prints(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = {w for w in (t or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w}
        values = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        if words:
            want[i] = f"{sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(words)):016x}"
    assert got == want
    sizes = [int(n) for n in open(told)]
    assert sum(sizes) == len(texts) and max(sizes) < 100
    known = similarity._Digests()
    monkeypatch.setattr(similarity, "REMEMBERED", 10)
    assert similarity._majority(texts[5].lower(), known) == want[5] and similarity._majority(texts[6].lower(), known) == want[6] and len(known) <= 10


def test_groups_read_their_files_once(spark, tmp_path, monkeypatch):
    """The files' hashes are dear to compute, so one of the written tables reads the source and the others that one."""
    plans = []
    plain = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: (plans.append(df.inputFiles()), plain(df, name))[1])
    files_of(spark, [(i, f"h{i}", f"{i // 2 << 20:016x}") for i in range(20)]).write.parquet(f"{tmp_path}/source")
    members = similarity.similarity_groups(spark.read.parquet(f"{tmp_path}/source"), 1)
    assert members.count() == 20
    assert sum(any("/source/" in f for f in files) for files in [*plans, members.inputFiles()]) == 1
