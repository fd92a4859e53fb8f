"""Small cases of groups, keepers, similarity, plans and schemas."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.operators import duplicates, plan, ranking, similarity
from gleaner.operators.graph import least_labels

A, B, C = "a" * 32, "b" * 32, "c" * 32


def files(spark, rows):
    """Rows of (id, path, size, modified_at, pixel_hash[, status])."""
    data = [(r[0], 1, *r[1:5], "xxh128", r[5] if len(r) > 5 else "active") for r in rows]
    return spark.createDataFrame(data, "id long, session_id long, path string, size long, modified_at string, pixel_hash string, hash_algorithm string, status string")


@pytest.fixture(scope="module")
def grouped(spark):
    return files(spark, [
        (1, "/photos/a1.jpg", 1000, "2024-01-15", A), (2, "/photos/a2.jpg", 1500, "2024-01-15", A),
        (3, "/photos/b1.heic", 2000, "2024-06-01", B), (4, "/photos/b2.heic", 2100, "2024-06-01", B), (5, "/photos/b3.heic", 2200, "2024-06-01", B),
        (6, "/photos/lone.jpg", 5, None, C), (7, "/photos/none.jpg", None, None, None),
    ])


@pytest.mark.parametrize(("how", "want"), [
    ({}, {A, B}), ({"min_copies": 3}, {B}), ({"date_from": "2024-03-01"}, {B}), ({"date_to": "2024-03-01"}, {A}), ({"extensions": [".jpg"]}, {A}),
    ({"extensions": [".heic"]}, {B}), ({"limit": 1}, {B}), ({"limit": 0}, {A, B}), ({"offset": 100}, set()), ({"extensions": [".JPG", ".HEIC"]}, {A, B}),
])
def test_filtered_groups(grouped, how, want):
    assert {r.pixel_hash for r in duplicates.filtered_groups(grouped, 1, **how).collect()} == want


def test_a_hot_hash_is_split(spark):
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        n = 20_000
        hot = F.when(F.col("id") % 2 == 0, A).otherwise(F.md5((F.col("id") % 7000).cast("string").cast("binary")))
        rows = spark.range(0, n, 1, 8).select("id", F.lit(1).alias("session_id"), F.concat(F.lit("/p/"), F.sha2(F.col("id").cast("string"), 512)).alias("path"), hot.alias("pixel_hash"), F.lit(None).cast("string").alias("hash_algorithm"), F.lit("active").alias("status"))
        found = duplicates.duplicate_files(rows, 1)
        assert found.filter(F.col("pixel_hash") == A).agg(F.count("*"), F.min("copies"), F.max("copies")).first()[:] == (n // 2, n // 2, n // 2)
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fully_duplicated_folders(spark):
    both = files(spark, [(1, "/photos/a.jpg", 1, None, A), (2, "/photos/b.jpg", 1, None, B), (3, "/backup/a.jpg", 1, None, A), (4, "/backup/b.jpg", 1, None, B)])
    assert {r.folder for r in duplicates.fully_duplicated_folders(both, 1).collect()} == {"/photos", "/backup"}
    part = files(spark, [(1, "/photos/a.jpg", 1, None, A), (2, "/photos/u.jpg", 1, None, C), (3, "/backup/a.jpg", 1, None, A)])
    assert {r.folder for r in duplicates.fully_duplicated_folders(part, 1).collect()} == {"/backup"}
    assert duplicates.fully_duplicated_folders(part.limit(0), 1).count() == 0


def hexed(bits):
    return f"{sum(1 << b for b in bits):016x}"


def near(spark, rows, threshold):
    data = [(i, 1, h, p and hexed(p - {-1}), "active") for i, h, p in rows]
    df = spark.createDataFrame(data, "id long, session_id long, pixel_hash string, perceptual_hash string, status string")
    found = {}
    for r in similarity.similarity_groups(df, 1, threshold).collect():
        found.setdefault(r.group_id, set()).add(r.file_id)
    return sorted(map(sorted, found.values()))


Z = {-1}  # no bit set


@pytest.mark.parametrize(("rows", "threshold", "want"), [
    ([(1, A, {0}), (2, A, {0})], 8, []),
    ([(1, A, Z), (2, B, {0, 1})], 8, [[1, 2]]),
    ([(1, A, Z), (2, B, set(range(10)))], 8, []),
    ([(1, A, Z), (2, B, set(range(8)))], 8, [[1, 2]]),
    ([(1, A, Z), (2, B, {0, 1, 2}), (3, C, set(range(6)))], 4, [[1, 2, 3]]),
    ([(1, A, {0}), (2, B, {0, 1}), (3, C, {60, 61, 62, 63}), (4, "d", {60, 61, 62})], 2, [[1, 2], [3, 4]]),
    ([(1, A, {0}), (2, A, {0}), (3, B, {0, 1})], 8, [[1, 2, 3]]),
    ([(1, None, {0}), (2, B, {0})], 8, []),
    ([(1, A, None), (2, B, {0})], 8, []),
    ([(1, A, {5}), (2, B, {5})], 0, [[1, 2]]),
    ([(1, A, {5}), (2, B, {6, 5})], 0, []),
])
def test_similarity_groups(spark, rows, threshold, want):
    assert near(spark, rows, threshold) == want


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {f"k{i:03d}": b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 9))) for i, b in enumerate(base * 12)}
    reps = spark.createDataFrame([(k, f"{v:016x}") for k, v in values.items()], "pixel_hash string, perceptual_hash string")
    links = least_labels(similarity.hamming_links(reps).select("a", "b"))
    got = {r.node: r.root for r in links.collect()}
    root = {k: k for k in values}
    for _ in values:
        for a in values:
            for b in values:
                if (values[a] ^ values[b]).bit_count() <= 8:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a in values for b in values if (values[a] ^ values[b]).bit_count() <= 8):
            break
    assert {k: got.get(k, k) for k in values} == root


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in least_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(300)}
    assert least_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def pick(spark, rows, chain):
    data = [(i, A, s, w, h, m, p) for i, s, w, h, m, p in rows]
    df = spark.createDataFrame(data, "id long, pixel_hash string, size long, width int, height int, modified_at string, path string")
    return [r.id for r in ranking.apply_preset(df, chain).filter("action = 'keep'").collect()]


ROWS = [(1, 100, 10, 10, "2024-01-01", "/a/x.jpg"), (2, 200, 5, 5, "2024-02-01", "/a/b/c/x.jpg"), (3, 150, 50, 50, "2023-01-01", "/x.jpg")]


@pytest.mark.parametrize(("preset", "want"), [("KEEP_LARGEST_FILE", 2), ("KEEP_HIGHEST_RESOLUTION", 3), ("KEEP_NEWEST", 2), ("KEEP_OLDEST", 3), ("KEEP_SHORTEST_PATH", 3), ("KEEP_DEEPEST_PATH", 2)])
def test_presets(spark, preset, want):
    assert pick(spark, ROWS, ranking.PRESETS[preset]) == [want]


def test_missing_and_prefix_dates(spark):
    missing = [(1, 1, None, None, "2024-01-01", "/a"), (2, 1, None, None, None, "/b"), (3, 1, None, None, "", "/c")]
    assert pick(spark, missing, ranking.PRESETS["KEEP_NEWEST"]) in ([2], [3])
    prefix = [(1, 1, None, None, "2024-01-01T00:00", "/a"), (2, 1, None, None, "2024-01-01", "/b")]
    assert pick(spark, prefix, (ranking.Criterion("modified_at"),)) == [2]
    with pytest.raises(ValueError, match="unknown sort field"):
        ranking.order_of((ranking.Criterion("colour"),))
    with pytest.raises(ValueError, match="criterion"):
        ranking.order_of(())


def test_last_copy_is_never_deleted(spark):
    """The closed form against a loop that counts deletions one after another."""
    rng = random.Random(3)
    members, totals = [], {}
    file_id = 0
    for g in range(60):
        n = rng.randint(1, 5)
        for d in range(n):
            file_id += 1
            h = f"h{rng.randint(0, 40)}"
            totals[h] = totals.get(h, 0) + 1
            members.append((g, n, file_id, d, h, rng.randint(0, 9), None, 1, 1, f"/p/{file_id}"))
    df = spark.createDataFrame(members, "group_id long, member_count long, file_id long, distance int, pixel_hash string, size long, modified_at string, width int, height int, path string")
    t = spark.createDataFrame(list(totals.items()), "pixel_hash string, total long")
    got = {r.file_id: r.action for r in ranking.apply_similarity_preset(df, t, ranking.PRESETS["KEEP_LARGEST_FILE"]).collect()}
    want, gone = {}, {}
    for g in sorted({m[0] for m in members}, key=lambda g: (-max(m[1] for m in members if m[0] == g), g)):
        group = sorted((m for m in members if m[0] == g), key=lambda m: (m[3], m[2]))
        if len(group) < 2:
            continue
        keeper = min(group, key=lambda m: (-m[5], m[9].count("/"), m[3], m[2]))
        for m in group:
            if m is keeper or totals[m[4]] > 1 and gone.get(m[4], 0) >= totals[m[4]] - 1:
                want[m[2]] = "keep"
            else:
                want[m[2]] = "delete"
                gone[m[4]] = gone.get(m[4], 0) + 1
    assert got == want


def test_plan_summary(spark):
    f = files(spark, [(1, "/a", 5000, None, A), (2, "/b", 3000, None, B), (3, "/c", 2000, None, C)])
    schema = "session_id long, file_id long, action string, scope string, decided_at string, executed_at string"
    acts = spark.createDataFrame([(1, 1, "delete", "file", None, None), (1, 2, "keep", "file", None, None), (1, 3, "ignore", "file", None, None)], schema)
    assert tuple(plan.summary(acts, f, 1).first()) == (1, 5000, 1, 1, 0)
    done = acts.withColumn("executed_at", F.lit("2024-01-01"))
    assert tuple(plan.summary(done, f, 1).first()) == (0, 0, 0, 0, 0)
    folder = acts.withColumns({"action": F.lit("delete"), "scope": F.lit("folder")})
    assert tuple(plan.summary(folder, f, 1).first()) == (3, 10000, 0, 0, 3)


def test_schemas(spark):
    tables = {t: spark.createDataFrame([], schemas.schema(t)) for t in schemas.DDL}
    assert schemas.missing(tables) == []
    tables.pop("requests")
    tables["files"] = tables["files"].drop("width")
    assert schemas.missing(tables, ()) == ["Missing column: files.width", "Missing table: requests", "Missing view: duplicate_groups"]
    rows = spark.createDataFrame([(1, "keep"), (2, "burn"), (3, None)], "id long, action string").withColumns({"scope": F.lit("file")})
    good, bad = schemas.split_valid("file_actions", rows)
    assert [r.id for r in good.collect()] == [1, 3] and [r.id for r in bad.collect()] == [2]
    with pytest.raises(ValueError, match="newer"):
        schemas.migrate(99, {}, {})
