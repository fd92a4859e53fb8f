import random

import sentencepiece

import corpus_pipeline
from gleaner.llm import mixing, near_dedup, pieces, quality
from tests.llm.test_exact_and_mixing import plain_exact
from tests.llm.test_near_dedup import plain_components

#: Columns that documents may have, named like the operators' own helpers.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `key` int, row int, copies int, component_id int, h int, name string, k int, order int, `a.b` int, __id int"


def clashing(spark, data):
    rng = random.Random(1)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(rng.randint(0, 3) for _ in range(5)), "n", 1, 2, 3, 4) for i, t, s in data], CLASHING)


def hard_rows():
    rng = random.Random(7)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = [(i, text(rng.randint(1, 60)), "abc"[i % 3]) for i in range(40)]
    near = [(100 + i, base[i][1] + " more", "a") for i in range(10) if len(base[i][1].split()) > 30]
    tied = [(200 + i, base[i][1].replace(" ", "  "), None) for i in range(5)]
    return base + near + tied + [(300, None, "a"), (301, "", "b"), (302, " \n", None), (303, None, None), (None, text(9), "c"), (None, None, "c"), (304, text(30_000), "a"), base[3], base[3], (3, None, "a")]


def kept(docs, data):
    """The (doc_id, text) rows of a stage's result, all from data."""
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert set(rows) <= {(i, t) for i, t, _ in data}
    return rows


def test_each_stage_against_plain_code_on_hard_rows(spark, tmp_path):
    data = hard_rows()
    docs = clashing(spark, data)
    sf = str(tmp_path)
    labels = [(i, i % 2, 0) for i, _, _ in data if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    good = corpus_pipeline.classify(spark, docs, sf)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    both = quality._compressor(model.good), quality._compressor(model.bad)
    want = [(i, t) for i, t, _ in data if model.score(quality.feature((t or "").encode(), *both)) >= 0.5]
    assert kept(good, data) == sorted(want, key=repr) and good.columns == docs.columns

    exact = corpus_pipeline.drop_exact(spark, docs, sf)
    assert exact.columns == docs.columns
    groups = {sha: keep for _, keep, _, sha in plain_exact(data)}
    assert sorted((i for i, _ in kept(exact, data)), key=repr) == sorted(groups.values(), key=repr)

    near = corpus_pipeline.drop_near(spark, docs, sf)
    assert near.columns == docs.columns
    stay = {c for _, c in plain_components([(i, t) for i, t, _ in data if i is not None])}
    assert {i for i, _ in kept(near, data)} - {None} == stay

    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns
    assert len(kept(mixed, data)) == sum(r.copies for r in mixing.mix(docs).collect())

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = sorted(((r.doc_id, list(r.ids)) for r in corpus_pipeline.encode(spark, docs, sf).collect()), key=repr)
    assert got == sorted(((i, library.encode(t) if t else []) for i, t, _ in data), key=repr)


def test_stages_take_effect_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert i == 4 or docs.columns == before.columns
        counts.append(docs.count())
        if i == 2:
            assert counts[-1] == near_dedup.near_duplicates(before).select("component_id").distinct().count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]


def test_run_and_empty_documents(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
