"""Slices, shards and blocks so small that every partition is cut many times: the results are the same."""

import importlib

import pytest

from gleaner.llm import bm25, lm_score, pieces, substring_dedup


def rows(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture
def cut(spark, monkeypatch):
    """cut(module, name, value) sets a constant in the Python workers, which import the module anew, while they run a mapInArrow."""
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def set_to(module, name, value):
        def small(self, func, schema, *args, **kwargs):
            def run(batches):
                there = importlib.import_module(module)
                before = getattr(there, name)
                setattr(there, name, value)
                try:
                    yield from func(batches)
                finally:
                    setattr(there, name, before)

            return plain(self, run, schema, *args, **kwargs)

        monkeypatch.setattr(frame, "mapInArrow", small)

    return set_to


@pytest.mark.parametrize(
    "module, name, value, query",
    [
        ("gleaner.llm.substring_dedup", "SLICE_BYTES", 3000, lambda docs: substring_dedup.dedup_substrings(docs)),
        ("gleaner.llm.bm25", "SHARD_BYTES", 20_000, lambda docs: bm25.search(docs)),
        ("gleaner.llm.lm_score", "BLOCK_BYTES", 20_000, lambda docs: lm_score.lm_scores(docs, pieces.load(pieces.model_path()))),
    ],
    ids=["op1", "op3", "op7"],
)
def test_small_cuts_change_nothing(spark, sf_dir, cut, module, name, value, query):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(2)
    want = rows(query(docs))
    cut(module, name, value)
    got = rows(query(docs))
    assert len(got) == len(want) and got == want
