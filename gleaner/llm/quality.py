"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.
Every text is cut into chunks of CHUNK bytes, each compressed on its own with
either dictionary; (bad size - good size) / (bad size + good size), summed over
all chunks of the whole text, is the feature, and a logistic curve fitted on
labelled rows that built no dictionary turns it into a score from 0 to 1.

Only the text is an input. The fit uses at most SAMPLE labelled rows of each
class and SAMPLE_CHUNKS chunks of each (spread over the whole text); scoring
reads every byte of every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import crc_bucket, text_or_empty

CHUNK = 512
LEVEL = 3
DICTIONARY_BYTES = 128 << 10
SAMPLE = 2000
SAMPLE_CHUNKS = 16
#: Rows that are scored at once.
SLICE_ROWS = 256
#: Of a sampled class, this share calibrates and builds no dictionary.
CALIBRATION_SHARE = 0.33
HELD_OUT_OF, HELD_OUT = 3, 1


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of either class and the curve score = 1 / (1 + exp(-(slope * feature + intercept)))."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, feature: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * feature + self.intercept))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def feature(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Over all chunks of the whole text; 0 for an empty one."""
    g = b = 0
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if g + b else 0.0


def _features(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts = part.column("text").cast(pa.large_binary())
                found = [feature(t.as_py() or b"", good, bad) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([model.score(f) for f in found], pa.float64()), pa.array(found, pa.float64())], ["doc_id", "score", "feature"]
                )

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, feature. Null text is empty text, whose feature is 0.

    Every byte of a text is compressed, however long it is. Repeated rows score
    alike; an empty table gives no rows; other columns are no inputs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_features(model), "doc_id long, score double, feature double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that score at least 0.5.

    Nulls and empty texts score by the curve at feature 0. Repeated rows are
    kept or go alike; an empty table gives no rows. No shuffle: rows are
    filtered where they lie, a slice at a time.
    """
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts = (t.as_py() for t in part.column(at).cast(pa.large_binary()))
                yield part.filter(pa.array([model.score(feature(t or b"", good, bad)) >= 0.5 for t in texts], pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-3 * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(chunks: list[bytes]) -> bytes:
    chunks = [c for c in chunks if len(c) >= 8]
    if sum(map(len, chunks)) < 64 * 1024:  # too little to train on: the text itself is the dictionary
        return b"\n".join(chunks)[-DICTIONARY_BYTES:] or b"\n" * 8
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(chunks)[-DICTIONARY_BYTES:]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """A model from labelled rows with crc32(doc_id as text) mod 3 other than 1.

    Rows with a null id or label are not learned from. Each class gives the
    `sample` ids of least hash, so the same tables give the same model. With a
    class missing the score of every text is the share of label 1, or 0.5
    without any labels.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.filter(crc_bucket("id", HELD_OUT_OF) != HELD_OUT)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else 0.98 if 1 in counts else 0.02
        return QualityModel(b"\n" * 8, b"\n" * 8, 0.0, math.log(share / (1 - share)))
    order = F.xxhash64(F.lit("quality"), "id")
    picked = None
    for label in (0, 1):
        few = known.filter(F.col("label") == label).select("id", "label", order.alias("h")).distinct().orderBy("h", "id").limit(sample)
        picked = few if picked is None else picked.unionByName(few)
    rows = [(r["id"], r["label"], r["h"]) for r in picked.collect()]  # at most 2 * sample ids
    calibrates = F.pmod(F.col("h"), F.lit(100)) < int(100 * CALIBRATION_SHARE)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "id long, label int, h long"))
    text = text_or_empty(text_col)
    there = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(chosen, "id")
    n = F.least(F.lit(SAMPLE_CHUNKS), F.ceil(F.length("text") / F.lit(CHUNK))).cast("int")
    stride = F.greatest(F.lit(CHUNK), F.floor(F.length("text") / F.greatest(n, F.lit(1)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(F.col("text"), i * stride + 1, F.lit(CHUNK)))
    cut = there.filter(~calibrates).select("id", "label", "h", pieces.alias("pieces")).collect()
    cut.sort(key=lambda r: (r["h"], r["id"], r["pieces"]))
    dictionaries = {label: _dictionary([p.encode() for r in cut if r["label"] == label for p in r["pieces"]]) for label in (0, 1)}
    raw = QualityModel(dictionaries[1], dictionaries[0], 0.0, 0.0)
    held = score_quality(there.filter(calibrates).select("id", "text"), raw, "id", "text").join(chosen.select(F.col("id").alias("doc_id"), "label"), "doc_id")
    got = held.select("feature", "label").collect()
    x, y = np.array([r["feature"] for r in got]), np.array([float(r["label"]) for r in got])
    if len(set(y)) < 2:
        share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        return QualityModel(raw.good, raw.bad, 0.0, math.log(share / (1 - share)))
    ones = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    slope, intercept = _logistic(x, y, ones * len(y) / ones.sum())
    return QualityModel(raw.good, raw.bad, slope, intercept)
