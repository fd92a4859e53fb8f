"""The quality scores recomputed from the tables by a plain program: its own sample, compression loop and curve fit."""

import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from gleaner.llm import quality
from gleaner.llm.queries import op9_quality


def sizes(text, dictionary):
    """Compressed bytes of a text's 512-byte pieces, each on its own."""
    shared = zstandard.ZstdCompressionDict(dictionary)
    total = 0
    for at in range(0, len(text), 512):
        total += len(zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[at : at + 512]))
    return total


def measure(text, good, bad):
    g, b = sizes(text, good), sizes(text, bad)
    return (b - g) / (b + g) if text else 0.0


def pieces(text):
    n = min(16, max(1, math.ceil(len(text) / 512)))
    stride = max(512, len(text) // n)
    return [text[i * stride : i * stride + 512] for i in range(n)]


def trained(chunks):
    chunks = [c.encode() for c in chunks]
    chunks = [c for c in chunks if len(c) >= 8]
    return zstandard.train_dictionary(128 * 1024, chunks).as_bytes() if sum(map(len, chunks)) >= 65536 else b"\n".join(chunks)[-128 * 1024 :] or b"\n" * 8


def curve(x, y, weight):
    """Slope and intercept of the least weighted log loss with a ridge of 1e-3 / 2 on (slope * deviation, intercept), by damped steps down the gradient's Newton direction with a line search."""
    x, y, weight = map(np.asarray, (x, y, weight))
    z = x / np.std(x)

    def loss(a, b):
        t = a * z + b
        return float(np.sum(weight * (np.logaddexp(0, t) - y * t)) + 0.5e-3 * (a * a + b * b))

    a = b = 0.0
    for _ in range(500):
        t = np.clip(a * z + b, -700, 700)
        p = 1 / (1 + np.exp(-t))
        ga, gb = float(np.sum(weight * (p - y) * z) + 1e-3 * a), float(np.sum(weight * (p - y)) + 1e-3 * b)
        if abs(ga) + abs(gb) < 1e-10:
            break
        w = weight * p * (1 - p)
        h = [[float(np.sum(w * z * z)) + 1e-3, float(np.sum(w * z))], [float(np.sum(w * z)), float(np.sum(w)) + 1e-3]]
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        da, db = (h[1][1] * ga - h[0][1] * gb) / det, (h[0][0] * gb - h[0][1] * ga) / det
        step = 1.0
        while loss(a - step * da, b - step * db) > loss(a, b) and step > 1e-12:
            step /= 2
        a, b = a - step * da, b - step * db
    return a / float(np.std(x)), b


def test_every_score_equals_the_plain_program(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    known = [i for i in labels if labels[i] in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(known) < quality.SAMPLE  # so the sample is all of them
    order = {r.id: r.h for r in spark.createDataFrame([(i,) for i in known], "id long").select("id", F.xxhash64(F.lit("quality"), "id").alias("h")).collect()}
    calibrates = {i: order[i] % 100 < 33 for i in known}
    builds = sorted((i for i in known if i in texts and not calibrates[i]), key=lambda i: (order[i], i))
    good, bad = (trained([p for i in builds if labels[i] == label for p in pieces(texts[i])]) for label in (1, 0))
    fits = [i for i in known if i in texts and calibrates[i]]
    x, y = [measure(texts[i].encode(), good, bad) for i in fits], [float(labels[i]) for i in fits]
    n1, n0 = sum(labels[i] == 1 for i in known), sum(labels[i] == 0 for i in known)
    weight = np.array([n1 / sum(y) if v else n0 / (len(y) - sum(y)) for v in y])
    slope, intercept = curve(x, y, weight * len(y) / weight.sum())
    got = {r.doc_id: r for r in op9_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        score = 1 / (1 + math.exp(-max(-700, min(700, slope * measure(texts[i].encode(), good, bad) + intercept))))
        assert r.held_out == held_out[i] and abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5), i
