"""Decoded images and their hashes.

Spark's image source decodes; rows hold pixels as BGR bytes. Hashes are
computed in Arrow batches; an image that can't be decoded has null hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, LOW = 32, 8


def read_images(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, width, height, channels, pixels; width and height are null for files that can't be decoded."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.*")
    size = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return raw.select(F.regexp_replace("origin", "^file:/+", "/").alias("path"), size("width"), size("height"), F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def gray(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def shrunk(a: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Mean over the cells of a side x side grid; a small image's pixels count for several cells."""
    def weights(n: int) -> np.ndarray:
        edges = np.arange(side + 1) * n / side
        lo, hi = edges[:-1, None], edges[1:, None]
        over = np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None)
        return over / over.sum(axis=1, keepdims=True)

    return weights(a.shape[0]) @ a @ weights(a.shape[1]).T


_COSINES = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1) / (2 * SIDE)) * math.sqrt(2 / SIDE)


def perceptual(a: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the shrunk image lie above their median."""
    low = _COSINES @ shrunk(a) @ _COSINES.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def orientation(head: bytes) -> int:
    """The EXIF orientation (1 to 8) that the first bytes of a JPEG file tell; 1 where there is none."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"):
            tiff, order = body[6:], "little" if body[6:8] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    return number(entry + 8, 2) if 1 <= number(entry + 8, 2) <= 8 else 1
            return 1
        at += 2 + size
    return 1


#: How the pixels of each EXIF orientation are turned upright.
UPRIGHT = {
    1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud,
    5: lambda a: a.swapaxes(0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).swapaxes(0, 1), 8: np.rot90,
}


def orientations(spark: SparkSession, folder: str | list[str], head_bytes: int = 1 << 17) -> DataFrame:
    """path, orientation of the JPEG files whose pixels lie otherwise than upright (2 to 8). Of a file's content only its head leaves the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.lower("path").rlike(r"\.jpe?g$"))
    told = F.pandas_udf(lambda heads: pd.Series([orientation(h) for h in heads]), "int")
    found = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), told(F.substring("content", 1, head_bytes)).alias("orientation"))
    return found.filter("orientation > 1")


def read_upright(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """read_images() with the orientation of each; width and height are those of the upright image.

    The join is on paths alone: the side of turned images is two columns, which the planner broadcasts if it is small.
    """
    turned = read_images(spark, folder).join(orientations(spark, folder), "path", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1)))
    sideways = F.col("orientation") >= 5
    return turned.withColumns({"stored_width": F.col("width"), "stored_height": F.col("height"), "width": F.when(sideways, F.col("height")).otherwise(F.col("width")), "height": F.when(sideways, F.col("width")).otherwise(F.col("height"))})


def _hashes(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, turn: pd.Series, known: pd.Series) -> pd.DataFrame:
    out = []
    for p, w, h, c, t, k in zip(pixels, width, height, channels, turn, known, strict=True):
        if p is None or pd.isna(w) or pd.isna(h):
            out.append((k, None))
            continue
        a = UPRIGHT[int(t)](np.frombuffer(p, np.uint8).reshape(int(h), int(w), int(c)))
        if k is None:
            rgb = np.repeat(a, 3, axis=2) if c == 1 else a[:, :, 2::-1]
            k = xxhash.xxh128_hexdigest(np.ascontiguousarray(rgb).tobytes())
        out.append((k, perceptual(gray(np.ascontiguousarray(a).tobytes(), a.shape[1], a.shape[0], int(c)))))
    return pd.DataFrame(out, columns=["pixel_hash", "perceptual_hash"])


def with_hashes(images: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, width, height, pixel_hash (XXH128 of the upright RGB bytes), perceptual_hash.

    images: of read_images() or read_upright(). known (path, pixel_hash): files
    that have a pixel hash already, which is kept and not computed again.
    """
    hashes = F.pandas_udf(_hashes, "pixel_hash string, perceptual_hash string")
    stored = [F.col(f"stored_{c}" if f"stored_{c}" in images.columns else c) for c in ("width", "height")]
    turn = F.col("orientation") if "orientation" in images.columns else F.lit(1)
    rows = images if known is None else images.join(known.select("path", F.col("pixel_hash").alias("had")), "path", "left")
    had = F.lit(None).cast("string") if known is None else F.col("had")
    hashed = rows.withColumn("h", hashes("pixels", *stored, "channels", turn, had))
    return hashed.select("path", "width", "height", "h.pixel_hash", "h.perceptual_hash")


def missing_hashes(files: DataFrame, images: DataFrame, session: int) -> DataFrame:
    """id, pixel_hash, perceptual_hash, width, height of the session's active files that lack a perceptual hash: both hashes for those that have none, the perceptual one alone for the rest."""
    open_ = files.filter((F.col("session_id") == session) & (F.col("status") == "active") & F.col("perceptual_hash").isNull()).select("id", "path", "pixel_hash")
    found = with_hashes(images.join(open_.select("path"), "path", "left_semi"), open_.filter("pixel_hash IS NOT NULL"))
    return open_.select("id", "path").join(found, "path").select("id", "pixel_hash", "perceptual_hash", "width", "height").filter("perceptual_hash IS NOT NULL")
