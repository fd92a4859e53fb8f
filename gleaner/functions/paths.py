"""Path, hash and format expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files, and the forms of hashes and names.
IMAGE_SUFFIX = r"\.(jpg|jpeg|heic|heif)$"
HASH_FORM = r"^([0-9a-f]{32}|[0-9a-f]{64})$"
USER_FORM = r"^[A-Za-z0-9_-]{1,64}$"
FOLDER_ID_FORM = r"^[A-Za-z0-9_-]{25,50}$"


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def depth(path: Column) -> Column:
    return F.regexp_count(F.coalesce(path, F.lit("")), F.lit(r"[/\\]"))


def under(path: Column, folder: str) -> Column:
    """All descendants of folder: separators made equal, ASCII case ignored, wildcards in folder at work."""
    slashes = folder.replace("\\", "/").rstrip("/")
    return F.replace(path, F.lit("\\"), F.lit("/")).ilike(slashes + "/%")


def starts_like(path: Column, folder: str) -> Column:
    """A plain prefix, ASCII case ignored, wildcards in folder at work."""
    return path.ilike(folder + "%")


def under_escaped(path: Column, folder: str) -> Column:
    """The folder itself or what lies under it; wildcards in folder are plain characters."""
    plain = folder.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (path == folder) | path.ilike(plain + "/%")


def algorithm(pixel_hash: Column) -> Column:
    return F.when(F.length(pixel_hash) == 32, "xxh128").otherwise("sha256")


def trash_name(path: Column) -> Column:
    return F.translate(path, ":\\/", "___")


def hex_to_long(h: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(h, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _tenths(n: Column, unit: int, up_at_half: Column) -> Column:
    """n / unit with one decimal, as text; whole numbers only, so that nothing is rounded twice."""
    tenths, rest = F.floor(n * 10 / unit), (n * 10) % unit * 2
    t = F.when(rest > unit, tenths + 1).when((rest == unit) & up_at_half, tenths + 1).otherwise(tenths)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def _binary_half_goes_up(n: Column, unit: int) -> Column:
    """Whether the double nearest to n / unit, that being half a tenth, is written with the larger digit.

    The double lies above the half, or on it and the digit before is odd.
    """
    d = n / F.lit(float(unit))
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    bits = F.when(d < 2.0**10, 52).when(d < 2.0**20, 42).otherwise(32)  # d times 2^bits is whole and below 2^62
    power = F.when(bits == 52, big(2**52)).when(bits == 42, big(2**42)).otherwise(big(2**32))
    above = (d * power.cast("double")).cast("long").cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)") - n.cast("decimal(18,0)") * power.cast("decimal(17,0)")
    return (above > 0) | ((above == 0) & (F.floor(n * 10 / unit) % 2 == 1))


def size_text(n: Column) -> Column:
    """B, KB or MB in thousands, one decimal from KB on, halves as the binary number rounds; null stays null."""
    n = n.cast("long")
    kilo, mega = 1000, 1_000_000
    return (
        F.when(n.isNull(), F.lit(None))
        .when(n < kilo, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mega, F.concat(_tenths(n, kilo, _binary_half_goes_up(n, kilo)), F.lit(" KB")))
        .otherwise(F.concat(_tenths(n, mega, _binary_half_goes_up(n, mega)), F.lit(" MB")))
    )


def bytes_text(n: Column) -> Column:
    """B to TB in 1024s with one decimal, halves up; "0 B" for none; null stays null."""
    n = n.cast("long")
    out = F.when(n.isNull(), F.lit(None)).when(n == 0, F.lit("0 B"))
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.concat(_tenths(n, 1024**k, F.lit(True)), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == "TB" else out.when(n < 1024 ** (k + 1), text)
    return out


def ratio_text(whole: Column, compressed: Column) -> Column:
    """How much smaller compressed is; empty where there was nothing. Its words are fixed values."""
    saved = F.format_string("%.0f", F.bround((1 - compressed / whole) * 100))
    return F.when(whole <= 0, F.lit("")).otherwise(F.concat(F.lit("Compressed "), size_text(whole), F.lit(" → "), size_text(compressed), F.lit(" ("), saved, F.lit("% reduction)")))


def percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(current * 100.0 / total).cast("long")).otherwise(F.lit(0).cast("long"))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.when(whole.isNull(), F.lit(None)).when(whole < 60, F.format_string("%ds", whole)).otherwise(F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))


def elapsed_text(millis: Column) -> Column:
    """Seconds with one decimal below a minute, else minutes and whole seconds; halves up, null stays null."""
    ms = millis.cast("long")
    below = F.concat(_tenths(ms, 1000, F.lit(True)), F.lit("s"))
    return F.when(ms < 60_000, below).otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), F.floor((ms % 60_000 + 500) / 1000).cast("string"), F.lit("s")))


def thousands_text(n: Column) -> Column:
    """Whole numbers as they are below 1,000, else thousands with one decimal; halves up, null stays null."""
    n = n.cast("long")
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(_tenths(n, 1000, F.lit(True)), F.lit("k")))


def share_text(share: Column) -> Column:
    """A share of one as a whole percentage, halves up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def data_uri(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def normal(path: Column) -> Column:
    """A path with its empty, "." and ".." steps taken out; one that would climb above its root stays at the root."""
    steps = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    taken = F.aggregate(steps, F.array().cast("array<string>"), lambda at, s: F.when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, s)))
    return F.concat(F.lit("/"), F.array_join(taken, "/"))


def lies_in(path: Column, folder: str) -> Column:
    """Whether a path, its steps taken, is the folder or lies in it: what a thumbnail must do to be read."""
    inside = "/" + "/".join(s for s in folder.replace("\\", "/").split("/") if s not in ("", "."))
    return F.coalesce((normal(path) == inside) | normal(path).startswith(inside.rstrip("/") + "/"), F.lit(False))


def safe_data_uri(path: Column, content: Column, folder: str, mime: str = "image/jpeg") -> Column:
    """The data URI of a thumbnail, empty for one that lies outside its folder or has no content."""
    return F.when(lies_in(path, folder) & content.isNotNull(), data_uri(content, mime)).otherwise(F.lit(""))
