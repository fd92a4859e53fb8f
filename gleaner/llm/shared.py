"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.storage import shared_folder, written

__all__ = ["SPACE_PATTERN", "WORD_PATTERN", "crc_bucket", "null_safe", "shared_folder", "text_or_empty", "whole_row", "written"]

#: Java pattern of a word: a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Java pattern of the white space between words.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that no helper column can clash with them; select "row.*" gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def null_safe(column: str, kind: str | None = None, names: tuple[str, str] = ("key", "none")) -> tuple[Column, Column]:
    """Two plain join keys that are equal where the column is, null being equal to null.

    A join on them, unlike a null-safe one, leaves its rows partitioned by
    columns that a window can name, so that both share one shuffle.
    """
    c = F.col(column).cast(kind) if kind else F.col(column)
    least = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(c, least).alias(names[0]), c.isNull().alias(names[1])


def crc_bucket(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")
