"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_of(column: str = "text") -> Column:
    """Text with null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the rows no model learns from; rows without an id belong to it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def buckets_for(rows: int, rows_each: int) -> int:
    """How many buckets hold about ``rows_each`` rows each; grows with the table, no ceiling."""
    return max(1, -(-rows // rows_each))


def hash_bucket(hex_digest: Column, buckets: int) -> Column:
    """Equal slices of the order of hexadecimal digests: bucket k holds digests before those of k + 1."""
    head = F.conv(F.substring(hex_digest, 1, 12), 16, 10).cast("long")
    return F.floor(head.cast("double") * buckets / float(1 << 48)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that no other column of the input can clash."""
    return docs.select(*[F.col(c) for c in columns])
