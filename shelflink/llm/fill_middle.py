"""Fill-in-the-middle: texts cut in three and reordered so that a model learns to fill gaps.

Cuts are drawn from a hash of the document's id, so reruns and retries agree.  A text is looked
at as UTF-8 bytes.  Where it is ASCII, code points and bytes are the same number, so the only
thing kept is a sparse exception index: for every character of more than one byte its place and
the excess bytes up to it.  A cut moves between code points and bytes by a binary search in that
index and one addition; no per-character table is made.

Cuts fall between units: tokens (a run of ASCII letters, or any other single character) or
characters.  Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle), each part behind its sentinel.  ``restored`` rebuilds the text from
output and form alone, with JVM functions, so it checks the Python side independently.

Edge cases: null and empty texts are plain and empty; a text that holds a sentinel is plain, since
it could not be taken apart again; a null doc_id draws its cuts from the empty name; equal cuts
give an empty middle; repeated rows are treated alike; a text of any length is cut whole, with a
few bytes of working memory a byte of text; output leaves a task in batches of bounded size; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import texts_as_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes looked at in one go, and bytes of output in one batch.
_PIECE = 1 << 20
_FLUSH = 32 << 20


class Exceptions:
    """The characters of more than one byte: their places and the excess bytes through each."""

    def __init__(self, raw: np.ndarray):
        self.byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.through = np.cumsum(excess)
        self.point = self.byte - (self.through - excess)
        self.points = len(raw) - (int(self.through[-1]) if len(excess) else 0)

    def to_byte(self, point: int) -> int:
        k = int(np.searchsorted(self.point, point))
        return point + (int(self.through[k - 1]) if k else 0)

    def to_point(self, byte: int) -> int:
        k = int(np.searchsorted(self.byte, byte))
        return byte - (int(self.through[k - 1]) if k else 0)


class Tokens:
    """Where tokens begin, counted piece by piece; only the asked places are ever listed."""

    def __init__(self, raw: np.ndarray):
        letter = _LETTER[raw]
        self.first = (raw & 0xC0) != 0x80
        self.first[1:] &= ~(letter[1:] & letter[:-1])
        self.before = np.cumsum([0] + [np.count_nonzero(self.first[k : k + _PIECE]) for k in range(0, len(raw), _PIECE)])
        self.count = int(self.before[-1])

    def to_byte(self, token: int) -> int:
        """The byte at which a token begins; for the number of tokens, the end of the text."""
        if token >= self.count:
            return len(self.first)
        piece = int(np.searchsorted(self.before, token, side="right")) - 1
        inside = np.flatnonzero(self.first[piece * _PIECE : (piece + 1) * _PIECE])
        return piece * _PIECE + int(inside[token - self.before[piece]])


def cut(raw: np.ndarray, h1: int, h2: int, unit: str) -> tuple[int, list[int], list[int]]:
    """Number of units, and where prefix and middle end: in bytes and in code points."""
    index = Exceptions(raw)
    if unit == "char":
        points = sorted((h1 % (index.points + 1), h2 % (index.points + 1)))
        return index.points, [index.to_byte(p) for p in points], points
    tokens = Tokens(raw)
    places = [tokens.to_byte(k) for k in sorted((h1 % (tokens.count + 1), h2 % (tokens.count + 1)))]
    return tokens.count, places, [index.to_point(b) for b in places]


def fill_in_middle(docs: DataFrame, unit: str = "token", name: str = "1:", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row a document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def transform(raw: np.ndarray, drawn: str) -> tuple:
        h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
        text = raw.tobytes()
        n, (b1, b2), (p1, p2) = cut(raw, h1, h2, unit)
        if not text or h3 % 100 >= fim_percent or any(m in text for m in _MARKS):
            return n, "plain", None, None, text
        prefix, middle, suffix = text[:b1], text[b1:b2], text[b2:]
        p, s, m = _MARKS
        if h4 % 100 < spm_percent:
            return n, "spm", p1, p2 - p1, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", p1, p2 - p1, b"".join((p, prefix, s, suffix, m, middle))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        *columns, output = zip(*rows)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(output, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, drawn, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2))):
                rows.append((doc_id, *transform(raw, drawn)))
                held += len(raw)
                if held > _FLUSH:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    own = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(name), own).cast("binary"), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), drawn.alias("drawn"), text_of().alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form.  No part holds a sentinel, so the first one found
    is the one that was put there."""
    body = F.substring(output, 4, 1 << 30)
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    middle = F.substring_index(output, MIDDLE, -1)
    size = F.length(output) - F.length(one) - F.length(middle) - 9
    two = output.substr(F.length(one) + 7, size)
    joined = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(joined)
