"""Finding identifiers in texts that must not carry any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import array_of, grab_all, pattern, quote
from ..functions.text import CJK, lines_of

# Identifier shapes, placeholder shapes and the waiver mark.
PRODUCT_ID = r"\b(?:RJ|BJ)[0-9]{6,}\b|\bd_[0-9]{5,}\b"
PRODUCT_QUERY = r"[?&]product_id=[0-9]{4,}"
GALLERY_PATH = r"/g/[0-9]{4,}(?=[/?\"'\s]|$)"
PERCENT_RUN = r"(?:%[0-9A-Fa-f]{2}){2,}"
WAIVER = "anonymity-lint: allow"
SHAPES = [
    ("product-id", PRODUCT_ID, r"^(?:RJ|BJ)?0{6,}[0-9]*$|^d_0{6,}[0-9]*$", "m"),
    ("product-id", PRODUCT_QUERY, r"^[?&]product_id=0{6,}[0-9]*$", "substring_index(m, '=', -1)"),
    ("gallery-id", GALLERY_PATH, r"^/g/0{3,}[0-9]*/?$", "m"),
    ("encoded-text", PERCENT_RUN, None, "m"),
]
# try_url_decode cannot tell a broken UTF-8 sequence, so it is checked by shape
UTF8_RUN = (
    r"(?i)^(?:%[0-7][0-9A-F]|%(?:C[2-9A-F]|D[0-9A-F])%[89AB][0-9A-F]|%E0%[AB][0-9A-F]%[89AB][0-9A-F]"
    r"|%(?:E[1-9A-CEF])(?:%[89AB][0-9A-F]){2}|%ED%[89][0-9A-F]%[89AB][0-9A-F]|%F0%[9AB][0-9A-F](?:%[89AB][0-9A-F]){2}"
    r"|%F[1-3](?:%[89AB][0-9A-F]){3}|%F4%8[0-9A-F](?:%[89AB][0-9A-F]){2})+$"
)


def scan(docs: DataFrame, allow: list[str] = (), deny: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``docs(key, text)`` -> findings ``(key, line, column, kind, match)``.

    Lines are scanned inside the row; only hits leave it.  The deny table
    (``entry string``) may have any size: it is matched by an equality join, see
    :func:`denied`."""
    lines = docs.select(key, F.explode(F.expr(lines_of("text"))).alias("_l")).select(key, "_l.*")
    allowed = f"array_contains({array_of(list(allow))}, {{v}})" if allow else "false"

    def hits(kind: str, regex: str, placeholder: str | None, tested: str) -> str:
        found = grab_all("content", f"({regex})")
        if placeholder is None:
            good = f"(rlike(m, r'{UTF8_RUN}') and rlike(upper(m), '%[89A-F]'))"
        else:
            good = f"not rlike(m, r'{placeholder}') and not {allowed.replace('{v}', tested)}"
        # the column of the n-th hit is the length of the text before it
        return (
            f"transform({found}, (m, i) -> named_struct('kind', {quote(kind)}, 'match', m, 'good', {good},"
            f" 'column', {position('content', regex, 'i')}))"
        )

    every = "concat(" + ", ".join(hits(*shape) for shape in SHAPES) + ")"
    shaped = (
        lines.where(f"rlike(content, r'RJ|BJ|d_|product_id=|/g/|%') and not contains(content, {quote(WAIVER)})")
        .select(key, "line", F.explode(F.expr(every)).alias("_h"))
        .where("_h.good")
        .select(key, "line", "_h.column", "_h.kind", "_h.match")
    )
    return shaped if deny is None else shaped.unionByName(denied(lines, deny, key))


def position(content: str, regex: str, index: str) -> str:
    """1-based column of hit number ``index`` of ``regex`` in ``content``."""
    gaps = f"split({content}, {pattern(regex)}, -1)"
    hits = grab_all(content, f"({regex})")
    before = f"concat(slice({gaps}, 1, {index} + 1), slice({hits}, 1, {index}))"
    return f"1 + aggregate({before}, 0, (n, g) -> n + length(g))"


def denied(lines: DataFrame, deny: DataFrame, key: str) -> DataFrame:
    """Lines that contain a deny entry, ignoring case, with the entry's first column.

    A line contains an entry only if the entry's first ``g`` characters (``g`` = 8, or
    its length) start somewhere in the line, so every place of a line is a key of an equality
    join with those starts.  The plan is the same for a list of any size: Spark sends a small one
    to every task and filters a large join by its runtime Bloom filter.  Only the lengths of the
    starts (1 to 8) are collected."""
    entries = (
        deny.select("entry", F.lower("entry").alias("_e"))
        .where("length(_e) > 0")
        .distinct()
        .withColumn("_gram", F.expr("left(_e, 8)"))
    )
    sizes = sorted(r.g for r in entries.select(F.length("_gram").alias("g")).distinct().collect())
    # a look-ahead group lists all overlapping windows in one linear pass
    windows = ", ".join(["cast(array() as array<string>)", *(grab_all("_low", f"(?s)(?=(.{{{g}}}))") for g in sizes)])
    met = lines.withColumn("_low", F.lower("content")).withColumn("_gram", F.explode(F.expr(f"array_distinct(concat({windows}))")))
    return (
        met.join(entries, "_gram")
        .where("contains(_low, _e)")
        .select(key, "line", F.expr("locate(_e, _low)").alias("column"), F.lit("denylisted").alias("kind"), F.col("entry").alias("match"))
    )


def cjk_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct runs of two or more CJK characters of each text."""
    runs = grab_all("coalesce(text, '')", f"({CJK}{{2,}})")
    return docs.select(key, F.explode(F.expr(f"array_distinct({runs})")).alias("run"))

