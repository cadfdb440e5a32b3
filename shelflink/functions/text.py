"""String scalars as SQL text; all run in the JVM except ``nfkc`` (Spark has no
Unicode compatibility normalisation)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sql import Sql, case, each, grab, grab_all, has, let, pattern, quote, repeat, sub, text

# Named character references that are decoded.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "mdash": "—",
    "ndash": "–",
    "hellip": "…",
    "middot": "·",
    "times": "×",
    "yen": "¥",
}

# Chapter / volume markers, removed in this order.
CHAPTER_MARKERS = [
    (r"第\s*\d{1,4}(?:\.\d+)?\s*[話话回巻卷集章幕]", False),
    (r"第\s*[一二三四五六七八九十百千]+\s*[話话回巻卷集章幕]", False),
    (r"\d{1,4}\s*[話话回]", False),
    (r"\d{1,4}\s*[巻卷]", False),
    (r"(?:ep|episode|chapter|ch|vol|volume)\.?\s*\d{1,4}", True),
    (r"#\s*\d{1,4}", False),
    (r"[（(]\s*\d{1,4}\s*[/／]\s*\d{1,4}\s*[)）]", False),
    (r"(?:全|共)\s*\d{1,4}\s*[話话回巻卷]", False),
    (r"(?:[\s\-–—_]+)\d{1,3}\s*$", False),
]

# Where a chapter number is read from, first hit wins.
CHAPTER_NUMBERS = [
    (r"第\s*(\d{1,4})\s*[話话回巻卷集章幕]", False),
    (r"(\d{1,4})\s*[話话回巻卷]", False),
    (r"(?:vol|volume|chapter|ep|episode)\.?\s*(\d{1,4})", True),
    (r"#\s*(\d{1,4})", False),
]

# Decoration blocks at either end of a title.
LEADING_DECORATION = r"^\s*[【[（(「『〈《<][^】\]）)」』〉》>]{1,40}[】\]）)」』〉》>]\s*"
TRAILING_DECORATION = r"\s*[【[（(「『〈《<][^】\]）)」』〉》>]{1,40}[】\]）)」』〉》>]\s*$"

KANA = r"[\p{IsHiragana}\p{IsKatakana}]"
HAN = r"\p{IsHan}"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
PUNCTUATION = r"[\p{P}\p{S}]"


def _nfkc(value: str | None) -> str | None:
    if value is None or value.isascii():
        return value
    return unicodedata.normalize("NFKC", value)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(_nfkc)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(lists: pd.Series) -> pd.Series:
    """NFKC over an array column: one Python crossing for all titles of a row."""
    return lists.map(lambda xs: None if xs is None else [_nfkc(x) for x in xs])


# Marked so that the optimiser neither copies the call into a pushed-down filter (where it
# could land inside a lambda, which cannot run Python) nor evaluates it twice.
nfkc = nfkc.asNondeterministic()
nfkc_each = nfkc_each.asNondeterministic()


def trim_blanks(value: Sql) -> Sql:
    """Blanks off both ends; a run of blanks inside is tried once, not from each of its places."""
    return sub(value, r"^\s+|(?<!\s)\s+$")


def collapse_spaces(value: Sql) -> Sql:
    return f"trim({sub(text(value), r'\s+', ' ')})"


def _code_point(digits: Sql, base: int) -> Sql:
    """Character for a numeric reference, null when it is not a valid code point."""

    def char(number: Sql) -> Sql:
        return f"if({number} between 1 and 1114111, decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32'), null)"

    short = f"if(length(ltrim('0', {digits})) <= 8, {digits}, '0')"
    return let(f"cast(conv({short}, {base}, 10) as bigint)", char)


def _decode_one(piece: Sql) -> Sql:
    named = "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in NAMED_ENTITIES.items()) + ")"
    return case(
        (has(piece, r"^&#\d+;$"), text_or(_code_point(grab(piece, r"^&#(\d+);$"), 10), piece)),
        (
            has(piece, r"^&#[xX][0-9a-fA-F]+;$"),
            text_or(_code_point(grab(piece, r"^&#[xX]([0-9a-fA-F]+);$"), 16), piece),
        ),
        default=text_or(f"{named}[lower({grab(piece, r'^&([a-zA-Z][a-zA-Z0-9]*);$')})]", piece),
    )


def text_or(value: Sql, other: Sql) -> Sql:
    return f"coalesce({value}, {other})"


def decode_entities(value: Sql) -> Sql:
    """One left-to-right pass, so ``&amp;lt;`` becomes ``&lt;`` and stays there."""

    def decode(whole: Sql) -> Sql:
        pieces = grab_all(whole, r"(?s)(&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&)")
        decoded = each(pieces, lambda p: f"if(startswith({p}, '&'), {_decode_one(p)}, {p})")
        return f"if(contains({whole}, '&'), array_join({decoded}, ''), {whole})"

    return let(text(value), decode)


def strip_tags(value: Sql) -> Sql:
    return collapse_spaces(decode_entities(sub(text(value), r"<[^>]*>", " ")))


# --- the functions below expect text that already went through NFKC -------------


def match_form(value: Sql) -> Sql:
    """Comparison form: lower case, no blanks, punctuation or symbols."""
    return sub(f"lower({text(value)})", r"[\s\p{P}\p{S}]")


def store_form(value: Sql) -> Sql:
    """Keyword form: punctuation becomes a blank, so words stay apart."""
    return collapse_spaces(sub(collapse_spaces(value), r"[\p{P}\p{S}]+", " "))


def strip_chapters(value: Sql) -> Sql:
    out = collapse_spaces(value)
    for regex, ignore_case in CHAPTER_MARKERS:
        out = sub(out, regex, " ", ignore_case)
    return collapse_spaces(out)


def chapter_number(value: Sql) -> Sql:
    """Chapter number, null when there is none."""

    def first(v: Sql) -> Sql:
        hits = [f"try_cast(regexp_extract({v}, {pattern(p, ic)}, 1) as int)" for p, ic in CHAPTER_NUMBERS]
        return f"coalesce({', '.join(hits)})"

    return let(collapse_spaces(value), first)


def strip_decorations(value: Sql) -> Sql:
    """Up to three decoration blocks off each end."""
    return collapse_spaces(
        repeat(
            collapse_spaces(value), 3, lambda s: sub(sub(s, LEADING_DECORATION), TRAILING_DECORATION)
        )
    )


def bigrams(value: Sql) -> Sql:
    return let(
        text(value),
        lambda v: case(
            (f"length({v}) = 0", "cast(array() as array<string>)"),
            (f"length({v}) = 1", f"array({v})"),
            default=f"transform(sequence(1, length({v}) - 1), i -> substr({v}, i, 2))",
        ),
    )


def has_meaningful_chars(value: Sql) -> Sql:
    return has(text(value), rf"[\p{{L}}\p{{N}}]|{CJK}")


def meaningful_length(value: Sql) -> Sql:
    return f"length({sub(text(value), r'[\s\p{P}\p{S}]')})"


def truncate(value: Sql, limit: int = 80) -> Sql:
    v = text(value)
    return f"if(length({v}) > {limit}, concat(left({v}, {limit - 1}), '…'), {v})"


def clip(value: Sql, limit: int) -> Sql:
    """Keep ``limit`` characters and mark the cut (the report variant of ``truncate``)."""
    v = text(value)
    return f"if(length({v}) > {limit}, concat(left({v}, {limit}), '…'), {v})"


def script_of(value: Sql) -> Sql:
    def kinds(v: Sql) -> Sql:
        found = (
            f"array_compact(array(if({has(v, CJK)}, 'cjk', null), if({has(v, '[A-Za-z]')}, 'latin', null),"
            f" if({has(v, '[0-9]')}, 'digit', null)))"
        )
        return f"coalesce(nullif(array_join({found}, '+'), ''), 'none')"

    return let(text(value), kinds)


def lang_family(value: Sql) -> Sql:
    return let(
        text(value),
        lambda v: case(
            (has(v, KANA), "'ja'"), (has(v, HAN), "'zh'"), (has(v, "[A-Za-z]"), "'latin'"), default="'none'"
        ),
    )


def title_rank(value: Sql) -> Sql:
    """2 = contains kana, 1 = Han only, 0 = neither."""
    return case((has(value, KANA), "2"), (has(value, HAN), "1"), default="0")


def short_hash(value: Sql, length: int = 8) -> Sql:
    """32-bit FNV-1a over UTF-16 units as lower-case hex.  Kept only where an existing
    report key has to be reproduced; new keys use ``xxhash64``."""

    def digest(encoded: Sql) -> Sql:
        # cut in one pass: substr would count to each unit from the start of the text again
        units = f"regexp_extract_all({encoded}, '(....)', 1)"
        return f"aggregate({units}, 2166136261L, (h, u) -> ((h ^ cast(conv(u, 16, 10) as bigint)) * 16777619L) & 4294967295L)"

    hashed = let(f"hex(encode({text(value)}, 'UTF-16BE'))", digest)
    return f"left(lpad(lower(hex({hashed})), 8, '0'), {length})"


def lines_of(value: Sql) -> Sql:
    """Array of (line, content), lines counted from one."""
    return f"transform(split({text(value)}, '\\n', -1), (l, i) -> named_struct('line', i + 1, 'content', l))"
