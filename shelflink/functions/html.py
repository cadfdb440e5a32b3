"""Reading values out of raw HTML with built-in regex and array functions.

There is no DOM in the engine: the rules cover the listed tags, attributes and
selectors.  Elements that can nest are closed at their balanced end tag.
"""

from __future__ import annotations

import json
from functools import partial

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sql as S
from .sql import Sql, any_of, case, each, keep, let, pattern, quote, text
from .text import collapse_spaces, decode_entities, trim_blanks

# Markup only needs ASCII blanks.
sub, has, grab, grab_all = (partial(f, ascii=True) for f in (S.sub, S.has, S.grab, S.grab_all))

# Labels of a work's info block (followed by a colon).
INFO_FIELDS = (
    "parodies|tags|groups?|languages?|categories|category|pages|artists?|circles?|characters?|"
    "uploaded|favorites?|原作|サークル|作者|タグ|ジャンル|ページ数|収録"
)
# Where the info block is looked for, in this order.
INFO_SELECTORS = [
    ("id", "tags"),
    ("id", "info"),
    ("class", "tag-container"),
    ("class", "tags"),
    ("class", "info"),
    ("class", "work-info"),
    ("id", "work_info"),
    ("tag", "dl"),
]
_ANY_CONTAINER = (
    r"<(main|article)(?=[\s>/])[^>]*>"
    r"|<([a-z][a-z0-9]*)(?=[^>]*\sid\s*=\s*[\"']?(?:content|chapter|reader)[\"'\s>])[^>]*>"
    r"|<([a-z][a-z0-9]*)(?=[^>]*\sclass\s*=\s*(?:\"(?:[^\"]*\s)?(?:content|chapter|reader)[\s\"]"
    r"|'(?:[^']*\s)?(?:content|chapter|reader)[\s']))[^>]*>"
)


def visible(html: Sql) -> Sql:
    """Document without comments, scripts and styles."""
    return sub(text(html), r"(?is)<!--.*?-->|<(script|style)(?=[\s>])[^>]*>.*?</\1\s*>", " ")


def attr(tag: Sql, name: str) -> Sql:
    regex = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return decode_entities("concat(" + ", ".join(grab(tag, regex, g) for g in (1, 2, 3)) + ")")


def text_content(html: Sql) -> Sql:
    return collapse_spaces(decode_entities(sub(text(html), r"<[^>]*>")))


def title_text(doc: Sql) -> Sql:
    return collapse_spaces(decode_entities(grab(doc, r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>")))


def meta_tags(doc: Sql) -> Sql:
    """Array of (property, name, content) in document order."""
    return each(
        grab_all(doc, r"(?is)(<meta\s[^>]*>)"),
        lambda t: f"named_struct('property', {attr(t, 'property')}, 'name', {attr(t, 'name')},"
        f" 'content', {trim_blanks(attr(t, 'content'))})",
    )


def meta_content(metas: Sql, names: list[str]) -> Sql:
    """First name whose first tag has a non-empty content."""
    firsts = []
    for name in names:
        tagged = keep(metas, lambda m: any_of([f"{m}.property = {quote(name)}", f"{m}.name = {quote(name)}"]))
        firsts.append(f"nullif(get({tagged}, 0).content, '')")
    return f"coalesce({', '.join(firsts)}, '')"


def _balanced(after_open: Sql, tag: Sql) -> Sql:
    """Content up to the end tag that closes ``tag`` (``after_open`` starts inside it)."""

    def walk(pieces: Sql) -> Sql:
        name = grab("p", r"^</?([a-zA-Z][a-zA-Z0-9]*)")
        change = case(
            (f"lower({name}) <> lower({tag})", "0"), ("startswith(p, '</')", "-1"), default="1"
        )
        step = let(
            f"acc.depth + {change}",
            lambda d: f"named_struct('depth', {d}, 'n', if({d} <= 0, acc.n, acc.n + 1))",
        )
        open_pieces = (
            f"aggregate({pieces}, named_struct('depth', 1, 'n', 0),"
            f" (acc, p) -> if(acc.depth <= 0, acc, {step}), acc -> acc.n)"
        )
        return f"array_join(slice({pieces}, 1, {open_pieces}), '')"

    def choose(rest: Sql) -> Sql:
        lower = f"lower({rest})"

        def cut(end: Sql) -> Sql:
            lazy = f"left({rest}, {end} - 1)"
            whole_name = rf"rlike(substr({rest}, {end} + length({tag}) + 2, 1), r'[\s>]')"
            nested = f"contains(lower({lazy}), concat('<', lower({tag})))"
            return case(
                (f"{end} = 0", rest),
                (f"{whole_name} and not {nested}", lazy),
                default=let(f"split({rest}, r'(?=</?[a-zA-Z])')", walk),
            )

        return let(f"locate(concat('</', lower({tag})), {lower})", cut)

    return let(after_open, choose)


def _element(doc: Sql, opening: str, tag_groups: int) -> Sql:
    """Inner HTML of the first element whose start tag matches ``opening``."""

    def inner(start: Sql) -> Sql:
        names = ", ".join(grab(start, rf"(?is){opening}", g + 1) for g in range(tag_groups))
        rest = f"substr({doc}, locate({start}, {doc}) + length({start}))"
        return f"if({start} = '', '', {let(f'concat({names})', lambda tag: _balanced(rest, tag))})"

    return let(grab(doc, rf"(?is)({opening})", 1), inner)


def opening_of(kind: str, value: str) -> str:
    if kind == "tag":
        return rf"<({value})(?=[\s>/])[^>]*>"
    if kind == "id":
        return rf"<([a-z][a-z0-9]*)(?=[^>]*\sid\s*=\s*[\"']?{value}[\"'\s>])[^>]*>"
    return (
        rf"<([a-z][a-z0-9]*)(?=[^>]*\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{value}[\s\"]"
        rf"|'(?:[^']*\s)?{value}[\s']))[^>]*>"
    )


def element_by(doc: Sql, kind: str, value: str) -> Sql:
    return _element(doc, opening_of(kind, value), 1)


def text_sample(doc: Sql, limit: int | None = None) -> Sql:
    body = grab(doc, r"(?is)<body(?=[\s>])[^>]*>(.*?)(?:</body\s*>|$)")
    source = case(
        (has(doc, rf"(?is)(?:{_ANY_CONTAINER})"), _element(doc, _ANY_CONTAINER, 3)),
        (has(doc, r"(?is)<body[\s>]"), body),
        default=doc,
    )
    content = text_content(source)
    return content if limit is None else f"left({content}, {limit})"


def info_text(doc: Sql) -> Sql:
    """First info block with enough text; later selectors are only tried when needed."""
    found = []
    for kind, value in INFO_SELECTORS:
        marker = rf"(?i)<{value}[\s>]" if kind == "tag" else rf"(?i)=\s*[\"']?[^\"'<>]*{value}"
        block = let(
            text_content(element_by(doc, kind, value)),
            lambda t: f"if(length({t}) >= 20, {t}, null)",
        )
        found.append(f"if({has(doc, marker)}, {block}, null)")
    return f"coalesce({', '.join(found)}, '')"


def info_fields(value: Sql) -> Sql:
    found = grab_all(text(value), rf"(?i)(?:^|[^a-z])({INFO_FIELDS})[\s　 ]*[:：]")
    return f"array_distinct({each(found, lambda f: sub(f'lower({f})', r's$'))})"


def tag_texts(doc: Sql, tag: str, limit: int) -> Sql:
    """Texts of the first ``limit`` elements, empty ones dropped afterwards."""
    inner = grab_all(doc, rf"(?is)<{tag}(?=[\s>])[^>]*>(.*?)</{tag}\s*>")
    return f"array_remove({each(f'slice({inner}, 1, {limit})', text_content)}, '')"


def heading_list(doc: Sql) -> Sql:
    """(level, tag, text) of title-like elements without repeats; longer texts are no titles."""
    found = grab_all(
        doc,
        r"(?is)(<(h[1-4]|[a-z][a-z0-9]*(?=[^>]*\s(?:role\s*=\s*[\"']?heading|aria-level\s*=)))"
        r"(?=[\s>])[^>]*>.*?</\2\s*>)",
    )
    in_blocks = ", ".join(
        grab_all(
            element_by(doc, "id", block),
            r"(?is)(<([a-z][a-z0-9]*)(?=[^>]*\sclass\s*=\s*\"(?:[^\"]*\s)?title[\s\"])[^>]*>.*?</\2\s*>)",
        )
        for block in ("info", "info-block")
    )
    has_block = has(doc, r"(?is)\sid\s*=\s*[\"']?info(?:-block)?[\"'\s>]")
    pieces = f"array_distinct(concat({found}, if({has_block}, concat({in_blocks}), cast(array() as array<string>))))"

    def read(piece: Sql) -> Sql:
        opening = grab(piece, r"(?is)^(<[^>]*>)")
        level = let(
            f"lower({grab(piece, r'(?is)^<([a-z][a-z0-9]*)')})",
            lambda tag: "named_struct('level', "
            + case(
                (f"try_cast({attr(opening, 'aria-level')} as int) > 0", f"try_cast({attr(opening, 'aria-level')} as int)"),
                (has(tag, r"^h[1-6]$"), f"cast(substr({tag}, 2, 1) as int)"),
                default="3",
            )
            + f", 'tag', {tag}, 'text', {text_content(piece)})",
        )
        return level

    def dedupe(read_pieces: Sql) -> Sql:
        return (
            f"filter({read_pieces}, (h, i) -> length(h.text) between 1 and 200"
            f" and array_position({read_pieces}.text, h.text) = i + 1)"
        )

    return let(each(pieces, read), dedupe)


def image_count(doc: Sql) -> Sql:
    return f"cast(regexp_count({doc}, {pattern(r'(?i)<img(?=[\s>/])', ascii=True)}) as int)"


def page_lang(doc: Sql) -> Sql:
    return attr(grab(doc, r"(?is)(<html(?=[\s>])[^>]*>)"), "lang")


def canonical_link(doc: Sql) -> Sql:
    links = keep(grab_all(doc, r"(?is)(<link\s[^>]*>)"), lambda t: f"lower({attr(t, 'rel')}) = 'canonical'")
    return let(f"get({links}, 0)", lambda t: f"if({t} is null, '', {attr(t, 'href')})")


def json_ld_blocks(html: Sql) -> Sql:
    blocks = grab_all(
        text(html),
        r"(?is)<script\s[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>",
    )
    return blocks


JSON_LD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("author", T.StringType()),
    ]
)


def _read_json_ld(blocks) -> tuple[str, str, str]:
    name = kind = author = ""
    stack = []
    for block in reversed([] if blocks is None else list(blocks)):
        body = block.strip().removeprefix("<!--").removesuffix("-->")
        try:
            stack.append(json.loads(body))
        except ValueError:
            continue
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            label = node.get("name") or node.get("headline") or node.get("alternateName")
            if not name and isinstance(label, str) and label:
                types = node.get("@type")
                name = label
                kind = ",".join(map(str, types)) if isinstance(types, list) else str(types or "")
            who = node.get("author")
            who = who[0] if isinstance(who, list) and who else who
            if not author and isinstance(who, str):
                author = who
            elif not author and isinstance(who, dict) and who.get("name"):
                author = str(who["name"])
            nested = ("@graph", "mainEntity", "itemListElement", "hasPart")
            stack.extend(node[k] for k in reversed(nested) if node.get(k))
    return name, kind, author


@F.pandas_udf(JSON_LD)
def json_ld(blocks: pd.Series) -> pd.DataFrame:
    """Depth-first name / type / author of a page's linked-data blocks.  Nesting is
    unbounded there, which column expressions cannot walk."""
    rows = [_read_json_ld(b) for b in blocks]
    return pd.DataFrame(rows, columns=["name", "type", "author"])


json_ld = json_ld.asNondeterministic()  # see text.nfkc
