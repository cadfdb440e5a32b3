"""Page titles -> cleaned titles, ranked sources, search variants, artists.

Everything a page needs is in its own row (at most 19 title sources), so the whole
job is a narrow projection: no explode, no shuffle, no window.  The only Python is
one NFKC pass over the row's titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import text as X
from ..functions import titles as T
from ..functions.sql import case, let, quote


def clean_titles(titles: DataFrame, raw: str = "raw", host: str = "host") -> DataFrame:
    """Adds the struct ``clean`` for one title per row."""
    decoded = titles.withColumn("_raw", F.expr(X.collapse_spaces(X.decode_entities(raw))))
    normalized = decoded.withColumn("_nfkc", X.nfkc("_raw"))
    return normalized.withColumn("clean", F.expr(T.clean_title("_raw", "_nfkc", host))).drop("_raw", "_nfkc")


def _source(source: str, weight: str, value: str) -> str:
    return f"named_struct('source', {source}, 'weight', cast({weight} as double), 'value', {value})"


def _heading_sources() -> str:
    """Levelled headings when the page has any, else the plain h1-h3 lists."""
    level = "least(greatest(coalesce(nullif(h.level, 0), 3), 1), 4)"
    tag = f"lower(coalesce(nullif(h.tag, ''), concat('h', {level})))"
    levelled = (
        f"transform(filter(headings, h -> {X.trim_blanks('h.text')} <> '' and not {T.is_section_heading('h.text')}),"
        f" h -> {_source(f'concat({tag}, {chr(39)}(h{chr(39)}, {level}, {chr(39)}){chr(39)})', f'3 - ({level} - 1) * 0.4D', 'h.text')})"
    )
    plain = ", ".join(
        f"transform(slice(filter(coalesce({name}, cast(array() as array<string>)),"
        f" x -> {X.trim_blanks('x')} <> '' and not {T.is_section_heading('x')}), 1, 3),"
        f" (x, i) -> {_source(f'concat({chr(39)}{name}[{chr(39)}, i, {chr(39)}]{chr(39)})', f'{weight}D - i * 0.1D', 'x')})"
        for name, weight in (("h1", 3.0), ("h2", 2.6), ("h3", 2.0))
    )
    both = f"if(size(headings) > 0, {levelled}, concat({plain}))"
    return let(both, lambda hs: f"filter({hs}, (s, i) -> array_position(transform({hs}, o -> o.value), s.value) = i + 1)")


def title_sources(page_info: DataFrame) -> DataFrame:
    """Adds ``sources``: every usable title of the page with its cleaned form and
    score, best first, ties in page order; and ``title_nfkc`` for the search forms."""
    raw_sources = (
        f"filter(concat(array({_source(quote('title'), '4.5', 'title')}), {_heading_sources()},"
        f" array({_source(quote('og:title'), '2.5', 'og_title')}, {_source(quote('json-ld'), '2', 'json_ld_name')})),"
        f" s -> {X.trim_blanks(X.text('s.value'))} <> '')"
    )
    raw = page_info.withColumn("_sources", F.expr(raw_sources)).withColumn(
        "_raw",
        F.expr(f"array_distinct(transform(_sources, s -> {X.collapse_spaces(X.decode_entities('s.value'))}))"),
    )
    normalized = raw.withColumns({"_nfkc": X.nfkc_each("_raw"), "title_nfkc": X.nfkc("title")})
    cleaned = normalized.withColumn(
        "_clean", F.expr(f"transform(_raw, (r, i) -> {T.clean_title('r', '_nfkc[i]', 'lower(coalesce(host, {}))'.format(quote('')))})")
    )
    value = X.collapse_spaces(X.decode_entities("s.value"))
    bonus = case(("c.confidence = 'high'", "2D"), ("c.confidence = 'medium'", "1D"), default="0D")
    entry = let(
        f"element_at(_clean, cast(array_position(_raw, {value}) as int))",
        lambda c: "named_struct('source', s.source, 'weight', s.weight, 'value', s.value,"
        f" 'raw_title', {c}.raw_title, 'cleaned', {c}.cleaned, 'confidence', {c}.confidence,"
        f" 'notes', {c}.notes, 'chapter_hint', {c}.chapter_hint,"
        f" 'score', s.weight + {bonus.replace('c.', c + '.')} + least(length({c}.cleaned), 30) / 30D, 'ord', i)",
    )
    order = case(
        ("a.score > b.score", "-1"), ("a.score < b.score", "1"), ("a.ord < b.ord", "-1"), default="1"
    )
    return cleaned.withColumn(
        "sources",
        F.expr(f"array_sort(transform(_sources, (s, i) -> {entry}), (a, b) -> {order})"),
    ).drop("_sources", "_raw", "_nfkc", "_clean")


def work_titles(page_info: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Adds ``extraction`` (title, confidence, variants, ...) and ``artists``."""
    ranked = title_sources(page_info)
    usable = "filter(sources, s -> s.confidence <> 'low')"
    picked = ranked.withColumns(
        {
            "_usable": F.expr(usable),
            "_primary": F.expr(f"coalesce(get({usable}, 0), get(sources, 0))"),
            "_raw_title": F.expr(X.collapse_spaces("title")),
        }
    )
    fallback = (
        f"if(length(_raw_title) between 1 and 40 and not {T.is_noise_segment('_raw_title', 'host')},"
        " array(named_struct('value', _raw_title, 'source', _primary.source)),"
        " cast(array() as array<struct<value:string,source:string>>))"
    )
    offered = (
        "concat(array(named_struct('value', _primary.cleaned, 'source', _primary.source)),"
        " transform(slice(_usable, 2, size(_usable)), s -> named_struct('value', s.cleaned, 'source', s.source)),"
        f" {fallback})"
    )
    keyed = let(
        f"transform(filter({offered}, v -> length({X.collapse_spaces('v.value')}) >= 2),"
        f" v -> named_struct('value', {X.collapse_spaces('v.value')}, 'source', v.source,"
        f" 'key', {T.variant_key(X.collapse_spaces('v.value'))}))",
        lambda vs: f"filter({vs}, (v, i) -> v.key <> '' and"
        f" array_position(transform({vs}, o -> o.key), v.key) = i + 1)",
    )
    order = case(
        ("a.rank > b.rank", "-1"), ("a.rank < b.rank", "1"), ("a.pos < b.pos", "-1"), default="1"
    )
    variants = picked.withColumn(
        "_variants",
        F.expr(
            "if(_primary is null, cast(array() as array<struct<value:string,source:string,rank:int,pos:int>>),"
            f" slice(array_sort(transform({keyed}, (v, i) -> named_struct('value', v.value, 'source', v.source,"
            f" 'rank', {X.title_rank('v.value')}, 'pos', i)), (a, b) -> {order}), 1, {max(1, cfg.max_queries)}))"
        ),
    )
    extraction = (
        "named_struct('raw_title', coalesce(_primary.raw_title, ''),"
        " 'source', coalesce(get(_variants, 0).source, _primary.source),"
        " 'cleaned_title', coalesce(get(_variants, 0).value, _primary.cleaned, ''),"
        " 'confidence', coalesce(_primary.confidence, 'low'),"
        " 'notes', coalesce(_primary.notes, array('no-title')),"
        " 'chapter_hint', _primary.chapter_hint,"
        " 'variants', transform(_variants, v -> v.value))"
    )
    return (
        variants.withColumn("extraction", F.expr(extraction))
        .withColumn("artists", F.expr(artist_list()))
        .drop("_usable", "_primary", "_raw_title", "_variants")
    )


def artist_list() -> str:
    headings = (
        "concat(coalesce(h2, cast(array() as array<string>)), coalesce(h3, cast(array() as array<string>)),"
        " transform(headings, h -> coalesce(h.text, '')))"
    )
    return let(
        T.heading_artists(headings),
        lambda found: f"if(size({found}) > 0, {found}, {T.info_artists('info_text')})",
    )


def effective_queries(pages: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Adds ``queries``: the keyword forms that are actually searched, in order."""
    variants = "extraction.variants"
    long = f"filter({variants}, v -> length(v) >= {cfg.min_query_length})"
    chosen = (
        f"slice(if(size({long}) > 0, {long}, {variants}), 1, {max(1, min(cfg.searched_variants, cfg.max_queries))})"
    )
    value = f"if(v = {X.collapse_spaces('title')}, title_nfkc, v)"
    forms = f"array_remove(array_distinct(transform({chosen}, v -> {X.store_form(value)})), '')"
    return pages.withColumn("queries", F.expr(let(forms, lambda f: f"if(size({f}) > 0, {f}, {chosen})")))
