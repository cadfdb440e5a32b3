"""Page structure: features, fingerprint, category, and how new a structure is."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import text as X
from ..functions import urls as U
from ..functions.html import info_fields
from ..functions.sql import Sql, case, has, let, text, yes_no
from .classify import DETAIL_URL

# Chapter marker, page-type letters, token weights, novelty bands.
CHAPTER_MARKER = r"第\s*\d{1,4}\s*[話话回巻卷集章]|(?:chapter|episode|vol|volume)\.?\s*\d{1,4}"
TYPE_LETTERS = {"gallery": "G", "reader": "R", "article": "A", "listing": "L", "unknown": "U"}
WEIGHTS = {
    "type": 3.0, "spa": 2.0, "jl": 2.0, "info": 2.0, "img": 1.5, "h1": 1.5, "og": 1.0,
    "chapter": 1.0, "lang": 0.5, "title": 0.5,
}
TOTAL_WEIGHT = 15.0
BANDS = [(20, "duplicate"), (50, "minor-new"), (80, "clearly-new"), (100, "new-type")]
MESSAGES = {
    "duplicate": "This page is structurally similar to an existing test case.",
    "minor-new": "Minor new features detected.",
    "clearly-new": "New page structure detected.",
    "new-type": "New page structure type detected.",
}


def image_bucket(count: Sql) -> Sql:
    return case((f"{count} >= 40", "'IMG40'"), (f"{count} >= 8", "'IMG8'"), default="'IMG0'")


def title_bucket(title: Sql) -> Sql:
    return let(
        f"length({X.trim_blanks(text(title))})",
        lambda n: case(
            (f"{n} = 0", "'none'"), (f"{n} < 12", "'short'"), (f"{n} < 30", "'medium'"), default="'long'"
        ),
    )


def page_features(pages: DataFrame) -> DataFrame:
    """Adds ``features`` (19 values), ``fingerprint``, ``fingerprint_lines``, ``category``.
    A ``signals`` column, when present, is the classification of the page."""
    signals = "array_contains(signals, 'gallery-structure')" if "signals" in pages.columns else "false"
    bodies = f"concat({text('text_sample')}, ' ', {text('info_text')})"
    path = f"if({U.is_absolute('url')}, {U.path_of('url')}, {text('url')})"
    prepared = pages.withColumns(
        {
            "_fields": F.expr(
                f"if(size(info_fields) > 0, array_distinct(transform(info_fields, f -> lower(f))), {info_fields('info_text')})"
            ),
            "_in_title": F.expr(has(text("title"), CHAPTER_MARKER, True)),
            "_in_body": F.expr(has(bodies, CHAPTER_MARKER, True)),
            "_in_heads": F.expr(has("concat_ws(' ', h1, h2)", CHAPTER_MARKER, True)),
            "_images": F.expr("coalesce(image_count, 0)"),
            "_detail": F.expr(has(f"concat('/', ltrim('/', {path}))", DETAIL_URL, True)),
            "_article": F.expr(
                f"{has('og_type', 'article|blog|news|post', True)} or"
                f" {has(path, '(?:^|/)(?:posts?|blog|articles?|news|diary)/', True)}"
            ),
        }
    )
    chapter = "(_in_title or _in_body or _in_heads)"
    kind = case(
        (f"{signals} or size(_fields) >= 2", "'gallery'"),
        (f"{chapter} and _images >= 12", "'reader'"),
        ("_images >= 20 and _detail", "'reader'"),
        ("_article", "'article'"),
        ("not _detail and _images < 8", "'listing'"),
        (f"_images < 8 and not {chapter}", "'article'"),
        default="'unknown'",
    )
    h1 = "(size(h1) > 0 or exists(headings, h -> h.level = 1 or lower(h.tag) = 'h1'))"
    features = (
        f"named_struct('page_type', {kind}, 'h1', coalesce({h1}, false), 'og_title', {text('og_title')} <> '',"
        f" 'json_ld', {text('json_ld_name')} <> '' or {text('json_ld_type')} <> '',"
        " 'gallery_info', size(_fields) >= 2, 'many_images', _images >= 40,"
        " 'spa_navigation', coalesce(navigation_type = 'spa', false), 'chapter_marker', _in_title or _in_body,"
        f" 'image_count', _images, 'image_bucket', {image_bucket('_images')}, 'info_fields', _fields,"
        f" 'info_field_count', size(_fields), 'has_description', {text('description')} <> '',"
        f" 'has_canonical', {text('canonical_url')} <> '', 'has_site_name', {text('site_name')} <> '',"
        f" 'lang', {text('lang')}, 'lang_family', {X.lang_family('title')},"
        f" 'title_length', length({X.trim_blanks(text('title'))}), 'title_bucket', {title_bucket('title')})"
    )
    return (
        prepared.withColumn("features", F.expr(features))
        .withColumns(
            {
                "fingerprint": F.expr(fingerprint_of("features")),
                "fingerprint_lines": F.expr(fingerprint_lines("features")),
                "category": F.expr(category_of("features")),
            }
        )
        .drop("_fields", "_in_title", "_in_body", "_in_heads", "_images", "_detail", "_article")
    )


def fingerprint_of(f: Sql) -> Sql:
    letters = case(*[(f"{f}.page_type = '{k}'", f"'{v}'") for k, v in TYPE_LETTERS.items()], default="'U'")
    return (
        f"concat_ws('-', {letters}, {yes_no(f + '.h1', 'H1', 'NH1')}, {yes_no(f + '.og_title', 'OG', 'NOG')},"
        f" {yes_no(f + '.json_ld', 'JL', 'NJ')}, {f}.image_bucket, {yes_no(f + '.gallery_info', 'INFO', 'NOINFO')},"
        f" {yes_no(f + '.spa_navigation', 'SPA', 'STATIC')})"
    )


def fingerprint_lines(f: Sql) -> Sql:
    flag = lambda name, field: f"concat('{name}=', {yes_no(f'{f}.{field}', 'yes', 'no')})"
    images = f"if({f}.image_count >= 40, 'images=40+', concat('images=', {f}.image_count))"
    return (
        f"array({f}.page_type, {flag('h1', 'h1')}, {flag('og', 'og_title')}, {flag('jsonld', 'json_ld')},"
        f" {images}, {flag('info-block', 'gallery_info')}, {flag('spa', 'spa_navigation')})"
    )


def category_of(f: Sql) -> Sql:
    return case(
        (f"{f}.spa_navigation", f"concat('spa-', {f}.page_type)"),
        (f"{f}.chapter_marker and {f}.page_type <> 'gallery'", f"concat({f}.page_type, '-chapter')"),
        (f"not {f}.h1 and not {f}.og_title and not {f}.json_ld", "'meta-poor'"),
        (f"not {f}.h1", f"concat({f}.page_type, '-no-h1')"),
        default=f"concat('static-', {f}.page_type)",
    )


def category_dir_of(category: Sql, f: Sql) -> Sql:
    fixed = "('extraction', 'cleaning', 'matching', 'navigation', 'store', 'performance', 'negative')"
    return case(
        (f"{category} in {fixed}", category),
        (f"coalesce({f}.spa_navigation, false) or startswith(coalesce({category}, ''), 'spa-')", "'navigation'"),
        (f"{category} = 'not-a-work-page' or {f}.page_type in ('listing', 'article')", "'negative'"),
        (f"not coalesce({f}.gallery_info, false)", "'cleaning'"),
        default="'extraction'",
    )


def feature_tokens(f: Sql) -> dict[str, Sql]:
    flag = lambda field: f"cast(coalesce({f}.{field}, false) as int)"
    return {
        "type": f"coalesce({f}.page_type, 'unknown')",
        "spa": flag("spa_navigation"),
        "jl": flag("json_ld"),
        "info": flag("gallery_info"),
        "img": f"coalesce({f}.image_bucket, 'IMG0')",
        "h1": flag("h1"),
        "og": flag("og_title"),
        "chapter": flag("chapter_marker"),
        "lang": f"coalesce({f}.lang_family, 'none')",
        "title": f"coalesce({f}.title_bucket, 'none')",
    }


def similarity(a: Sql, b: Sql) -> Sql:
    """Weighted share of equal tokens of two features structs."""
    left, right = feature_tokens(a), feature_tokens(b)
    same = " + ".join(f"if({left[k]} = {right[k]}, {w}D, 0D)" for k, w in WEIGHTS.items())
    return f"(({same}) / {TOTAL_WEIGHT}D)"


def novelty_verdict(score: Sql) -> Sql:
    return case(*[(f"{score} <= {top}", f"'{name}'") for top, name in BANDS], default="'new-type'")


def novelty_message(verdict: Sql) -> Sql:
    return case(*[(f"{verdict} = '{k}'", "'" + v + "'") for k, v in MESSAGES.items()])


def novelty(captures: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Adds ``novelty`` = (score, max_similarity, verdict, similar_to) of each capture
    ``(capture_no, features)`` against every capture with a smaller number;
    ``similar_to`` names the first capture of each structure that is close enough.

    Ten bounded features allow at most 15 360 different structures, so captures are
    first reduced to structures with their first sighting.  A later capture of a known
    structure is a perfect match; only first sightings are compared, and that by
    equality: two structures agree on a set of features exactly when their values on
    that set are equal, so each structure is hashed under the 1 024 feature subsets and
    the best subset with an earlier sighting gives the similarity.  No pair of
    captures is ever formed.
    """
    names = list(WEIGHTS)
    tokens = feature_tokens("features")
    keyed = captures.withColumn("_t", F.expr("array(" + ", ".join(f"cast({tokens[n]} as string)" for n in names) + ")"))
    structures = keyed.groupBy("_t").agg(F.min("capture_no").alias("first_no"))
    subsets = []
    for size in range(len(names) + 1):
        for chosen in combinations(range(len(names)), size):
            mask = sum(1 << i for i in chosen)
            subsets.append((mask, round(sum(WEIGHTS[names[i]] for i in chosen), 1)))
    listed = ", ".join(f"named_struct('mask', {m}, 'w', {w}D)" for m, w in subsets)
    hashed = structures.withColumn("_s", F.explode(F.expr(f"array({listed})"))).select(
        "_t",
        "first_no",
        "_s.mask",
        "_s.w",
        F.expr("filter(_t, (t, i) -> (_s.mask >> i) & 1 = 1)").alias("part"),
    )
    earlier = Window.partitionBy("mask", "part").orderBy("first_no").rowsBetween(Window.unboundedPreceding, -1)
    best = (
        hashed.withColumn("_before", F.count("*").over(earlier))
        .groupBy("_t", "first_no")
        .agg(F.max(F.expr("if(_before > 0, w, 0D)")).alias("_w"))
    )
    near = hashed.where(F.col("w") >= cfg.similar_from * TOTAL_WEIGHT)
    other = near.select("mask", "part", F.col("_t").alias("_u"), F.col("first_no").alias("_no"))
    agreed = "aggregate(zip_with(_t, _u, (a, b) -> a = b), named_struct('m', 0, 'i', 0), (s, e) -> named_struct('m', if(e, s.m | (1 << s.i), s.m), 'i', s.i + 1), s -> s.m)"
    similar = (
        near.join(other, ["mask", "part"])
        .where(f"mask = {agreed} and _no <> first_no")
        .groupBy("_t")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("_no").cast("bigint").alias("capture_no"), F.round(F.col("w") / TOTAL_WEIGHT, 3).alias("similarity")))
            ).alias("_similar")
        )
    )
    scored = best.join(similar, "_t", "left")
    first = "capture_no = first_no"
    nothing = "cast(array() as array<struct<capture_no:bigint,similarity:double>>)"
    score = f"if({first}, cast(floor((1 - _w / {TOTAL_WEIGHT}D) * 100 + 0.5D) as int), 0)"
    return (
        keyed.join(F.broadcast(scored), "_t")  # at most 15 360 rows by construction
        .withColumn(
            "novelty",
            F.expr(
                let(
                    score,
                    lambda s: f"named_struct('score', {s}, 'max_similarity', if({first}, round(_w / {TOTAL_WEIGHT}D, 3), 1D),"
                    f" 'verdict', {novelty_verdict(s)}, 'similar_to', filter(concat(array(named_struct('capture_no', cast(first_no as bigint),"
                    f" 'similarity', 1D)), coalesce(_similar, {nothing})), x -> x.capture_no < capture_no))",
                )
            ),
        )
        .drop("_t", "first_no", "_w", "_similar")
    )
