"""Raw pages -> structured page summaries, one narrow pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..functions.sql import Sql, each, let, text


def extract_pages(pages: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``pages(page_id, url, html[, navigation_type, analysis_count, captured_at])`` ->
    page summaries.  The HTML itself never leaves the scan stage."""
    extra = {
        "navigation_type": F.lit("load"),
        "analysis_count": F.lit(1),
        "captured_at": F.lit(None).cast("timestamp"),
    }
    passed = [F.col(c) if c in pages.columns else default.alias(c) for c, default in extra.items()]
    doc = pages.select(
        "page_id",
        "url",
        *passed,
        F.expr(H.visible("html")).alias("doc"),
        F.expr(H.json_ld_blocks("html")).alias("ld_blocks"),
    )
    read = doc.select(
        "page_id",
        "url",
        *extra,
        *_named(
            title=H.title_text("doc"),
            h1=H.tag_texts("doc", "h1", 3),
            h2=H.tag_texts("doc", "h2", 3),
            h3=H.tag_texts("doc", "h3", 2),
            headings=H.heading_list("doc"),
            metas=H.meta_tags("doc"),
            canonical_url=H.canonical_link("doc"),
            lang=H.page_lang("doc"),
            image_count=H.image_count("doc"),
            text_sample=H.text_sample("doc", cfg.text_sample),
            info_text=H.info_text("doc"),
            body_length=f"length({H.text_content('doc')})",
        ),
        H.json_ld(F.col("ld_blocks")).alias("ld"),
    )
    summary = read.select(
        "page_id",
        "url",
        *_named(host=U.host_of("url"), origin=U.origin_of("url")),
        "title",
        "h1",
        "h2",
        "h3",
        "headings",
        *_named(
            og_title=H.meta_content("metas", ["og:title"]),
            og_type=H.meta_content("metas", ["og:type"]),
            site_name=H.meta_content("metas", ["og:site_name", "application-name"]),
            description=H.meta_content("metas", ["description", "og:description"]),
            keywords=H.meta_content("metas", ["keywords"]),
            json_ld_name="ld.name",
            json_ld_type="ld.type",
            json_ld_author="ld.author",
            canonical_url="canonical_url",
            og_url=H.meta_content("metas", ["og:url"]),
        ),
        "lang",
        "image_count",
        "text_sample",
        "info_text",
        F.expr(H.info_fields("info_text")).alias("info_fields"),
        "body_length",
        *extra,
    )
    return summary.withColumn("settled", F.expr(f"not {content_url_mismatch()}"))


def _named(**columns: Sql):
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def content_url_mismatch() -> Sql:
    """The page declares an address (og:url, canonical) that is neither this page's
    path nor above or below it: the content still belongs to another page."""

    def wrong(here: Sql, declared: str) -> Sql:
        return let(
            U.path_key(U.resolve_against("url", declared)),
            lambda key: f"({text(declared)} <> '' and {key} <> '' and not ({key} = {here}"
            f" or startswith({key}, concat({here}, '/')) or startswith({here}, concat({key}, '/'))))",
        )

    return let(
        U.path_key("url"),
        lambda here: f"({here} <> '' and ({wrong(here, 'og_url')} or {wrong(here, 'canonical_url')}))",
    )


def content_signature(page_info: DataFrame) -> DataFrame:
    """Adds ``signature`` / ``signature_hash``: what changes when the content is swapped."""
    return page_info.withColumn(
        "signature",
        F.expr(
            "concat_ws('::', coalesce(title, ''), array_join(slice(concat(h1, h2, h3), 1, 6), ' | '),"
            " left(coalesce(info_text, ''), 160), cast(image_count as string), cast(body_length as string))"
        ),
    ).withColumn("signature_hash", F.xxhash64("signature"))


# How much of a page summary a later re-run keeps.
REPLAY_TEXT = {
    "title": 300,
    "og_title": 300,
    "og_type": 60,
    "site_name": 120,
    "description": 400,
    "keywords": 200,
    "json_ld_name": 300,
    "json_ld_type": 120,
    "json_ld_author": 120,
    "lang": 20,
    "text_sample": 400,
    "info_text": 600,
}
REPLAY_LISTS = {"h1": (3, 200), "h2": (3, 200), "h3": (2, 200), "info_fields": (12, 24)}


def replay_projection(page_info: DataFrame) -> DataFrame:
    """Clipped page summary that still replays through the whole job."""

    changed = {name: X.clip(name, limit) for name, limit in REPLAY_TEXT.items()}
    for name, (count, limit) in REPLAY_LISTS.items():
        clipped = each(f"slice({name}, 1, {count})", lambda x, limit=limit: X.clip(x, limit))
        changed[name] = f"array_remove({clipped}, '')"
    heading = (
        "named_struct('level', coalesce(nullif(h.level, 0), 3), 'tag', lower(coalesce(h.tag, 'h3')),"
        f" 'text', {X.clip('h.text', 120)})"
    )
    changed["headings"] = f"filter(transform(slice(headings, 1, 6), h -> {heading}), h -> h.text <> '')"
    changed["navigation_type"] = "if(navigation_type = 'spa', 'spa', 'load')"
    changed["analysis_count"] = "coalesce(nullif(analysis_count, 0), 1)"
    return page_info.withColumns({name: F.expr(sql) for name, sql in changed.items()})
