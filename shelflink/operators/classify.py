"""Which pages describe a work: ordered guards, signals, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import urls as U
from ..functions.sql import any_of, case, count_true, has, let, quote, text

# Hosts that never carry a work page.
DENIED_HOSTS = [
    "dlsite.com", "dmm.co.jp", "melonbooks.co.jp", "pixiv.net", "fanbox.cc", "fantia.jp",
    "google.com", "google.com.hk", "google.co.jp", "bing.com", "baidu.com", "duckduckgo.com",
    "yandex.com", "sogou.com", "so.com", "twitter.com", "x.com", "facebook.com", "instagram.com",
    "tiktok.com", "weibo.com", "reddit.com", "zhihu.com", "douban.com", "tieba.baidu.com",
    "youtube.com", "youtu.be", "bilibili.com", "nicovideo.jp", "netflix.com", "twitch.tv",
    "amazon.com", "amazon.co.jp", "taobao.com", "tmall.com", "jd.com", "ebay.com",
    "rakuten.co.jp", "github.com", "gitlab.com", "stackoverflow.com", "developer.mozilla.org",
    "wikipedia.org", "wikimedia.org", "notion.so", "docs.google.com", "mail.google.com",
    "outlook.com", "chatgpt.com", "chat.openai.com", "openai.com", "claude.ai", "localhost",
]

# Address shapes that are skipped.
DENIED_URLS = [
    r"^\w+://(?:www\.)?google\.[a-z.]+/search",
    r"^\w+://(?:www\.)?bing\.com/search",
    r"^\w+://(?:www\.)?baidu\.com/s",
    r"/search\?",
    r"^chrome(-extension)?://",
    r"^about:",
    r"^devtools://",
]

# Chapter markers, topic words (with the name of the signal), host words.
CHAPTER_SIGNALS = [
    (r"第\s*\d{1,4}\s*[話话回巻卷集章]", False),
    (r"(?:chapter|episode|ep|vol|volume)\.?\s*\d{1,4}", True),
]
TOPIC_SIGNALS = [
    r"漫画|漫畫|マンガ|コミック|comic|manga|manhua|manhwa",
    r"連載|连载|全巻|全卷|話|话|巻|巻數|在线阅读|在线观看|免費|免费|汉化|漢化|生肉|raw",
    r"試し読み|立ち読み|ネタバレ|同人|成人向け|R-?18",
]
TOPIC_NAME_LENGTH = 24
HOST_WORDS = [
    "manga", "comic", "manhua", "manhwa", "dongman", "dm5", "copymanga", "baozimh", "manhuagui",
    "kox", "mangacopy", "mangacat", "yymanhua", "cartoon", "acg", "comiket", "doujin",
    "nhentai", "hentai", "e-hentai", "exhentai", "hitomi", "asmhentai", "18comic", "jmcomic",
    "wnacg", "tsumino", "pururin",
]

# Fields of a gallery info block.
GALLERY_SIGNALS = [
    (r"\bparodies\s*[:：]", True),
    (r"\b(?:tags|groups?|languages?|categories|category|pages|artists?|circles?|characters?|uploaded|favorites?)\s*[:：]", True),
    (r"\bpages\s*[:：]\s*\d+", True),
    (r"\b\d+\s*(?:pages|ページ)(?![A-Za-z0-9_])", True),
    (r"原作\s*[:：]", False),
    (r"サークル\s*[:：]", False),
    (r"作者\s*[:：]", False),
    (r"タグ\s*[:：]", False),
    (r"ジャンル\s*[:：]", False),
    (r"ページ数\s*[:：]", False),
    (r"収録\s*[:：]", False),
]
DETAIL_URL = (
    r"/(?:g|gallery|galleries|view|work|works|comic|comics|manga|book|books|read|chapter|ch|ep|episode|"
    r"detail|doujinshi|p|post)/[^/?#]+"
)
STRONG = ("chapter-marker-in-title", "chapter-marker-in-page", "structured-data-book", "gallery-structure")


def on_denied_hosts(pages: DataFrame, host: str = "host", denied: DataFrame | None = None) -> DataFrame:
    """Pages whose host equals a deny entry or is a subdomain of one.  The built-in list
    is a predicate inside the scan; another list is a table ``denied(entry)``."""
    if denied is None:
        return pages.where(is_denied_host(host))
    return _by_entry(pages, host, denied, "left_semi")


def off_denied_hosts(pages: DataFrame, host: str = "host", denied: DataFrame | None = None) -> DataFrame:
    if denied is None:
        return pages.where(f"not {is_denied_host(host)}")
    return _by_entry(pages, host, denied, "left_anti")


def _by_entry(pages: DataFrame, host: str, denied: DataFrame, how: str) -> DataFrame:
    """Distinct hosts meet the deny table by an equality join on their suffixes, so the
    suffixes are built once per host, not once per page."""
    hosts = pages.select(F.lower(host).alias("_host")).distinct()
    hit = (
        hosts.withColumn("entry", F.explode(F.expr(U.host_suffixes("_host"))))
        .join(denied.select(F.lower("entry").alias("entry")), "entry", "left_semi")
        .select("_host")
        .distinct()
    )
    return pages.join(hit, F.lower(pages[host]) == hit["_host"], how)


def is_denied_host(host: str) -> str:
    """The same test as a predicate; the fixed list is one hash-set lookup per suffix."""
    names = ", ".join(quote(h) for h in DENIED_HOSTS)
    return f"exists({U.host_suffixes(f'lower({host})')}, s -> s in ({names}))"


def chapter_marker(value: str) -> str:
    return any_of([has(value, p, ic) for p, ic in CHAPTER_SIGNALS])


def page_signals(page_info: DataFrame) -> DataFrame:
    """Adds ``signals``: every hint that the page belongs to a work, in fixed order."""
    parts = ["og_title", "site_name", "description", "keywords", "json_ld_name", "array_join(h1, ' ')"]
    blank_free = ", ".join(f"nullif({text(p)}, '')" for p in parts)
    prepared = page_info.withColumns(
        {
            "_meta": F.expr(f"concat_ws(' \n ', {blank_free})"),
            "_info": F.expr(f"concat({text('text_sample')}, ' \n ', {text('info_text')})"),
            "_detail": F.expr(has("url", DETAIL_URL, True)),
            "_host_hint": F.expr(any_of([f"contains(lower({text('host')}), {quote(w)})" for w in HOST_WORDS])),
        }
    )
    images = "coalesce(image_count, 0)"
    gallery = let(
        count_true([has("_info", p, ic) for p, ic in GALLERY_SIGNALS]),
        lambda n: f"({n} >= 2 or ({n} >= 1 and {images} >= 8 and _detail))",
    )
    topic_text = f"concat({text('title')}, ' ', _meta)"
    topics = [
        (has(topic_text, p, True), "meta:" + p[:TOPIC_NAME_LENGTH]) for p in TOPIC_SIGNALS
    ]
    named = [
        (f"{chapter_marker(text('title'))} or {chapter_marker('_meta')}", "chapter-marker-in-title"),
        (chapter_marker(text("text_sample")), "chapter-marker-in-page"),
        (gallery, "gallery-structure"),
        *topics,
        ("_host_hint", "manga-like-host"),
        (has("json_ld_type", "book|comic|article", True), "structured-data-book"),
        ("_detail", "detail-like-url"),
        (f"_detail and {images} >= 6", "gallery-images"),
    ]
    listed = ", ".join(f"if({cond}, {quote(name)}, null)" for cond, name in named)
    return prepared.withColumn("signals", F.expr(f"array_compact(array({listed}))")).drop(
        "_meta", "_info", "_detail", "_host_hint"
    )


def guard_reason(cfg: Config) -> str:
    """First guard that stops the page, null when none does."""
    path = f"regexp_replace({U.path_of('url')}, '/+$', '')"
    return case(
        (f"{text('url')} = ''", "'no-page-info'"),
        (f"not {U.is_absolute('url')}", "'invalid-url'"),
        (f"{U.scheme_of('url')} not in ('http', 'https', 'file')", "'unsupported-scheme'"),
        (is_denied_host(U.host_of("url")), "'denylisted-host'"),
        (any_of([has("url", p, True) for p in DENIED_URLS]), "'denylisted-url'"),
        ("settled = false", "'page-settling'"),
        (f"{path} in ('', '/index.html')", "'site-root'"),
        (str(cfg.ignore_site_filter).lower(), "'forced'"),
    )


def classify_pages(page_info: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Adds ``allowed``, ``reason`` and ``signals``.  Guarded pages carry no signals."""
    guarded = page_info.withColumn("_guard", F.expr(guard_reason(cfg)))
    signalled = page_signals(guarded).withColumn(
        "signals", F.expr("if(_guard is null, signals, cast(array() as array<string>))")
    )
    strong = ", ".join(quote(s) for s in STRONG)
    meta = "size(filter(signals, s -> startswith(s, 'meta:')))"
    reason = case(
        ("_guard is not null", "_guard"),
        (f"arrays_overlap(signals, array({strong}))", "'strong-signal'"),
        (
            "array_contains(signals, 'manga-like-host') and array_contains(signals, 'detail-like-url')",
            "'manga-host-detail-url'",
        ),
        (f"{meta} >= 2", "'multiple-meta-signals'"),
        (f"array_contains(signals, 'gallery-images') and {meta} >= 1", "'detail-page-with-images'"),
        default="'no-comic-signal'",
    )
    passed = (
        "reason in ('forced', 'strong-signal', 'manga-host-detail-url', 'multiple-meta-signals',"
        " 'detail-page-with-images')"
    )
    return (
        signalled.withColumn("reason", F.expr(reason))
        .withColumn("allowed", F.expr(passed))
        .drop("_guard")
    )
