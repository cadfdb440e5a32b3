"""Registered queries over the driver tables, each with its ANSI-SQL oracle where the
semantics can be written in SQL.  Every query reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as X
from ..functions import urls as U
from ..functions.scores import containment, estimate_cny, match_label, resolve_rate, score_pairs
from ..operators import cache, captures, classify, clean, fingerprint, health, identifiers, match, quality, redact, replay, similar
from ..operators.extract import extract_pages
from ..operators.search import answers, search_catalogue, search_titles
from ..scale import checkpoint_dir, drop_stage, spread, stage
from ..sources import reports, responses
from ..streaming import gates, sink, state
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# --- SQL pieces shared by several oracles ---------------------------------------
_DECODE = (
    "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({x},"
    " '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '—'), '&ndash;', '–'),"
    " '&hellip;', '…'), '&middot;', '·'), '&times;', '×'), '&yen;', '¥'), '&amp;', '&')"
)


def _sql_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_TITLE = _sql_space(_DECODE.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_H1 = _sql_space(_DECODE.format(x="regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))
_SAMPLE = _sql_space(
    _DECODE.format(x="regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g')")
)
_HEAD = "trim(split_part(text, chr(10), 1))"
_STORE = "['dlsite','fanza','melonbooks','pixiv','fantia'][(CAST(substr(source, 4) AS INT) % 5) + 1]"
_STEP = (
    "CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'primary' ELSE 'female' END"
    " WHEN 3 THEN CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'tag' ELSE 'title-caption' END ELSE 'search' END"
)


def _sql_store_form(x: str) -> str:
    return _sql_space(f"regexp_replace({_sql_space(x)}, '[\\p{{P}}\\p{{S}}]+', ' ', 'g')")


def _sql_match_form(x: str) -> str:
    return f"regexp_replace(lower({x}), '[\\s\\p{{P}}\\p{{S}}]', '', 'g')"


# --- pages ---------------------------------------------------------------------------


@query(
    "page_extract",
    f"SELECT page_id, {_TITLE} AS title, {_H1} AS h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang,"
    " regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 0 AS image_count,"
    f" length({_SAMPLE}) AS sample_length, md5({_SAMPLE}) AS sample_digest FROM pages",
)
def page_extract(spark, sf_dir):
    return T.page_info(spark, sf_dir).select(
        "page_id", "title", F.expr("h1[0]").alias("h1"), "lang", "host", "image_count",
        F.length("text_sample").alias("sample_length"), F.md5("text_sample").alias("sample_digest"),
    )


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(
    "page_addresses",
    f"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,"
    f" regexp_replace(regexp_extract(url, '^[a-z]+://[^?#]*', 0), '/+$', '') AS page_key,"
    f" regexp_replace({_PATH}, '/[0-9]+', '/:id') AS url_pattern, 'other' AS store FROM pages",
)
def page_addresses(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select(
        "page_id",
        F.expr(U.origin_of("url")).alias("origin"),
        F.expr(U.page_key("url")).alias("page_key"),
        F.expr(U.url_pattern("url")).alias("url_pattern"),
        F.expr(U.store_of_url("url")).alias("store"),
    )


_CHAPTER = (
    "(regexp_matches({x}, '第\\s*\\d{{1,4}}\\s*[話话回巻卷集章]') OR"
    " regexp_matches({x}, '(?i)(?:chapter|episode|ep|vol|volume)\\.?\\s*\\d{{1,4}}'))"
)
_GALLERY = " + ".join(
    f"CAST(regexp_matches(info, '{p.replace('(?![A-Za-z0-9_])', '')}') AS INT)"
    for p in [("(?i)" if ic else "") + p for p, ic in classify.GALLERY_SIGNALS]
)
_TOPICS = [f"regexp_matches(topic, '(?i){p}')" for p in classify.TOPIC_SIGNALS]
_HOSTS = " OR ".join(f"contains(host, '{w}')" for w in classify.HOST_WORDS)


@query(
    "page_reasons",
    f"""WITH p AS (SELECT {_TITLE} AS title, {_H1} AS h1, {_SAMPLE} AS body,
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url, {_PATH} AS path FROM pages),
    q AS (SELECT *, body || ' \n ' AS info, title || ' ' || h1 AS topic,
      regexp_matches(url, '(?i){classify.DETAIL_URL}') AS detail FROM p),
    s AS (SELECT *, {_CHAPTER.format(x="title")} OR {_CHAPTER.format(x="h1")} OR {_CHAPTER.format(x="body")} OR ({_GALLERY}) >= 2 AS strong,
      ({_HOSTS}) AS hinted, {" + ".join(f"CAST({t} AS INT)" for t in _TOPICS)} AS topics FROM q)
    SELECT CASE WHEN regexp_matches(url, '(?i)/search\\?') THEN 'denylisted-url'
      WHEN regexp_replace(path, '/+$', '') IN ('', '/index.html') THEN 'site-root'
      WHEN strong THEN 'strong-signal' WHEN hinted AND detail THEN 'manga-host-detail-url'
      WHEN topics >= 2 THEN 'multiple-meta-signals' ELSE 'no-comic-signal' END AS reason,
      CAST(count(*) AS BIGINT) AS pages, CAST(sum(topics) AS BIGINT) AS topic_signals FROM s GROUP BY 1""",
)
def page_reasons(spark, sf_dir):
    judged = classify.classify_pages(T.page_info(spark, sf_dir))
    topics = F.expr("size(filter(signals, s -> startswith(s, 'meta:')))")
    return judged.groupBy("reason").agg(
        F.count("*").alias("pages"), F.sum(topics).cast("bigint").alias("topic_signals")
    )


@query(
    "hosts_not_denied",
    "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CAST(count(*) AS BIGINT) AS pages FROM pages"
    " WHERE NOT regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '(^|\\.)("
    + "|".join(h.replace(".", "\\.") for h in classify.DENIED_HOSTS)
    + ")$') GROUP BY 1",
)
def hosts_not_denied(spark, sf_dir):
    hosts = T.table(spark, sf_dir, "pages").select(F.expr(U.host_of("url")).alias("host"))
    return classify.off_denied_hosts(hosts).groupBy("host").agg(F.count("*").alias("pages"))


_MARKER = (
    "(regexp_matches({x}, '第\\s*\\d{{1,4}}\\s*[話话回巻卷集章]') OR"
    " regexp_matches({x}, '(?i)(?:chapter|episode|vol|volume)\\.?\\s*\\d{{1,4}}'))"
)
_FEATURES = f"""p AS (SELECT page_id, url, {_TITLE} AS title, {_H1} AS h1, {_SAMPLE} AS body, {_PATH} AS path FROM pages),
    f AS (SELECT page_id, h1 <> '' AS has_h1, {_MARKER.format(x="title")} OR {_MARKER.format(x="body")} AS chapter,
      {_MARKER.format(x="title")} OR {_MARKER.format(x="body")} OR {_MARKER.format(x="h1")} AS any_chapter,
      CASE WHEN regexp_matches(path, '(?i)(?:^|/)(?:posts?|blog|articles?|news|diary)/') THEN 'article' ELSE 'listing' END AS page_type,
      CASE WHEN regexp_matches(title, '[A-Za-z]') THEN 'latin' ELSE 'none' END AS lang_family,
      CASE WHEN length(title) = 0 THEN 'none' WHEN length(title) < 12 THEN 'short' WHEN length(title) < 30 THEN 'medium' ELSE 'long' END AS title_bucket
      FROM p)"""


def _features(spark, sf_dir):
    return fingerprint.page_features(T.page_info(spark, sf_dir).drop("signals"))


@query(
    "fingerprint_histogram",
    f"""WITH {_FEATURES} SELECT CASE page_type WHEN 'article' THEN 'A' ELSE 'L' END || CASE WHEN has_h1 THEN '-H1' ELSE '-NH1' END
      || '-NOG-NJ-IMG0-NOINFO-STATIC' AS fingerprint,
      CASE WHEN chapter THEN page_type || '-chapter' WHEN NOT has_h1 THEN 'meta-poor' ELSE 'static-' || page_type END AS category,
      CAST(count(*) AS BIGINT) AS pages, min(page_id) AS first_page FROM f GROUP BY 1, 2""",
)
def fingerprint_histogram(spark, sf_dir):
    return (
        _features(spark, sf_dir)
        .groupBy("fingerprint", "category")
        .agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
    )


@query(
    "page_novelty",
    f"""WITH {_FEATURES},
    s AS (SELECT page_type, has_h1, chapter, lang_family, title_bucket, min(page_id) AS first_id FROM f GROUP BY ALL),
    n AS (SELECT a.first_id, max(3.0 * CAST(a.page_type = b.page_type AS INT) + 2 + 2 + 2 + 1.5 + 1.5 * CAST(a.has_h1 = b.has_h1 AS INT) + 1
        + 1.0 * CAST(a.chapter = b.chapter AS INT) + 0.5 * CAST(a.lang_family = b.lang_family AS INT)
        + 0.5 * CAST(a.title_bucket = b.title_bucket AS INT)) / 15.0 AS sim
      FROM s a LEFT JOIN s b ON b.first_id < a.first_id GROUP BY 1),
    r AS (SELECT f.page_id, CASE WHEN n.first_id IS NULL THEN 1.0 ELSE coalesce(n.sim, 0) END AS sim
      FROM f LEFT JOIN n ON n.first_id = f.page_id),
    t AS (SELECT page_id, sim, CAST(floor((1 - CAST(sim AS DOUBLE)) * 100 + 0.5) AS INT) AS score FROM r)
    SELECT page_id, score, round(CAST(sim AS DOUBLE), 3) AS max_similarity, CASE WHEN score <= 20 THEN 'duplicate' WHEN score <= 50 THEN 'minor-new'
      WHEN score <= 80 THEN 'clearly-new' ELSE 'new-type' END AS verdict FROM t""",
)
def page_novelty(spark, sf_dir):
    scored = fingerprint.novelty(_features(spark, sf_dir).withColumn("capture_no", F.col("page_id")))
    return scored.select("page_id", "novelty.score", "novelty.max_similarity", "novelty.verdict")


# --- titles -----------------------------------------------------------------------------


@query("clean_titles")
def clean_titles(spark, sf_dir):
    # of the page summary only these columns are read, so the others are never made
    pages = extract_pages(T.pages(spark, sf_dir)).select("page_id", "host", F.col("title").alias("raw"))
    return clean.clean_titles(pages).select(
        "page_id", "clean.cleaned", "clean.confidence", F.array_join("clean.notes", ",").alias("notes"), "clean.chapter_hint"
    )


@query("title_sources_ranked")
def title_sources_ranked(spark, sf_dir):
    ranked = clean.title_sources(T.page_info(spark, sf_dir))
    return ranked.select("page_id", F.posexplode("sources").alias("rank", "s")).select(
        "page_id", "rank", "s.source", "s.cleaned", "s.confidence", F.round("s.score", 6).alias("score")
    )


@query("query_variants")
def query_variants(spark, sf_dir):
    pages = T.work_pages(spark, sf_dir)
    return pages.select("page_id", F.posexplode("queries").alias("pos", "query"))


@query("page_artists")
def page_artists(spark, sf_dir):
    return clean.work_titles(T.page_info(spark, sf_dir)).select("page_id", F.array_join("artists", ",").alias("artists"))


_FNV = (
    "lpad(lower(printf('%x', list_reduce(list_transform(string_split(head, ''), lambda c: CAST(unicode(c) AS BIGINT)),"
    " lambda h, u: (xor(h, u) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)))), 8, '0')"
)


@query(
    "headline_scalars",
    f"""WITH d AS (SELECT doc_id, {_HEAD} AS head FROM documents)
    SELECT doc_id, {_sql_match_form("head")} AS match_form, {_sql_store_form("head")} AS store_form,
      CAST(length(regexp_replace(head, '[\\s\\p{{P}}\\p{{S}}]', '', 'g')) AS INT) AS meaningful,
      CASE WHEN regexp_matches(head, '[A-Za-z]') AND regexp_matches(head, '[0-9]') THEN 'latin+digit' WHEN regexp_matches(head, '[A-Za-z]') THEN 'latin'
        WHEN regexp_matches(head, '[0-9]') THEN 'digit' ELSE 'none' END AS script,
      CASE WHEN length(head) > 20 THEN left(head, 19) || '…' ELSE head END AS short_text,
      CASE WHEN length(head) = 0 THEN 'none' WHEN length(head) < 12 THEN 'short' WHEN length(head) < 30 THEN 'medium' ELSE 'long' END AS bucket,
      {_FNV} AS fnv FROM d WHERE head <> ''""",
)
def headline_scalars(spark, sf_dir):
    head = (
        T.table(spark, sf_dir, "documents")
        .select("doc_id", F.expr("trim(split(text, '\n')[0])").alias("head"))
        .where("head <> ''")
        .withColumn("_n", X.nfkc("head"))
    )
    return head.select(
        "doc_id",
        F.expr(X.match_form("_n")).alias("match_form"),
        F.expr(X.store_form("_n")).alias("store_form"),
        F.expr(X.meaningful_length("head")).alias("meaningful"),
        F.expr(X.script_of("head")).alias("script"),
        F.expr(X.truncate("head", 20)).alias("short_text"),
        F.expr(fingerprint.title_bucket("head")).alias("bucket"),
        F.expr(X.short_hash("head")).alias("fnv"),
    )


@query(
    "store_search_urls",
    f"""WITH d AS (SELECT doc_id, {_STORE} AS store, {_HEAD} AS head FROM documents),
    e AS (SELECT doc_id, store, replace(replace(replace(replace(replace(url_encode(head), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS q
      FROM d WHERE head <> '')
    SELECT doc_id, store, CASE store WHEN 'dlsite' THEN 'https://www.dlsite.com/books/fsr/=/language/jp/keyword/' || replace(q, '%20', '+') || '/'
      WHEN 'fanza' THEN 'https://www.dmm.co.jp/search/=/searchstr=' || q || '/'
      WHEN 'melonbooks' THEN 'https://www.melonbooks.co.jp/search/search.php?name=' || q || '&adult_check_flg=1'
      WHEN 'pixiv' THEN 'https://www.pixiv.net/search.php?word=' || q || '&order=date_d&s_mode=s_tag'
      ELSE 'https://fantia.jp/posts?brand_type=0&keyword=' || q || '{U.SEARCH_URLS["fantia", "search"].split("{q}")[1]}' END AS url FROM e""",
)
def store_search_urls(spark, sf_dir):
    return T.catalogue(spark, sf_dir).select(
        F.col("item_id").alias("doc_id"), "store", F.expr(U.reader_search_url("store", "title")).alias("url")
    )


# --- search and matching --------------------------------------------------------------------

_TOKENS = """q0 AS (SELECT DISTINCT {qform} AS query FROM pages),
    q AS (SELECT query, list_distinct(list_filter(string_split(lower(query), ' '), lambda w: w <> '')) AS qt FROM q0 WHERE query <> ''),
    i AS (SELECT doc_id AS item_id, {store} AS store, {step} AS step_id, {head} AS title FROM documents),
    it AS (SELECT item_id, store, step_id, title, list_distinct(list_filter(string_split(lower({iform}), ' '), lambda w: w <> '')) AS tokens FROM i WHERE title <> ''),
    qx AS (SELECT query, len(qt) AS n, unnest(qt) AS token FROM q), ix AS (SELECT item_id, store, step_id, title, unnest(tokens) AS token FROM it),
    hit AS (SELECT query, item_id, store, step_id, any_value(title) AS title, count(*) AS shared FROM qx JOIN ix USING (token) GROUP BY query, n, item_id, store, step_id
      HAVING count(*) >= ceil(n * 0.7)),
    found AS (SELECT *, row_number() OVER (PARTITION BY query, store, step_id ORDER BY shared DESC, item_id) - 1 AS pos FROM hit)""".format(
    qform=_sql_store_form(_TITLE), store=_STORE, step=_STEP, head=_HEAD, iform=_sql_store_form("title")
)


def _hits(spark, sf_dir):
    titles = T.page_info(spark, sf_dir).select("title").distinct().withColumn("_n", X.nfkc("title"))
    asked = titles.select(F.expr(X.store_form("_n")).alias("query")).where("query <> ''")
    return search_titles(asked, T.catalogue(spark, sf_dir))


def _compared(hits):
    """``found(_q, _i)`` with the comparison forms ``a`` and ``b``, made once a query and once a title."""
    asked = stage(hits.queries.withColumn("_n", X.nfkc("query")).select("_q", "query", F.expr(X.match_form("_n")).alias("a")))
    heads = stage(hits.titles.select("_i", F.expr(X.match_form("nfkc")).alias("b")))
    live = hits.found.join(asked.where("a <> ''").hint("merge"), "_q")
    return live.join(heads.where("b <> ''").hint("merge"), "_i")


@query(
    "catalogue_search",
    f"WITH {_TOKENS} SELECT query, item_id, store, step_id, CAST(shared AS INT) AS shared, CAST(pos AS INT) AS pos FROM found",
)
def catalogue_search(spark, sf_dir):
    return answers(_hits(spark, sf_dir)).select("query", "item_id", "store", "step_id", "shared", "pos")


def _lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence with 128-bit row vectors."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = (
        f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c"
        " THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END))"
    )
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST({mask} AS HUGEINT))"
    step = f"((v + (v & m)) | (v - (v & m))) & {full}"
    return f"length({a}) - bit_count(list_reduce({masks}, lambda v, m: {step}, {full}))"


_PAIRS = f"""{_TOKENS}, pairs AS (SELECT query, item_id, {_sql_match_form("query")} AS a, {_sql_match_form("title")} AS b FROM found),
    live AS (SELECT * FROM pairs WHERE a <> '' AND b <> '')"""
_GRAMS = "CASE WHEN length({x}) = 1 THEN [{x}] ELSE list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)) END"
_CONTAIN = """CASE WHEN contains(a, b) OR contains(b, a) THEN CASE WHEN r >= 0.9 THEN 90 WHEN r >= 0.75 THEN 80 WHEN r >= 0.55 THEN 70 WHEN r >= 0.4 THEN 55 ELSE 42 END ELSE 0 END"""


@query(
    "match_scores",
    f"""WITH {_PAIRS}, u AS (SELECT DISTINCT a, b FROM live),
    ga AS (SELECT a, b, unnest({_GRAMS.format(x="a")}) AS g FROM u), gb AS (SELECT a, b, unnest({_GRAMS.format(x="b")}) AS g FROM u),
    ca AS (SELECT a, b, g, count(*) AS n FROM ga GROUP BY ALL), cb AS (SELECT a, b, g, count(*) AS n FROM gb GROUP BY ALL),
    sh AS (SELECT a, b, sum(least(ca.n, cb.n)) AS shared FROM ca JOIN cb USING (a, b, g) GROUP BY a, b),
    m AS (SELECT u.a, u.b, CAST(floor(200.0 * CAST(coalesce(shared, 0) AS DOUBLE) / (greatest(length(u.a) - 1, 1) + greatest(length(u.b) - 1, 1)) + 0.5) AS INT) AS dice,
      CAST(floor(100.0 * CAST({_lcs_sql("u.a", "u.b")} AS DOUBLE) / greatest(length(u.a), length(u.b)) + 0.5) AS INT) AS lcs,
      CAST(least(length(u.a), length(u.b)) AS DOUBLE) / greatest(length(u.a), length(u.b)) AS r FROM u LEFT JOIN sh ON u.a = sh.a AND u.b = sh.b),
    c AS (SELECT *, {_CONTAIN} AS cont FROM m),
    s AS (SELECT a, b, CASE WHEN a = b THEN 100 ELSE greatest(cont, dice, lcs) END AS score, CASE WHEN a = b THEN 'exact'
      WHEN greatest(cont, dice, lcs) = cont THEN 'containment' WHEN greatest(dice, lcs) = lcs AND lcs > dice THEN 'lcs' ELSE 'dice' END AS method FROM c)
    SELECT query, item_id, CAST(score AS INT) AS score, method, CASE WHEN score >= 90 THEN '很高' WHEN score >= 85 THEN '较高' WHEN score >= 70 THEN '一般' ELSE '较低' END AS label
    FROM live JOIN s USING (a, b)""",
)
def match_scores(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    # a title is scored once a query, where its form is, and becomes items after that
    scored = score_pairs(_compared(hits)).select("_i", "query", F.col("score").cast("int").alias("score"), "method")
    return scored.join(hits.items.select("_i", "item_id").hint("merge"), "_i").select(
        "query", "item_id", "score", "method", F.expr(match_label("score")).alias("label")
    )


_FLOOR = 62
_SIMILAR = f"""WITH x AS (SELECT DISTINCT {_sql_match_form(_sql_store_form(_TITLE))} AS a FROM pages), y AS (SELECT DISTINCT {_sql_match_form(_HEAD)} AS b FROM documents),
    u AS (SELECT a, b FROM x JOIN y ON a <> '' AND b <> '' AND length(a) * 9 >= length(b) * 4 AND length(b) * 9 >= length(a) * 4),
    ga AS (SELECT a, unnest({_GRAMS.format(x="a")}) AS g FROM x WHERE a <> ''), gb AS (SELECT b, unnest({_GRAMS.format(x="b")}) AS g FROM y WHERE b <> '' AND length(b) * 4 <= (SELECT max(length(a)) * 9 FROM x)),
    ca AS (SELECT a, g, count(*) AS n FROM ga GROUP BY ALL), cb AS (SELECT b, g, count(*) AS n FROM gb GROUP BY ALL),
    sh AS (SELECT a, b, sum(least(ca.n, cb.n)) AS shared FROM ca JOIN cb USING (g) GROUP BY a, b),
    m AS (SELECT u.a, u.b, CAST(floor(200.0 * CAST(coalesce(shared, 0) AS DOUBLE) / (greatest(length(u.a) - 1, 1) + greatest(length(u.b) - 1, 1)) + 0.5) AS INT) AS dice,
      CAST(floor(100.0 * CAST(CASE WHEN length(u.a) * 1000 < length(u.b) * 615 OR length(u.b) * 1000 < length(u.a) * 615 THEN 0 ELSE {_lcs_sql("u.a", "u.b")} END AS DOUBLE) / greatest(length(u.a), length(u.b)) + 0.5) AS INT) AS lcs,
      CAST(least(length(u.a), length(u.b)) AS DOUBLE) / greatest(length(u.a), length(u.b)) AS r FROM u LEFT JOIN sh ON u.a = sh.a AND u.b = sh.b),
    c AS (SELECT *, {_CONTAIN} AS cont FROM m),
    s AS (SELECT a, b, CASE WHEN a = b THEN 100 ELSE greatest(cont, dice, lcs) END AS score, CASE WHEN a = b THEN 'exact'
      WHEN greatest(cont, dice, lcs) = cont THEN 'containment' WHEN greatest(dice, lcs) = lcs AND lcs > dice THEN 'lcs' ELSE 'dice' END AS method FROM c)
    SELECT a, b, CAST(score AS INT) AS score, method FROM s WHERE score >= {_FLOOR}"""


def _titles(spark, sf_dir):
    titles = T.page_info(spark, sf_dir).select("title").distinct().withColumn("_n", X.nfkc("title"))
    asked = titles.select(F.expr(X.store_form("_n")).alias("q")).withColumn("_n", X.nfkc("q"))
    heads = T.catalogue(spark, sf_dir).select("title").distinct().withColumn("_n", X.nfkc("title"))
    return asked.select(F.expr(X.match_form("_n")).alias("a")), heads.select(F.expr(X.match_form("_n")).alias("b"))


@query("match_indexed", _SIMILAR)
def match_indexed(spark, sf_dir):
    return similar.similar_pairs(*_titles(spark, sf_dir), floor=_FLOOR)


@query("match_exact", _SIMILAR)
def match_exact(spark, sf_dir):
    return similar.all_pairs(*_titles(spark, sf_dir), floor=_FLOOR)


@query(
    "match_ties",
    """WITH n AS (SELECT p_name AS query, count(*) AS c FROM part GROUP BY 1)
    SELECT query, CASE WHEN c > 1 THEN 'high_with_alternatives' ELSE 'high' END AS kind, 100 AS best_score,
      CAST(least(c, 3) AS INT) AS candidates, (SELECT min(p_partkey) FROM part p WHERE p.p_name = n.query) AS best_part FROM n""",
)
def match_ties(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("item_id"), F.lit("dlsite").alias("store"), F.lit("primary").alias("step_id"),
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"),
    )
    found = search_catalogue(part.select(F.col("p_name").alias("query")), items)
    hits = found.join(items.select("item_id", "title"), "item_id").select(
        F.col("query").alias("request_id"), "pos", "title", "item_id", F.array("query").alias("queries"),
        F.lit(None).cast("int").alias("chapter_hint"),
    )
    ranked = match.rank_candidates(hits)
    answers = match.classify_ranked(ranked)
    best = ranked.where("rank = 1").select("request_id", F.col("item_id").alias("best_part"))
    return answers.join(best, "request_id").select(
        F.col("request_id").alias("query"), "kind", F.col("best.score").cast("int").alias("best_score"),
        F.size("candidates").alias("candidates"), "best_part",
    )


@query("page_states")
def page_states(spark, sf_dir):
    return T.page_states(spark, sf_dir).select(
        "page_id", "status", "state_reason", "extraction.cleaned_title", "match.store", "match.product_id", "match.score",
        "match.method", F.size("candidates").alias("candidates"), "requests", "repeat_requests",
    )


@query("store_answers")
def store_answers_by_kind(spark, sf_dir):
    return T.answered(spark, sf_dir).groupBy("store", "kind", "health").agg(
        F.count("*").alias("searches"), F.sum("requests").alias("requests"), F.sum("item_count").alias("items")
    )


@query("page_links")
def page_links(spark, sf_dir):
    states = T.page_states(spark, sf_dir).where("search_links is not null")
    return states.select("page_id", F.posexplode("search_links").alias("pos", "l")).select("page_id", "pos", "l.label", "l.url", "l.found")


@query("capture_records")
def capture_records(spark, sf_dir):
    pages = T.page_info(spark, sf_dir).withColumn("capture_no", F.col("page_id") + 1)
    built = captures.build_captures(pages, T.page_states(spark, sf_dir))
    return built.select(
        "id", "page_key", "fingerprint", "category", F.col("novelty.score").alias("novelty"), "match.grade",
        "extract.work_key", F.expr("results['requestCount']").alias("request_count"),
    )


@query("replay_by_category")
def replay_by_category(spark, sf_dir):
    """Every page as an expectation row of its own category: all are expected to be
    found within the budget of a work page."""
    states = T.page_states(spark, sf_dir)
    info = _features(spark, sf_dir).select("page_id", "features", "fingerprint", "category")
    withf = states.join(info, "page_id")
    cases = info.select(
        F.expr("format_string('RW-%03d', page_id + 1)").alias("id"), "page_id", "features",
        F.expr("named_struct('page_recognition', true, 'store_search', true, 'correct_match', true, 'false_positive', false,"
               " 'grade', 'found', 'cleaned_title', '', 'max_requests', cast(null as int), 'limitation', false)").alias("expected"),
        F.expr(fingerprint.category_dir_of("category", "features")).alias("dir"),
    )
    return replay.replay_summary(replay.replay(cases, withf))


# --- steps, cache, streams' batch twins -----------------------------------------------------------

_EVENT_STEPS = (
    "CASE user_id % 5 WHEN 0 THEN 'dlsite' WHEN 1 THEN 'fanza' WHEN 2 THEN 'melonbooks' WHEN 3 THEN 'pixiv' ELSE 'fantia' END AS store,"
    " CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 403 ELSE 200 END AS http_status,"
    " CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'not-found' WHEN 'click' THEN 'blocked' ELSE 'unexpected-page' END AS reason,"
    " CASE WHEN event_type = 'purchase' THEN 1 + CAST(user_id AS INT) % 3 ELSE 0 END AS item_count"
)
_SQL_HEALTH = """CASE WHEN item_count > 0 THEN 'healthy' WHEN http_status IN (401,403,429,451,503) OR reason = 'blocked' THEN 'blocked'
    WHEN reason = 'not-found' THEN 'no-result' WHEN reason = 'unexpected-page' THEN 'search-failed' WHEN reason = 'ok' THEN 'no-result' ELSE 'search-failed' END"""
_SQL_ROLL = """CAST(count(*) AS BIGINT) AS steps, CAST(sum(item_count) AS BIGINT) AS items,
    CAST(count(*) FILTER (v NOT IN ('no-result', 'healthy')) AS BIGINT) AS failures,
    CASE WHEN sum(item_count) > 0 THEN CASE WHEN count(*) FILTER (v NOT IN ('no-result', 'healthy')) > 0 THEN 'degraded' ELSE 'healthy' END
      ELSE ['no-result', 'parser-broken', 'search-failed', 'blocked'][CAST(max(CASE v WHEN 'blocked' THEN 4 WHEN 'search-failed' THEN 3 WHEN 'parser-broken' THEN 2 ELSE 1 END) AS INT)] END AS health"""


def _steps(spark, sf_dir):
    return T.events(spark, sf_dir).selectExpr("*", *_split_columns(_EVENT_STEPS))


def _split_columns(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(sql):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(sql[start:i])
            start = i + 1
    return [*out, sql[start:]]


@query("health_by_store", f"WITH s AS (SELECT *, {_EVENT_STEPS} FROM events), j AS (SELECT *, {_SQL_HEALTH} AS v FROM s) SELECT store, {_SQL_ROLL} FROM j GROUP BY store")
def health_by_store(spark, sf_dir):
    return health.store_health(_steps(spark, sf_dir), ["store"])


@query(
    "health_windows",
    f"""WITH s AS (SELECT *, {_EVENT_STEPS} FROM events), j AS (SELECT *, {_SQL_HEALTH} AS v FROM s)
    SELECT store, epoch_us(ts) // 600000000 * 600 AS window_start, {_SQL_ROLL} FROM j GROUP BY 1, 2""",
)
def health_windows(spark, sf_dir):
    return state.health_over_time(_steps(spark, sf_dir)).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "requests_per_page",
    f"""WITH s AS (SELECT *, {_EVENT_STEPS} FROM events) SELECT CAST(json_extract(props, '$.k') AS INT) AS page_key, store,
    epoch_us(ts) // 3600000000 * 3600 AS window_start, CAST(count(*) AS BIGINT) AS requests FROM s GROUP BY 1, 2, 3""",
)
def requests_per_page(spark, sf_dir):
    steps = _steps(spark, sf_dir).withColumn("page_key", F.get_json_object("props", "$.k").cast("int"))
    return state.request_counts(steps).withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "ttl_cache_hits",
    """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) % 10 AS k FROM events),
    w AS (SELECT k, ts AS t0, CAST(user_id % 3 AS INT) AS n, event_id FROM e WHERE event_type = 'purchase'),
    l AS (SELECT k, ts, event_id FROM e WHERE event_type <> 'purchase'),
    j AS (SELECT l.event_id, l.k, l.ts, max_by(n, w.t0) AS n, max(w.t0) AS t0 FROM l LEFT JOIN w ON w.k = l.k AND w.t0 <= l.ts AND w.t0 >= l.ts - INTERVAL 31 MINUTE GROUP BY ALL),
    r AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(t0) <= CASE WHEN n > 0 THEN 1800000000 ELSE 300000000 END, false) AS live FROM j)
    SELECT CAST(k AS VARCHAR) AS cache_key, CAST(count(*) AS BIGINT) AS lookups, CAST(count(*) FILTER (live) AS BIGINT) AS entries_found,
      CAST(count(*) FILTER (live AND n > 0) AS BIGINT) AS hits FROM r GROUP BY 1""",
)
def ttl_cache_hits(spark, sf_dir):
    log = T.events(spark, sf_dir).withColumn(
        "cache_key", F.expr("cast(cast(get_json_object(props, '$.k') as int) % 10 as string)")
    )
    writes = log.where("event_type = 'purchase'").selectExpr("cache_key", "ts as at", "cast(user_id % 3 as int) as n_items")
    found = cache.lookup_log(log.where("event_type <> 'purchase'").select("cache_key", "event_id", "ts"), writes)
    return found.groupBy("cache_key").agg(
        F.count("*").alias("lookups"), F.count_if("entry_found").alias("entries_found"), F.count_if("cache_hit").alias("hits")
    )


@query(
    "latest_errors",
    """WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'error') AS et, max(ts) FILTER (event_type = 'purchase') AS ok,
      max_by(event_id, ts) FILTER (event_type = 'error') AS event_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1)
    SELECT user_id, CAST(event_id AS VARCHAR) AS message FROM e WHERE et IS NOT NULL AND (ok IS NULL OR ok < et)""",
)
def latest_errors(spark, sf_dir):
    log = T.events(spark, sf_dir).where("event_type in ('error', 'purchase')").selectExpr(
        "user_id", "ts as at", "event_type = 'purchase' as ok", "cast(event_id as string) as message"
    )
    return quality.latest_errors(log, ["user_id"]).select("user_id", "message")


@query(
    "current_results",
    """WITH e AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS INT) // 20 END AS page,
      CAST(json_extract(props, '$.k') AS INT) // 20 AS k FROM events WHERE event_type IN ('view', 'click')),
    w AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM e)
    SELECT user_id AS tab, CAST(event_id AS VARCHAR) AS payload FROM w WHERE event_type = 'click' AND (now IS NULL OR now = k)""",
)
def current_results(spark, sf_dir):
    events = T.events(spark, sf_dir).where("event_type in ('view', 'click')").selectExpr(
        "user_id as tab", "concat('http://p/', cast(cast(get_json_object(props, '$.k') as int) div 20 as string)) as url",
        "if(event_type = 'view', 'url', 'result') as kind", "cast(event_id as string) as payload", "ts",
    )
    return gates.current_results(events).select("tab", "payload")


@query(
    "settled_pages",
    """WITH e AS (SELECT user_id AS tab, epoch_us(ts) // 1000 AS ms, event_type = 'view' AS is_url, CAST(json_extract(props, '$.k') AS INT) AS k,
      CASE WHEN event_type <> 'view' THEN event_id END AS sig FROM events),
    p AS (SELECT *, last_value(CASE WHEN is_url THEN k END IGNORE NULLS) OVER (PARTITION BY tab ORDER BY ms, is_url DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
    m AS (SELECT *, is_url AND (prev IS NULL OR prev <> k) AS nav FROM p),
    n AS (SELECT *, sum(CAST(nav AS INT)) OVER (PARTITION BY tab ORDER BY ms, is_url DESC ROWS UNBOUNDED PRECEDING) AS n,
      last_value(sig IGNORE NULLS) OVER (PARTITION BY tab ORDER BY ms, is_url DESC ROWS UNBOUNDED PRECEDING) AS shown FROM m),
    f AS (SELECT * FROM n WHERE n > 0 AND (nav OR NOT is_url)),
    g AS (SELECT *, min(CASE WHEN nav THEN ms END) OVER w AS st, max(CASE WHEN nav THEN k END) OVER w AS page, coalesce(max(CASE WHEN nav THEN shown END) OVER w, -1) AS old,
      lead(ms) OVER (PARTITION BY tab, n ORDER BY ms, nav DESC) AS nxt FROM f WINDOW w AS (PARTITION BY tab, n)),
    h AS (SELECT *, (nxt IS NULL OR nxt > ms + 400) AND shown IS NOT NULL AND shown <> old AND ms + 400 <= st + 5000 AS calm FROM g),
    r AS (SELECT tab, n, any_value(page) AS page, any_value(st) AS st, min(CASE WHEN calm THEN ms + 400 END) AS calm_at,
      min_by(shown, CASE WHEN calm THEN ms END) AS calm_sig, max_by(shown, CASE WHEN ms <= st + 5000 THEN ms END) AS limit_sig FROM h GROUP BY tab, n),
    x AS (SELECT *, lead(st) OVER (PARTITION BY tab ORDER BY n) AS nav_end, coalesce(calm_at, st + 5000) AS settled FROM r)
    SELECT tab, 'http://p/' || page AS url, coalesce(CAST(CASE WHEN calm_at IS NULL THEN limit_sig ELSE calm_sig END AS VARCHAR), '') AS signature,
      settled AS settled_ms, CASE WHEN calm_at IS NULL THEN 'deadline' ELSE 'settled' END AS reason FROM x WHERE nav_end IS NULL OR settled < nav_end""",
)
def settled_pages(spark, sf_dir):
    snaps = T.events(spark, sf_dir).selectExpr(
        "user_id as tab", "concat('http://p/', get_json_object(props, '$.k')) as url", "cast(event_id as string) as signature",
        "if(event_type = 'view', 'url', 'mutation') as kind", "ts",
    )
    return gates.settled_pages(snaps).select("tab", "url", "signature", F.unix_millis(F.col("settled_at")).alias("settled_ms"), "reason")


@query(
    "price_estimates",
    "SELECT p_partkey, greatest(1, CAST(floor(floor(p_retailprice) * CAST(0.044 AS DOUBLE) + 0.5) AS INT)) AS cny FROM part",
)
def price_estimates(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(estimate_cny("cast(p_retailprice as int)", str(resolve_rate(DEFAULTS)))).alias("cny")
    )


# --- quality log over events -----------------------------------------------------------------


def _event_captures(spark, sf_dir) -> DataFrame:
    """Every event as one observation of the page (user, k / 10)."""
    e = T.events(spark, sf_dir).withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "captured_at": F.col("ts"),
            "capture_no": F.col("event_id") + 1,
        }
    )
    total = "cast(k % 11 as int)"
    store = "element_at(array('dlsite', 'fanza', 'melonbooks', 'pixiv', 'fantia'), cast(user_id % 5 as int) + 1)"
    grade = "case event_type when 'purchase' then 'found' when 'view' then 'possible' when 'signup' then 'none' when 'click' then 'error' else 'unrecognized' end"
    results = "map(" + ", ".join(
        f"'{f}', " + {
            "pageRecognition": "if(event_type = 'error', 'FAIL', 'PASS')",
            "requestCount": f"if({total} <= if(event_type = 'error', 0, 8), 'PASS', 'FAIL')",
            "storeSearch": "if(event_type = 'click', 'FAIL', 'PASS')",
        }.get(f, "'NOT_TESTED'")
        for f in captures.RESULT_FIELDS
    ) + ")"
    return e.selectExpr(
        "concat(user_id, '/', k div 10) as page_key", "capture_no", "captured_at", "format_string('QA-%04d', capture_no) as id",
        "concat('http://u', user_id) as origin", "'/' as url_pattern", "concat('http://u', user_id, '/', k div 10) as url",
        f"named_struct('score', cast(k as int), 'max_similarity', 0D, 'verdict', {fingerprint.novelty_verdict('k')}) as novelty",
        "concat('G-', event_type) as fingerprint", "if(event_type = 'view', 'gallery', 'unknown') as page_type", "event_type as category",
        "named_struct('recognized', event_type <> 'error') as extract",
        f"named_struct('grade', {grade}, 'score', cast(k as int), 'store_id', {store}, 'product_key', '', 'product_title', '',"
        " 'candidate_count', 0, 'false_positive', if(k % 7 = 0, k % 14 = 0, null)) as match",
        f"named_struct('analyses', 1, 'total', {total}, 'by_store', map({store}, {total}), 'cache_hit', k % 10 = 3, 'cache_entry_found', false,"
        f" 'observations', array(named_struct('at', captured_at, 'analysis', 1, 'requests', {total}, 'cache_hit', k % 10 = 3))) as requests",
        f"{results} as results", "if(k % 9 = 0, 'PASS', if(k % 9 = 1, 'FAIL', if(k % 9 = 2, 'EXPECTED_LIMITATION', 'NOT_TESTED'))) as verdict", "'' as note",
    )


_CAP = """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
    c AS (SELECT *, k % 11 AS total, ['dlsite','fanza','melonbooks','pixiv','fantia'][CAST(user_id % 5 AS INT) + 1] AS store, event_type <> 'error' AS recognized,
      event_type IN ('purchase', 'view') AS claimed, CASE WHEN k % 7 = 0 THEN k % 14 = 0 END AS fp, k % 11 > CASE WHEN event_type = 'error' THEN 0 ELSE 8 END AS over,
      k % 10 = 3 AS hit FROM e),
    d AS (SELECT *, coalesce(fp, false) OR k % 9 = 1 OR CASE WHEN recognized THEN event_type = 'click' OR over ELSE over END AS failed FROM c)"""


_MERGED = f"""{_CAP}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k // 10 ORDER BY event_id DESC) AS n FROM d)
    SELECT user_id || '/' || (k // 10) AS page_key, printf('QA-%04d', min(event_id) + 1) AS id, CAST(min_by(k, event_id) AS INT) AS novelty,
      CAST(count(*) AS BIGINT) AS visits, CAST(count(*) FILTER (n <= 6) AS INT) AS analyses, CAST(max_by(total, event_id) AS INT) AS requests,
      CASE WHEN count(*) > 1 AND count(*) FILTER (hit) > 0 THEN 'PASS' ELSE 'NOT_TESTED' END AS cache_behavior,
      min_by(CASE WHEN k % 9 = 0 THEN 'PASS' WHEN k % 9 = 1 THEN 'FAIL' WHEN k % 9 = 2 THEN 'EXPECTED_LIMITATION' ELSE 'NOT_TESTED' END, event_id) AS verdict,
      CASE WHEN min_by(k % 7, event_id) = 0 THEN min_by(k % 14, event_id) = 0 END AS false_positive,
      min_by(CASE WHEN event_type = 'click' THEN 'FAIL' ELSE 'PASS' END, event_id) AS store_search FROM r GROUP BY user_id, k // 10"""


def _merged(records):
    return records.selectExpr(
        "page_key", "id", "novelty.score as novelty", "visits", "requests.analyses as analyses", "requests.total as requests",
        "results['cacheBehavior'] as cache_behavior", "results['storeSearch'] as store_search", "verdict", "match.false_positive as false_positive",
    )


@query("capture_merge", _MERGED)
def capture_merge(spark, sf_dir):
    return _merged(captures.merge_captures(_event_captures(spark, sf_dir)))


@query("capture_merge_batches", _MERGED)
def capture_merge_batches(spark, sf_dir):
    """The same log in five batches through the stream's sink; one batch is delivered twice."""
    table = f"{checkpoint_dir(spark)}/captures-{uuid.uuid4().hex}"
    log, add = stage(_event_captures(spark, sf_dir)), sink.capture_sink(table, fan=2)
    for batch in (0, 1, 1, 2, 3, 4):
        add(log.where(F.pmod("capture_no", F.lit(5)) == batch), batch)
    drop_stage(log)
    return _merged(sink.read_captures(spark, table))


@query(
    "quality_summary",
    f"""{_CAP} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (k % 9 = 0) AS BIGINT) AS pass, CAST(count(*) FILTER (k % 9 = 1) AS BIGINT) AS fail,
      CAST(count(*) FILTER (k % 9 = 2) AS BIGINT) AS expected_limitation, CAST(count(*) FILTER (k % 9 > 2) AS BIGINT) AS not_tested,
      CAST(count(*) FILTER (fp) AS BIGINT) AS false_positive, round(count(*) FILTER (recognized) / count(*), 3) AS page_recognition_rate,
      round(count(*) FILTER (fp = false AND claimed) / count(*) FILTER (fp IS NOT NULL), 3) AS match_precision,
      CAST(count(*) FILTER (k > 20) AS BIGINT) AS new_structures, CAST(sum(total) AS BIGINT) AS requests, round(sum(total) / count(*), 2) AS requests_per_capture,
      CAST(count(*) FILTER (total = 0) AS BIGINT) AS zero_request_captures, CAST(count(*) FILTER (hit) AS BIGINT) AS cache_hit_captures,
      CAST(count(*) FILTER (over) AS BIGINT) AS over_budget FROM d""",
)
def quality_summary(spark, sf_dir):
    return quality.summary(_event_captures(spark, sf_dir)).select(
        "total", "pass", "fail", "expected_limitation", "not_tested", "false_positive", "page_recognition_rate", "match_precision",
        "new_structures", "requests", "requests_per_capture", "zero_request_captures", "cache_hit_captures", "over_budget",
    )


@query("requests_by_store", f"{_CAP} SELECT store, CAST(sum(total) AS BIGINT) AS requests FROM d GROUP BY store")
def requests_by_store(spark, sf_dir):
    return quality.requests_by_store(_event_captures(spark, sf_dir))


@query(
    "structure_report",
    f"{_CAP} SELECT 'G-' || event_type AS fingerprint, CAST(count(*) AS BIGINT) AS count, CAST(epoch_us(min(ts)) AS BIGINT) AS first_seen FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24",
)
def structure_report(spark, sf_dir):
    return quality.structures(_event_captures(spark, sf_dir)).selectExpr("fingerprint", "count", "unix_micros(first_seen) as first_seen")


@query(
    "failure_breakdown",
    f"""{_CAP}, f AS (SELECT unnest(list_filter(['(all)', CASE WHEN coalesce(fp, false) THEN '(falsePositive)' END, CASE WHEN NOT recognized THEN 'pageRecognition' END,
      CASE WHEN event_type = 'click' THEN 'storeSearch' END, CASE WHEN over THEN 'requestCount' END], lambda x: x IS NOT NULL)) AS field FROM d WHERE failed)
    SELECT field, CAST(count(*) AS BIGINT) AS failures FROM f GROUP BY 1""",
)
def failure_breakdown(spark, sf_dir):
    return quality.failure_breakdown(_event_captures(spark, sf_dir))


@query(
    "failure_index",
    f"""{_CAP} SELECT printf('FAIL-%03d', event_id + 1) AS id, array_to_string(list_filter([CASE WHEN NOT recognized THEN 'pageRecognition' END,
      CASE WHEN event_type = 'click' THEN 'storeSearch' END, CASE WHEN over THEN 'requestCount' END], lambda x: x IS NOT NULL), ',') AS failed_fields,
      coalesce(fp, false) AS false_positive, CAST(total AS INT) AS requests FROM d WHERE failed""",
)
def failure_index(spark, sf_dir):
    return quality.compact_failures(_event_captures(spark, sf_dir)).select(
        "id", F.array_join("failed_fields", ",").alias("failed_fields"), "false_positive", "requests"
    )


@query(
    "case_numbers",
    f"{_CAP} SELECT printf('RW-%03d', row_number() OVER (ORDER BY event_id)) AS id, printf('QA-%04d', event_id + 1) AS capture_id,"
    " event_type = 'purchase' AND NOT coalesce(fp, false) AS correct_match FROM d WHERE failed",
)
def case_numbers(spark, sf_dir):
    failed = _event_captures(spark, sf_dir).where(captures.is_failure())
    features = F.expr(
        "named_struct('page_type', page_type, 'h1', true, 'og_title', false, 'json_ld', false, 'gallery_info', false,"
        " 'many_images', false, 'spa_navigation', false)"
    )
    return captures.create_cases(failed.withColumn("features", features)).select("id", "capture_id", "expected.correct_match")


@query(
    "judged_captures",
    f"""{_CAP}, l AS (SELECT (doc_id % 150) || '/' || (doc_id % 10) AS page_key, max_by(CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END, doc_id) AS v,
      max_by(toxic = 1, doc_id) AS t FROM labels GROUP BY 1),
    j AS (SELECT d.*, l.v, l.t, coalesce(l.t, d.fp) AS f2 FROM d LEFT JOIN l ON l.page_key = d.user_id || '/' || (d.k // 10)),
    x AS (SELECT CASE WHEN f2 THEN 'FAIL' WHEN v IS NOT NULL THEN v ELSE CASE k % 9 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'EXPECTED_LIMITATION' ELSE 'NOT_TESTED' END END AS verdict, f2 FROM j)
    SELECT verdict, CAST(count(*) AS BIGINT) AS captures, CAST(count(*) FILTER (f2) AS BIGINT) AS false_positives FROM x GROUP BY 1""",
)
def judged_captures(spark, sf_dir):
    judgements = T.table(spark, sf_dir, "labels").selectExpr(
        "concat(doc_id % 150, '/', doc_id % 10) as page_key", "timestamp_seconds(doc_id) as at", "if(quality = 1, 'PASS', 'FAIL') as verdict",
        "toxic = 1 as false_positive", "cast(null as string) as note",
    )
    judged = captures.apply_judgements(_event_captures(spark, sf_dir), judgements)
    return judged.groupBy("verdict").agg(
        F.count("*").alias("captures"), F.count_if("match.false_positive").alias("false_positives")
    )


@query(
    "export_names",
    """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)
    SELECT event_id, printf('%s-%s-%03d.json', CASE event_type WHEN 'view' THEN 'qa-summary' WHEN 'error' THEN 'qa-failures' ELSE 'qa-tests' END, day,
      row_number() OVER (PARTITION BY day ORDER BY ts, event_id)) AS file_name FROM e""",
)
def export_names(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").selectExpr(
        "event_id", "case event_type when 'view' then 'summary' when 'error' then 'failures' else 'tests' end as kind", "ts as at"
    )
    return reports.export_names(e).select("event_id", "file_name")


@query(
    "redaction_dictionary",
    f"""WITH d AS (SELECT {_HEAD} AS value, min(doc_id) AS seen FROM documents GROUP BY 1)
    SELECT value, '<title-' || row_number() OVER (ORDER BY seen) || '>' AS label, CAST(length(value) AS INT) AS length FROM d WHERE value <> ''""",
)
def redaction_dictionary(spark, sf_dir):
    values = T.catalogue(spark, sf_dir).select(F.col("title").alias("value"), F.col("item_id").alias("seen"))
    return redact.redaction_dictionary(values).select("value", "label", "length")


@query(
    "url_dictionary",
    f"""WITH d AS (SELECT url AS value, min(page_id) AS seen FROM pages GROUP BY 1)
    SELECT value, '<url-' || row_number() OVER (ORDER BY seen) || '>' AS label, regexp_extract(value, '^[a-z]+://([^/?#]*)', 1) AS host,
      regexp_replace({_PATH.replace("(url", "(value")}, '/[0-9]+(/|$)', '/:id\\1') AS path FROM d""",
)
def url_dictionary(spark, sf_dir):
    values = T.table(spark, sf_dir, "pages").select(F.col("url").alias("value"), F.col("page_id").alias("seen"))
    return redact.redaction_dictionary(values, "url").select("value", "label", "host", "path")


@query(
    "identifier_scan",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    n AS (SELECT DISTINCT text AS entry FROM benchmark),
    den AS (SELECT doc_id, line, instr(lower(content), lower(entry)) AS col, 'denylisted' AS kind, entry AS match FROM l JOIN n ON contains(lower(content), lower(entry))),
    pid AS (SELECT doc_id, line, 'product-id' AS kind, unnest(regexp_extract_all(content, '\\b(?:RJ|BJ)[0-9]{6,}\\b|\\bd_[0-9]{5,}\\b')) AS match FROM l),
    gal AS (SELECT doc_id, line, 'gallery-id' AS kind, unnest(regexp_extract_all(content, '/g/[0-9]{4,}')) AS match FROM l)
    SELECT doc_id, CAST(line AS INT) AS line, kind, match FROM (SELECT doc_id, line, kind, match FROM den UNION ALL SELECT * FROM pid UNION ALL SELECT * FROM gal)""",
)
def identifier_scan(spark, sf_dir):
    deny = T.table(spark, sf_dir, "benchmark").select(F.col("text").alias("entry"))
    found = identifiers.scan(T.table(spark, sf_dir, "documents").select("doc_id", "text"), deny=deny)
    return found.select("doc_id", "line", "kind", "match")


@query(
    "containment_bands",
    f"""WITH {_PAIRS}, b AS (SELECT a, b, CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) AS r FROM live)
    SELECT CAST({_CONTAIN} AS INT) AS score, CAST(count(*) AS BIGINT) AS pairs FROM b GROUP BY 1""",
)
def containment_bands(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    held = hits.items.groupBy("_i").agg(F.count("*").alias("items"))
    scored = _compared(hits).select("_i", F.expr(containment("a", "b")).alias("score"))
    return scored.join(held.hint("merge"), "_i").groupBy("score").agg(F.sum("items").alias("pairs"))


# --- captured store responses ----------------------------------------------------------------
# Bodies are written from the columns of ``part`` by one template per store and outcome, parsed
# back, and compared with the columns: key mod 5 picks the store, key div 5 mod 4 the outcome.

_PAD = "concat('<!-- ', repeat('x', 3200), ' -->')"
_PRICE = "format_number(p_size * 1000 + 100, 0)"
_BODY = {
    "dlsite": (
        f"""concat({_PAD}, '<div id="search_result_list"><li data-list_item_product_id="RJ', p_partkey, '"><dl><dd class="work_name"><div><a href="//www.dlsite.com/x/RJ',
        p_partkey, '.html" title="', p_name, '">short</a></div></dd><dd class="maker_name"><a href="/m">', p_brand, ' &amp; co</a> <span class="author"><a>by ', p_size,
        '</a></span></dd><dd class="work_category type_MNG"><a href="#">', p_type, '</a></dd><dd class="work_price_wrap"><span class="work_price"><span class="work_price_base">',
        {_PRICE}, '</span><span class="work_price_suffix">円</span></span></dd></li></div>')""",
        f"concat({_PAD}, '<div class=\"work_not_found\">')", "'<title>403 Forbidden</title>'",
    ),
    "fanza": (
        f"""concat('<title>x</title>', repeat(' ', 1000), '<a href="https://www.dmm.co.jp/dc/doujin/-/detail/=/cid=d_', p_partkey, '/?t=1"><p class="text-sm font-bold line-clamp-2">',
        p_name, '</p></a><p class="text-[#b42f59] x"><span class="font-bold text-lg">', {_PRICE}, '円</span></p><p class="text-xs">サークル：', p_brand,
        '</p><span class="inline-block text-white bg">', p_type, '</span>')""",
        "'検索結果 0 件'", "'<div id=\"agecheck\">'",
    ),
    "melonbooks": (
        f"""concat({_PAD}, '<ul><li class="product_', p_partkey + 100000, '"><p class="item-ttl product_title"><a>', p_name, '</a></p><p class="item-price">&yen;', {_PRICE},
        '</p><a href="/circle/index.php?circle_id=5" title="', p_brand, '">x</a><a href="/s?text_type=author&name=x" title="by ', p_size,
        '">x</a><a href="/l?category_id=3" title="', p_type, '">x</a></li></ul>')""",
        f"concat({_PAD}, '該当する商品はありません')", "'x'",
    ),
    "pixiv": (
        """concat('{"error":false,"body":{"illustManga":{"total":1,"data":[{"id":"', p_partkey, '","title":" ', p_name, ' ","userName":"', p_brand, '","xRestrict":',
        p_size % 2, ',"url":"https://i.test/1.jpg"},{"title":"no id"}]}}}')""",
        "'{\"body\":{\"illustManga\":{\"data\":[],\"total\":0}}}'", "'<html>'",
    ),
    "fantia": (
        """concat('<div><a class="x" href="/posts/', p_partkey, '" title="t">x 「<b>', p_name, '</b>」</a><a href="/fanclubs/9">', p_brand, '</a></div>')""",
        "'検索結果'", "'<a href=\"/sessions/signin\">'",
    ),
}


def _parsed_parts(spark, sf_dir):
    names = list(_BODY)
    store = f"element_at(array({', '.join(map(repr, names))}), cast(p_partkey % 5 as int) + 1)"
    pick = " ".join(
        f"when p_partkey % 5 = {k} then case when p_partkey div 5 % 4 < 2 then {ok} when p_partkey div 5 % 4 = 2 then {none} else {bad} end"
        for k, (ok, none, bad) in enumerate(_BODY.values())
    )
    responses_ = spread(T.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).selectExpr(
        f"{store} as store", "1 as tier", "p_name as query", "cast(p_partkey as string) as step_id", "200 as http_status", "'' as final_url",
        f"case {pick} end as body", "cast(null as timestamp) as ts",
    )
    return responses.parse_responses(responses_)


_SQL_STORE = "['dlsite','fanza','melonbooks','pixiv','fantia'][(p_partkey % 5)::int + 1]"


@query(
    "response_reasons",
    f"""SELECT p_partkey::varchar AS step_id, {_SQL_STORE} AS store, p_partkey // 5 % 4 < 3 AS ok, CASE WHEN p_partkey // 5 % 4 < 2 THEN 'ok' WHEN p_partkey // 5 % 4 = 2 THEN 'not-found'
      ELSE ['blocked','age-check','unexpected-page','invalid-json','login-required'][(p_partkey % 5)::int + 1] END AS reason,
      (p_partkey // 5 % 4 < 2)::int AS item_count FROM part""",
)
def response_reasons(spark, sf_dir):
    return _parsed_parts(spark, sf_dir).select("step_id", "store", "ok", "reason", "item_count")


@query(
    "response_items",
    f"""WITH p AS (SELECT *, p_partkey % 5 AS s FROM part WHERE p_partkey // 5 % 4 < 2)
    SELECT {_SQL_STORE} AS store, ['RJ','d_','','',''][s::int + 1] || (p_partkey + CASE WHEN s = 2 THEN 100000 ELSE 0 END) AS product_id, p_name AS title,
      CASE s WHEN 0 THEN p_brand || ' & co' ELSE p_brand END AS maker, CASE WHEN s IN (0, 2) THEN 'by ' || p_size WHEN s = 3 THEN p_brand END AS author,
      CASE WHEN s < 3 THEN p_type ELSE '' END AS category, CASE WHEN s < 3 THEN (p_size * 1000 + 100)::int END AS price,
      CASE WHEN s = 3 THEN (p_size % 2)::int END AS age_rating, 0 AS pos FROM p""",
)
def response_items(spark, sf_dir):
    items = responses.store_items(_parsed_parts(spark, sf_dir))
    author = F.when(F.col("store").isin("dlsite", "melonbooks", "pixiv"), F.col("author"))
    category = F.when(F.col("store").isin("pixiv", "fantia"), "").otherwise(F.col("category"))
    rating = F.when(F.col("store") == "pixiv", F.col("age_rating"))
    return items.select("store", "product_id", "title", "maker", author.alias("author"), category.alias("category"), "price", rating.alias("age_rating"), F.col("pos").cast("int").alias("pos"))


@query(
    "product_pages",
    """SELECT p_partkey::varchar AS url, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, CASE WHEN p_partkey % 3 < 2 THEN (p_size * 1000 + 100)::int END AS price,
      CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN p_size * 1000 + 100 < 1000 THEN '' ELSE (p_size + 0)::varchar || ',' END || '100円' END AS price_text FROM part""",
)
def product_pages(spark, sf_dir):
    body = (
        f"concat(if(p_partkey % 3 < 2, {_PAD}, ''), '<h1 itemprop=\"name\" id=\"work_name\"> ', p_name, ' </h1><span class=\"work_price_base\">', {_PRICE},"
        " '</span><span class=\"work_price_suffix\">円</span>')"
    )
    part = spread(T.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    return responses.parse_product_page(part.selectExpr("cast(p_partkey as string) as url", f"{body} as body"))
