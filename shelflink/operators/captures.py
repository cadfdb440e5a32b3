"""The quality log: building captures, merging revisits, human judgements, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import text as X
from ..functions import urls as U
from ..functions.sql import Sql, case, text
from ..scale import number_rows
from .fingerprint import novelty, page_features

# Result vocabulary, result fields, grades.
PASS, FAIL, LIMITATION, NOT_TESTED = "PASS", "FAIL", "EXPECTED_LIMITATION", "NOT_TESTED"
RESULT_FIELDS = [
    "pageRecognition", "titleExtraction", "titleCleaning", "storeSearch", "correctMatch",
    "falsePositive", "falseNegative", "navigation", "requestCount", "cacheBehavior",
]
GRADES = {
    "ok_high": "found", "ok_possible": "possible", "no_result": "none", "error": "error",
    "unrecognized": "unrecognized",
}
STORE_RESULTS = {"high": "found", "possible": "possible", "error": "error", "age_check": "age_check"}


def grade_of(status: Sql) -> Sql:
    return case(*[(f"{status} = '{k}'", f"'{v}'") for k, v in GRADES.items()], default="'unknown'")


def verdict(ok: Sql) -> Sql:
    return f"if({ok}, '{PASS}', '{FAIL}')"


def stores_of(stores: Sql = "stores") -> Sql:
    """Per-store maps of one page state."""
    result = case(*[(f"s.kind = '{k}'", f"'{v}'") for k, v in STORE_RESULTS.items()], default="'not_found'")
    listed = f"coalesce({stores}, slice({stores}, 1, 0))"
    pairs = lambda value, keep="true": (
        f"map_from_entries(transform(filter({listed}, s -> {keep}), s -> struct(s.store, {value})))"
    )
    return (
        f"named_struct('order', transform({listed}, s -> s.store), 'results', {pairs(result)},"
        f" 'match_scores', {pairs('s.best.score', 's.best is not null')}, 'health', {pairs('s.health')},"
        f" 'from_cache', {pairs('s.from_cache')})"
    )


def auto_results(cfg: Config = DEFAULTS) -> Sql:
    """Map of the ten result fields of a first observation; columns ``grade``,
    ``cleaned_title``, ``confidence``, ``searched_queries``, ``store_maps``, ``features``,
    ``analysis``, ``settled``, ``request_total`` are in scope."""
    recognized = "grade <> 'unrecognized'"
    kinds = "map_values(store_maps.results)"
    usable = f"exists({kinds}, k -> k in ('found', 'possible', 'not_found'))"
    errors = f"array_contains({kinds}, 'error')"
    untested = f"'{NOT_TESTED}'"
    values = {
        "pageRecognition": verdict(recognized),
        "titleExtraction": f"if({recognized}, {verdict(X.trim_blanks(text('cleaned_title')) + chr(60) + chr(62) + chr(39) * 2)}, {untested})",
        "titleCleaning": f"if({recognized}, {verdict(text('confidence') + ' <> ' + chr(39) + 'low' + chr(39))}, {untested})",
        "storeSearch": case(
            (f"not ({recognized}) or coalesce(size(searched_queries), 0) <= 0", untested),
            (usable, f"'{PASS}'"),
            (errors, f"'{FAIL}'"),
            default=untested,
        ),
        "correctMatch": untested,
        "falsePositive": untested,
        "falseNegative": untested,
        "navigation": case(
            ("features.spa_navigation", verdict(f"analysis <= {cfg.max_analyses} and settled")),
            ("not settled", f"'{FAIL}'"),
            default=untested,
        ),
        "requestCount": verdict(
            f"request_total <= if({recognized}, {cfg.budget_work_page}, {cfg.budget_other_page})"
        ),
        "cacheBehavior": untested,
    }
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def build_captures(pages: DataFrame, states: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``pages`` (page summaries with ``capture_no``) + page states -> capture records.

    ``capture_no`` is the order of capture; novelty is measured against earlier ones.
    """
    slim = states.select(
        "page_id",
        "status",
        "state_reason",
        "signals",
        "extraction",
        F.col("queries").alias("searched_queries"),
        "artists",
        "stores",
        "match",
        F.expr("coalesce(size(candidates), 0)").alias("candidate_count"),
        F.col("requests").alias("request_total"),
        "from_cache",
        "cache_entry_found",
    )
    joined = page_features(pages.drop("signals").join(slim, "page_id"))
    by_store = "map_from_entries(transform(filter(coalesce(stores, slice(stores, 1, 0)), s -> s.requests > 0), s -> struct(s.store, s.requests)))"
    prepared = joined.withColumns(
        {
            "grade": F.expr(grade_of("status")),
            "cleaned_title": F.expr(text("extraction.cleaned_title")),
            "confidence": F.expr(text("extraction.confidence")),
            "store_maps": F.expr(stores_of()),
            "analysis": F.expr("greatest(1, coalesce(analysis_count, 1))"),
            "settled": F.expr("coalesce(settled, true)"),
            "by_store": F.expr(by_store),
        }
    ).withColumn("results", F.expr(auto_results(cfg)))
    observation = (
        "array(named_struct('at', captured_at, 'analysis', analysis, 'requests', request_total, 'by_store', by_store,"
        " 'cache_hit', from_cache, 'cache_entry_found', cache_entry_found, 'grade', grade, 'score', match.score))"
    )
    record = novelty(prepared, cfg)
    e = F.expr
    return record.select(
        F.lit("qa-capture@1").alias("schema_version"),
        e("format_string('QA-%04d', capture_no)").alias("id"),
        "capture_no",
        "page_id",
        "captured_at",
        e(U.origin_of("url")).alias("origin"),
        e(U.page_key("url")).alias("page_key"),
        e(U.url_pattern("url")).alias("url_pattern"),
        "features.page_type",
        "fingerprint",
        "fingerprint_lines",
        "features",
        "novelty",
        "category",
        e(
            f"named_struct('title', {text('title')}, 'title_script', {X.script_of('title')},"
            " 'headings', transform(slice(headings, 1, 6), h -> left(h.text, 120)), 'image_count', features.image_count,"
            " 'info_fields', features.info_fields, 'navigation_type', if(features.spa_navigation, 'spa', 'load'),"
            " 'analysis_count', analysis, 'settled', settled)"
        ).alias("page"),
        e(
            "named_struct('recognized', grade <> 'unrecognized', 'reason', state_reason, 'signals', slice(signals, 1, 8),"
            " 'title_source', coalesce(extraction.source, ''), 'cleaned_title', cleaned_title,"
            f" 'work_key', if(cleaned_title = '', '', {X.short_hash('cleaned_title')}), 'confidence', confidence,"
            " 'variants', slice(extraction.variants, 1, 4), 'searched', slice(searched_queries, 1, 4),"
            " 'artists', slice(artists, 1, 3), 'notes', slice(extraction.notes, 1, 4))"
        ).alias("extract"),
        F.col("store_maps").alias("stores"),
        e(
            "named_struct('analyses', analysis, 'total', request_total, 'by_store', by_store, 'cache_hit', from_cache,"
            f" 'cache_entry_found', cache_entry_found, 'observations', {observation})"
        ).alias("requests"),
        e(
            "named_struct('grade', grade, 'score', match.score, 'store_id', coalesce(match.store, ''),"
            f" 'product_key', if(match is null, '', {X.short_hash('match.product_id')}),"
            " 'product_title', coalesce(match.title, ''), 'candidate_count', candidate_count,"
            " 'false_positive', cast(null as boolean))"
        ).alias("match"),
        "results",
        F.lit(NOT_TESTED).alias("verdict"),
        F.lit("").alias("note"),
        "url",
    )


def merge_captures(log: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """One record per page from a log of captures: first id, novelty, verdict, note and
    false-positive mark, latest content, the last ``max_observations`` observations.  A check that
    was decided once stays decided; a cache hit on any of several visits is evidence for good, and
    visits without a hit leave the check as it was.

    Only the newest few rows of a page are collected (the window limits them before
    the shuffle); first and latest records are plain aggregates, so a page visited a
    billion times costs no more than its rows."""
    obs = F.explode("requests.observations")
    recent = Window.partitionBy("page_key").orderBy(F.desc("capture_no"), F.desc("_o.at"))
    observations = (
        log.select("page_key", "capture_no", obs.alias("_o"))
        .withColumn("_n", F.row_number().over(recent))
        .where(F.col("_n") <= cfg.max_observations)
        .groupBy("page_key")
        .agg(F.collect_list(F.struct("_n", "_o")).alias("_obs"))
        .select("page_key", F.expr("transform(array_sort(_obs, (a, b) -> b._n - a._n), o -> o._o)").alias("observations"))
    )
    keep_first = ["id", "novelty", "origin", "url_pattern", "verdict", "note"]
    latest = [c for c in log.columns if c not in (*keep_first, "page_key", "results")]
    judged = [
        F.max_by(F.expr(f"results['{f}']"), F.expr(f"if(results['{f}'] <> '{NOT_TESTED}', -capture_no, null)")).alias(f"_j{i}")
        for i, f in enumerate(RESULT_FIELDS)
    ]
    rolled = log.groupBy("page_key").agg(
        F.min_by(F.struct(*keep_first), "capture_no").alias("_first"),
        F.max_by(F.struct(*latest), "capture_no").alias("_last"),
        F.max_by("results", "capture_no").alias("_results"),
        F.min_by(F.struct("match.false_positive"), "capture_no").alias("_marked"),
        F.max(F.expr("exists(requests.observations, o -> o.cache_hit)")).alias("_hit"),
        F.count("*").alias("visits"),
        *judged,
    )
    merged = rolled.join(observations, "page_key")
    results = "map(" + ", ".join(
        f"'{f}', " + (
            f"if(visits > 1 and _hit, '{PASS}', coalesce(_j{i}, _results['{f}']))"
            if f == "cacheBehavior"
            else f"coalesce(_j{i}, _results['{f}'])"
        )
        for i, f in enumerate(RESULT_FIELDS)
    ) + ")"
    return merged.select(
        "page_key",
        *[F.col(f"_first.{c}") for c in keep_first if c not in ("verdict", "note")],
        *[F.col(f"_last.{c}") for c in latest if c not in ("requests", "match")],
        F.col("_last.match").withField("false_positive", F.col("_marked.false_positive")).alias("match"),
        F.expr(
            "named_struct('analyses', size(observations), 'total', _last.requests.total, 'by_store', _last.requests.by_store,"
            " 'cache_hit', _last.requests.cache_hit, 'cache_entry_found', _last.requests.cache_entry_found,"
            " 'observations', observations)"
        ).alias("requests"),
        F.expr(results).alias("results"),
        F.coalesce("_first.verdict", F.lit(NOT_TESTED)).alias("verdict"),
        F.coalesce("_first.note", F.lit("")).alias("note"),
        "visits",
    )


def newest_captures(captures: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The log keeps the last ``max_captures`` pages (a capacity limit: global top-k)."""
    return captures if cfg.max_captures is None else captures.orderBy(F.desc("capture_no")).limit(cfg.max_captures)


def apply_judgements(captures: DataFrame, judgements: DataFrame) -> DataFrame:
    """``judgements(page_key, at, verdict, false_positive, note)`` is append-only; the
    latest non-null value of each kind wins.  A false positive is a failed verdict."""
    allowed = f"('{PASS}', '{FAIL}', '{LIMITATION}', '{NOT_TESTED}')"
    when = lambda c: F.max_by(c, F.expr(f"if({c} is null, null, at)")).alias(f"_{c}")
    latest = judgements.groupBy("page_key").agg(when("verdict"), when("false_positive"), when("note"))
    fp = "coalesce(_false_positive, match.false_positive)"
    return (
        captures.join(latest, "page_key", "left")
        .withColumn(
            "verdict",
            F.expr(
                f"case when {fp} then '{FAIL}' when _verdict is null then verdict"
                f" when _verdict in {allowed} then _verdict else '{NOT_TESTED}' end"
            ),
        )
        .withColumn("note", F.expr(f"if(_note is null, note, {X.clip('_note', 300)})"))
        .withColumn(
            "results",
            F.expr(
                "if(_false_positive is null, results, map_concat(map_filter(results, (k, v) -> k <> 'falsePositive'),"
                f" map('falsePositive', if(_false_positive, '{FAIL}', '{PASS}'))))"
            ),
        )
        .withColumn("match", F.expr(f"named_struct('grade', match.grade, 'score', match.score, 'store_id', match.store_id,"
                                    " 'product_key', match.product_key, 'product_title', match.product_title,"
                                    f" 'candidate_count', match.candidate_count, 'false_positive', {fp})"))
        .drop("_verdict", "_false_positive", "_note")
    )


def failed_fields(results: Sql = "results") -> Sql:
    names = ", ".join(f"'{f}'" for f in RESULT_FIELDS)
    return f"filter(array({names}), f -> {results}[f] = '{FAIL}')"


def is_failure() -> Sql:
    """A wrong recommendation, a failed verdict, a failed check on a recognised page, or
    requests for a page that is no work page."""
    return (
        f"(coalesce(match.false_positive, false) or verdict = '{FAIL}' or if(extract.recognized,"
        f" size(array_remove({failed_fields()}, 'pageRecognition')) > 0, coalesce(results['requestCount'] = '{FAIL}', false)))"
    )


def failure_id(capture_id: Sql = "id") -> Sql:
    digits = f"regexp_extract({capture_id}, '([0-9]+) *$', 1)"
    return f"if({digits} <> '', format_string('FAIL-%03d', cast({digits} as bigint)), concat('FAIL-', {X.short_hash(capture_id, 4)}))"


def next_case_number(cases: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(id, '^RW-([0-9]+)$', 1) as bigint)")
    return cases.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_case"))


def create_cases(captures: DataFrame, start: int = 1) -> DataFrame:
    """Expectation rows for captures, numbered in capture order from ``start``."""
    numbered = number_rows(captures, "capture_no", "_n")
    return numbered.select(
        F.expr(f"format_string('RW-%03d', _n + {start - 1})").alias("id"),
        F.col("id").alias("capture_id"),
        "category",
        F.expr("date_format(captured_at, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").alias("captured_at"),
        F.expr(
            "named_struct('page_type', features.page_type, 'h1', features.h1, 'og_title', features.og_title,"
            " 'json_ld', features.json_ld, 'gallery_info', features.gallery_info, 'many_images', features.many_images,"
            " 'spa_navigation', features.spa_navigation)"
        ).alias("features"),
        F.expr(
            f"named_struct('page_recognition', results['pageRecognition'] = '{PASS}', 'store_search', results['storeSearch'] = '{PASS}',"
            " 'correct_match', match.grade = 'found' and not coalesce(match.false_positive, false),"
            " 'false_positive', coalesce(match.false_positive, false))"
        ).alias("expected"),
        F.expr("named_struct('fingerprint', fingerprint, 'page_type', page_type, 'novelty', novelty.score, 'verdict', verdict)").alias("source"),
        "note",
    )
