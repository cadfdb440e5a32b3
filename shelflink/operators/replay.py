"""Regression replay: expectation rows against what the engine answers now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions.sql import case
from .captures import FAIL, LIMITATION, NOT_TESTED, PASS, failed_fields, grade_of, verdict
from .quality import verdict_counts

STRUCTURE = ["page_type", "h1", "og_title", "json_ld", "gallery_info", "many_images", "spa_navigation"]


def _compare(expected: str, actual: str) -> str:
    return f"if({expected} is null, '{NOT_TESTED}', {verdict(f'{expected} = ({actual})')})"


def replay(cases: DataFrame, states: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``cases(id, dir, features, expected, page_id)`` left-joined with page states
    (with ``page_features`` columns): per-field results, verdict, mismatched structure.

    A second visit costs ``repeat_requests``; a case passes the cache check when that
    is zero."""
    actual = states.select(
        "page_id",
        "status",
        F.col("extraction.cleaned_title").alias("_cleaned"),
        F.col("extraction.confidence").alias("_confidence"),
        F.expr("size(queries) > 0 and searched").alias("_queried"),
        F.col("match").isNotNull().alias("_found"),
        "requests",
        "repeat_requests",
        F.expr("coalesce(navigation_type = 'spa', false)").alias("_spa"),
        F.expr("coalesce(settled, true)").alias("_settled"),
        F.col("features").alias("_actual"),
        "fingerprint",
    )
    joined = cases.join(actual, "page_id", "left").withColumn("grade", F.expr(grade_of("status")))
    e = "expected."
    recognized = "status <> 'unrecognized'"
    has_title = "coalesce(_cleaned, '') <> ''"
    budget = f"coalesce({e}max_requests, if({recognized}, {cfg.budget_work_page}, {cfg.budget_other_page}))"
    values = {
        "pageRecognition": _compare(f"{e}page_recognition", recognized),
        "titleExtraction": case(
            (f"coalesce({e}cleaned_title, '') <> ''", verdict(f"coalesce(_cleaned, '') = {e}cleaned_title")),
            (f"{e}page_recognition = false", f"'{NOT_TESTED}'"),
            default=verdict(has_title),
        ),
        "titleCleaning": case(
            ("coalesce(_cleaned, '') = ''", f"'{NOT_TESTED}'"), ("_confidence = 'low'", f"'{FAIL}'"), default=f"'{PASS}'"
        ),
        "storeSearch": _compare(f"{e}store_search", "coalesce(_queried, false)"),
        "correctMatch": case(
            (f"coalesce({e}grade, '') <> ''", verdict(f"grade = {e}grade")),
            (f"{e}correct_match = false", verdict("not _found")),
            (f"{e}correct_match = true", verdict("_found")),
            default=f"'{NOT_TESTED}'",
        ),
        "falsePositive": case(
            (f"{e}grade = 'none'", verdict("grade = 'none'")),
            (f"coalesce({e}grade, '') = '' and {e}correct_match = false", verdict("not _found")),
            default=f"'{NOT_TESTED}'",
        ),
        "falseNegative": case(
            (f"coalesce({e}grade, '') not in ('', 'none') and grade = 'none'", f"'{FAIL}'"),
            (f"coalesce({e}grade, '') = '' and {e}correct_match = true and not _found", f"'{FAIL}'"),
            default=f"'{NOT_TESTED}'",
        ),
        "navigation": f"if(_spa, {verdict('_settled')}, '{NOT_TESTED}')",
        "requestCount": verdict(f"requests <= {budget}"),
        "cacheBehavior": verdict("repeat_requests = 0"),
    }
    results = "map(" + ", ".join(f"'{k}', if(status is null, '{NOT_TESTED}', {v})" for k, v in values.items()) + ")"
    wrong = ", ".join(f"if(features.{f} is null or _actual.{f} = features.{f}, null, '{f}')" for f in STRUCTURE)
    judged = joined.withColumn("results", F.expr(results)).withColumns(
        {
            "failed_fields": F.expr(failed_fields()),
            "mismatches": F.expr(f"if(status is null, cast(array() as array<string>), array_compact(array({wrong})))"),
        }
    )
    outcome = case(
        ("status is null", f"'{NOT_TESTED}'"),
        ("size(mismatches) > 0", f"'{FAIL}'"),
        (f"coalesce({e}limitation, false)", f"'{LIMITATION}'"),
        ("size(failed_fields) > 0", f"'{FAIL}'"),
        (f"exists(map_values(results), r -> r <> '{NOT_TESTED}')", f"'{PASS}'"),
        default=f"'{NOT_TESTED}'",
    )
    return (
        judged.withColumn("verdict", F.expr(outcome))
        .withColumn("failed_fields", F.expr("if(size(mismatches) > 0, array_union(failed_fields, array('structure')), failed_fields)"))
        .withColumn("failure_id", F.expr(f"if(verdict = '{FAIL}', format_string('FAIL-%03d', cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)), null)"))
        .select(
            "id", "dir", "page_id", "verdict", "results", "failed_fields", "mismatches", "failure_id",
            "grade", "fingerprint", "requests", "repeat_requests",
        )
    )


def _totals() -> list:
    return [
        F.count("*").alias("total"),
        *verdict_counts(),
        F.count_if(F.expr(f"results['falsePositive'] = '{FAIL}'")).alias("false_positive"),
        F.count_if(F.expr(f"results['falseNegative'] = '{FAIL}'")).alias("false_negative"),
        F.count_if(F.expr("size(mismatches) > 0")).alias("structures_mismatched"),
        F.count_if(F.expr(f"results['cacheBehavior'] = '{FAIL}'")).alias("cache_missed"),
        F.expr("coalesce(sum(requests), 0)").alias("requests"),
        F.expr("round(coalesce(sum(requests), 0) / count(*), 2)").alias("requests_per_case"),
    ]


def replay_summary(results: DataFrame) -> DataFrame:
    """One row for all cases and one per category directory, in a single pass."""
    return (
        results.withColumn("dir", F.explode(F.expr("array('(all)', coalesce(nullif(dir, ''), 'unknown'))")))
        .groupBy("dir")
        .agg(*_totals())
    )

