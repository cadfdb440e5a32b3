"""Store health: what a search step, and a whole search, says about the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import Sql, case

# Verdict reasons and the severity order of verdicts.
BLOCKED_STATUSES = (401, 403, 429, 451, 503)
BLOCKED_REASONS = ("blocked", "age-check", "login-required")
SEARCH_FAILED_REASONS = ("empty-response", "unexpected-page")
PARSER_BROKEN_REASONS = ("no-items-parsed", "invalid-json", "unexpected-payload")
SEVERITY = {"no-result": 1, "parser-broken": 2, "search-failed": 3, "blocked": 4}
LABELS = {
    "healthy": "search returned candidates",
    "degraded": "candidates returned, but part of the search plan failed",
    "blocked": "age gate, login wall or rate limit",
    "parser-broken": "the search page did not match the expected markup",
    "search-failed": "the request did not return a search page",
    "no-result": 'the store answered with an explicit "not found"',
}


def step_health(http_status: Sql = "http_status", reason: Sql = "reason", items: Sql = "item_count") -> Sql:
    """An empty page never means "no such work" unless the store says so."""
    status, why, count = f"coalesce({http_status}, 0)", f"coalesce({reason}, '')", f"coalesce({items}, 0)"
    return case(
        (f"{count} > 0", "'healthy'"),
        (f"{status} in {BLOCKED_STATUSES} or {why} in {BLOCKED_REASONS}", "'blocked'"),
        (f"{why} = 'not-found'", "'no-result'"),
        (f"{why} in {PARSER_BROKEN_REASONS}", "'parser-broken'"),
        (f"{why} in {SEARCH_FAILED_REASONS}", "'search-failed'"),
        (f"{status} >= 500 or {status} = 0", "'search-failed'"),
        (f"{why} = 'ok'", "'no-result'"),
        (f"{status} = 200", "'parser-broken'"),
        default="'search-failed'",
    )


def severity(verdict: Sql) -> Sql:
    return case(*[(f"{verdict} = '{name}'", str(n)) for name, n in SEVERITY.items()], default="1")


def verdict_of(total: Sql, failures: Sql, worst: Sql) -> Sql:
    names = case(*[(f"{worst} = {n}", f"'{name}'") for name, n in SEVERITY.items()], default="'no-result'")
    return case(
        (f"{total} > 0 and {failures} > 0", "'degraded'"), (f"{total} > 0", "'healthy'"), default=names
    )


def health_label(health: Sql) -> Sql:
    return case(*[(f"{health} = '{k}'", "'" + v + "'") for k, v in LABELS.items()], default=health)


def store_usable(health: Sql) -> Sql:
    return f"({health} in ('healthy', 'degraded'))"


def can_conclude_no_result(health: Sql) -> Sql:
    return f"({health} = 'no-result')"


def store_health(steps: DataFrame, by: list) -> DataFrame:
    """Roll steps up per ``by``: one partial + final hash aggregation."""
    judged = steps.withColumn("_v", F.expr(step_health()))
    rolled = judged.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.sum("item_count").cast("bigint").alias("items"),
        F.count_if(F.expr("_v not in ('no-result', 'healthy')")).alias("failures"),
        F.max(F.expr(severity("_v"))).alias("_worst"),
    )
    return rolled.withColumn("health", F.expr(verdict_of("items", "failures", "_worst"))).drop("_worst")
