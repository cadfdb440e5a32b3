"""Statistics over captures and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from .captures import FAIL, LIMITATION, PASS, failed_fields, failure_id, is_failure
from .fingerprint import novelty_verdict


def verdict_counts(verdict: str = "verdict") -> list:
    known = f"('{PASS}', '{FAIL}', '{LIMITATION}')"
    return [
        F.count_if(F.expr(f"{verdict} = '{PASS}'")).alias("pass"),
        F.count_if(F.expr(f"{verdict} = '{FAIL}'")).alias("fail"),
        F.count_if(F.expr(f"{verdict} = '{LIMITATION}'")).alias("expected_limitation"),
        F.count_if(F.expr(f"coalesce({verdict} not in {known}, true)")).alias("not_tested"),
    ]


def ratio(numerator: str, denominator: str):
    return F.expr(f"round(count_if({numerator}) / nullif(count_if({denominator}), 0), 3)")


def summary(captures: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """One row of counts, rates and request-budget numbers.  Verdicts are counted over
    the cases when there are any, else over the captures."""
    fp = "match.false_positive"
    claimed = "match.grade in ('found', 'possible')"
    total = "aggregate(map_values(requests.by_store), 0L, (a, b) -> a + b)"
    numbers = captures.agg(
        F.count("*").alias("total"),
        *[c.alias(f"_c_{n}") for c, n in zip(verdict_counts(), ("pass", "fail", "expected_limitation", "not_tested"))],
        F.count_if(F.expr(f"{fp}")).alias("false_positive"),
        F.count_if(F.expr(f"results['falseNegative'] = '{FAIL}'")).alias("false_negative"),
        ratio(f"results['pageRecognition'] = '{PASS}'", "true").alias("page_recognition_rate"),
        ratio(f"{fp} = false and {claimed}", f"{fp} is not null").alias("match_precision"),
        F.count_if(F.expr(claimed)).alias("claimed_matches"),
        F.count_if(F.expr(f"{fp} is not null")).alias("judged_matches"),
        F.count_if(F.expr(f"{novelty_verdict('novelty.score')} <> 'duplicate'")).alias("new_structures"),
        F.count_if(F.expr(f"{novelty_verdict('novelty.score')} = 'duplicate'")).alias("duplicate_structures"),
        F.expr(f"coalesce(sum({total}), 0)").alias("requests"),
        F.expr(f"coalesce(round(sum({total}) / count(*), 2), 0)").alias("requests_per_capture"),
        F.count_if(F.expr("coalesce(requests.total, 0) = 0")).alias("zero_request_captures"),
        F.count_if(F.expr("exists(requests.observations, o -> o.cache_hit)")).alias("cache_hit_captures"),
        F.count_if(F.expr(f"results['requestCount'] = '{FAIL}'")).alias("over_budget"),
    )
    names = ("pass", "fail", "expected_limitation", "not_tested")
    if cases is None:
        return numbers.select(
            "*", F.lit(0).cast("bigint").alias("cases"), *[F.col(f"_c_{n}").alias(n) for n in names]
        ).drop(*[f"_c_{n}" for n in names])
    judged = cases.agg(F.count("*").alias("cases"), *verdict_counts("source.verdict"))
    # two single-row aggregates side by side
    picked = [F.expr(f"if(cases > 0, {n}, _c_{n})").alias(n) for n in names]
    both = numbers.withColumn("_k", F.lit(1)).join(judged.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select(*[c for c in numbers.columns if not c.startswith("_c_")], "cases", *picked)


def requests_by_store(captures: DataFrame) -> DataFrame:
    return (
        captures.select(F.explode("requests.by_store").alias("store", "n"))
        .groupBy("store")
        .agg(F.sum("n").cast("bigint").alias("requests"))
    )


def structures(captures: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """How often each page structure occurs; ``max_structures``, where set, cuts a top-k report."""
    found = (
        captures.groupBy(F.coalesce("fingerprint", F.lit("unknown")).alias("fingerprint"))
        .agg(
            F.min_by("page_type", "capture_no").alias("page_type"),
            F.count("*").alias("count"),
            F.min("captured_at").alias("first_seen"),
        )
    )
    if cfg.max_structures is None:
        return found
    return found.orderBy(F.desc("count"), F.asc("fingerprint")).limit(cfg.max_structures)


def failure_breakdown(captures: DataFrame) -> DataFrame:
    """Failures per failed field, plus the rows ``(all)`` and ``(falsePositive)``."""
    failures = captures.where(is_failure())
    keys = (
        "concat(array('(all)'), if(coalesce(match.false_positive, false), array('(falsePositive)'),"
        f" cast(array() as array<string>)), {failed_fields()})"
    )
    return (
        failures.select(F.explode(F.expr(keys)).alias("field"))
        .groupBy("field")
        .agg(F.count("*").alias("failures"))
    )


def compact_failures(captures: DataFrame) -> DataFrame:
    """One short row per failure: the index of the failure bundles."""
    return captures.where(is_failure()).select(
        F.expr(failure_id()).alias("id"),
        F.col("id").alias("capture_id"),
        "category",
        "fingerprint",
        F.expr(failed_fields()).alias("failed_fields"),
        F.expr("coalesce(match.false_positive, false)").alias("false_positive"),
        "match.grade",
        "match.score",
        "match.store_id",
        F.col("requests.total").alias("requests"),
        "requests.cache_hit",
        F.col("novelty.score").alias("novelty"),
    )


def compact_cases(cases: DataFrame) -> DataFrame:
    return cases.select(
        "id", "category", "source.fingerprint", "source.page_type", "source.novelty", "source.verdict", "expected"
    )


def one_line_reason(health: str = "health") -> str:
    """``fields=a,b · grade=x · ...`` over a failure row (columns of the bundle)."""
    bad = f"filter(map_entries({health}), h -> h.value not in ('healthy', 'no-result'))"
    return (
        "concat_ws(' · ', concat('fields=', coalesce(nullif(array_join(failed_fields, ','), ''), 'unknown')),"
        " nullif(concat('grade=', grade), 'grade='), if(false_positive, 'falsePositive', null), nullif(fingerprint, ''),"
        f" concat('requests=', requests), nullif(array_join(transform({bad}, h -> concat(h.key, ':', h.value)), ' '), ''))"
    )


def latest_errors(log: DataFrame, keys: list[str]) -> DataFrame:
    """``log(keys, at, ok, message)``: the last error of each key unless a later success
    cleared it."""
    rolled = log.groupBy(*keys).agg(
        F.max_by(F.struct("at", "message"), F.expr("if(ok, null, at)")).alias("error"),
        F.max(F.expr("if(ok, at, null)")).alias("_ok_at"),
    )
    return (
        rolled.where("error is not null and (_ok_at is null or _ok_at < error.at)")
        .select(*keys, "error.at", "error.message")
    )

