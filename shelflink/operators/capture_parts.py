"""Merged captures in parts: what two batches of a log know of a page can be joined later.

``parts_of`` reduces a batch to one row a page, ``join_parts`` joins rows of the same page (in any
grouping, with the same result), ``records_of`` makes the merged record.  For every way to cut a
log into batches ``records_of(join_parts(all parts))`` equals ``merge_captures`` of the whole log.

A part holds the first and the latest record, the earliest decision of every check, the last
``max_observations`` observations, the number of visits and whether one of them hit the cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from .captures import NOT_TESTED, PASS, RESULT_FIELDS

FIRST = ["id", "novelty", "origin", "url_pattern", "verdict", "note"]


def _roll(parts: DataFrame, recent: Column) -> DataFrame:
    """One row a page; everything but ``recent`` is combined before the shuffle."""
    decided = [
        F.struct(
            F.min(F.col("decided")[i]["no"]).alias("no"), F.min_by(F.col("decided")[i]["value"], F.col("decided")[i]["no"]).alias("value")
        )
        for i in range(len(RESULT_FIELDS))
    ]
    return parts.groupBy("page_key").agg(
        F.min("first_no").alias("first_no"),
        F.min_by("first", "first_no").alias("first"),
        F.max("last_no").alias("last_no"),
        F.max_by("last", "last_no").alias("last"),
        F.max("hit").alias("hit"),
        F.sum("visits").alias("visits"),
        F.array(*decided).alias("decided"),
        recent.alias("recent"),
    )


def _newest(observations: str, keep: int) -> Column:
    """The ``keep`` newest of an array of (no, at, seen), newest first."""
    later = "(x, y) -> case when x.no > y.no or (x.no = y.no and x.at > y.at) then -1 when x.no = y.no and x.at <=> y.at then 0 else 1 end"
    return F.expr(f"slice(array_sort({observations}, {later}), 1, {keep})")


def parts_of(log: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """(page_key, first_no, first, last_no, last, hit, visits, decided, recent) of one batch.
    Only the newest few observations of a page are collected, so a page visited a billion times
    in a batch costs no more than its rows."""
    latest = [c for c in log.columns if c not in (*FIRST, "page_key", "results")]
    choice = lambda f: F.col("results")[f]
    decided = [
        F.struct(F.when(choice(f) != NOT_TESTED, F.col("capture_no")).alias("no"), F.when(choice(f) != NOT_TESTED, choice(f)).alias("value"))
        for f in RESULT_FIELDS
    ]
    rows = log.select(
        "page_key",
        F.col("capture_no").alias("first_no"),
        F.struct(*FIRST, F.col("match.false_positive").alias("false_positive")).alias("first"),
        F.col("capture_no").alias("last_no"),
        F.struct(*latest, "results").alias("last"),
        F.expr("coalesce(exists(requests.observations, o -> o.cache_hit), false)").alias("hit"),
        F.lit(1).cast("long").alias("visits"),
        F.array(*decided).alias("decided"),
    )
    newest = Window.partitionBy("page_key").orderBy(F.desc("no"), F.desc("seen.at"))
    seen = (
        log.select("page_key", F.col("capture_no").alias("no"), F.explode("requests.observations").alias("seen"))
        .withColumn("n", F.row_number().over(newest))
        .where(F.col("n") <= cfg.max_observations)
        .groupBy("page_key")
        .agg(F.collect_list(F.struct("no", F.col("seen.at").alias("at"), "seen")).alias("found"))
        .select("page_key", _newest("found", cfg.max_observations).alias("recent"))
    )
    rolled = _roll(rows, F.lit(None)).drop("recent")
    return rolled.join(seen, "page_key", "left")


def join_parts(parts: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Parts of several batches as one row a page; a page has at most one row a batch."""
    joined = _roll(parts, F.flatten(F.collect_list("recent")))
    return joined.withColumn("recent", _newest("recent", cfg.max_observations))


def records_of(parts: DataFrame) -> DataFrame:
    """The columns of ``merge_captures``; a page without any observation has no record."""
    latest = [c for c in parts.schema["last"].dataType.names if c not in ("requests", "match", "results")]
    value = {f: F.coalesce(F.col("decided")[i]["value"], F.col("last.results")[f]) for i, f in enumerate(RESULT_FIELDS)}
    value["cacheBehavior"] = F.when((F.col("visits") > 1) & F.col("hit"), PASS).otherwise(value["cacheBehavior"])
    observations = "transform(reverse(recent), r -> r.seen)"
    return parts.where("size(recent) > 0").select(
        "page_key",
        *[F.col(f"first.{c}") for c in FIRST if c not in ("verdict", "note")],
        *[F.col(f"last.{c}") for c in latest],
        F.col("last.match").withField("false_positive", F.col("first.false_positive")).alias("match"),
        F.expr(
            "named_struct('analyses', size(recent), 'total', last.requests.total, 'by_store', last.requests.by_store, 'cache_hit',"
            f" last.requests.cache_hit, 'cache_entry_found', last.requests.cache_entry_found, 'observations', {observations})"
        ).alias("requests"),
        F.create_map(*[x for f in RESULT_FIELDS for x in (F.lit(f), value[f])]).alias("results"),
        F.coalesce("first.verdict", F.lit(NOT_TESTED)).alias("verdict"),
        F.coalesce("first.note", F.lit("")).alias("note"),
        "visits",
    )
