"""Streams with memory: result cache, capture log, accounting, health, errors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Config
from ..operators.health import store_health
from ..operators.quality import latest_errors

WATERMARK = "10 minutes"


def ttl_cache(log: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``log(cache_key, event_id, is_write, n_items, ts)``: lookups with ``entry_found`` and
    ``cache_hit``.  One entry per key is kept and dropped by an event-time timer when its
    lifetime ends, so state is bounded by the live entries."""
    hit, miss, negative = cfg.hit_ttl_s * 1000, cfg.miss_ttl_s * 1000, cfg.serve_negative

    def fold(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, n = state.get if state.exists else (None, 0)
        out = []
        events = pd.concat(list(frames)).sort_values(["micros", "is_write", "n_items"], ascending=[True, False, True])
        for e in events.itertuples(index=False):
            if e.is_write:
                at, n = int(e.micros), int(e.n_items)
            else:
                live = at is not None and e.micros - at <= (hit if n > 0 else miss) * 1000
                out.append((key[0], e.event_id, bool(live), bool(live and (n > 0 or negative))))
        if at is not None:
            state.update((at, n))
            state.setTimeoutTimestamp(max(at // 1000 + hit + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["cache_key", "event_id", "entry_found", "cache_hit"])

    return (
        log.withWatermark("ts", WATERMARK)
        .withColumn("micros", F.unix_micros("ts"))
        .groupBy("cache_key")
        .applyInPandasWithState(
            fold,
            "cache_key string, event_id bigint, entry_found boolean, cache_hit boolean",
            "at bigint, n_items int",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def capture_upserts(log: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``log(page_key, capture_no, requests, cache_hit, grade, novelty, ts)``: the merged
    record of a page after each batch (update mode).  State per page is its first novelty, the
    last ``max_observations`` observations and whether any visit hit the cache."""
    keep = cfg.max_observations

    def fold(key, frames, state: GroupState):
        novelty, visits, numbers, requests, hit, grade = state.get if state.exists else (None, 0, [], [], False, "")
        numbers, requests = list(numbers), list(requests)
        for e in pd.concat(list(frames)).sort_values("capture_no").itertuples(index=False):
            novelty = int(e.novelty) if visits == 0 else novelty
            visits += 1
            numbers, requests = (numbers + [int(e.capture_no)])[-keep:], (requests + [int(e.requests)])[-keep:]
            hit = hit or bool(e.cache_hit)
            grade = e.grade
        state.update((novelty, visits, numbers, requests, hit, grade))
        cache = "PASS" if hit and visits > 1 else "NOT_TESTED"
        yield pd.DataFrame(
            [(key[0], novelty, visits, grade, cache, ",".join(map(str, numbers)), sum(requests))],
            columns=["page_key", "novelty", "visits", "grade", "cache_behavior", "observed", "requests"],
        )

    return log.groupBy("page_key").applyInPandasWithState(
        fold,
        "page_key string, novelty int, visits bigint, grade string, cache_behavior string, observed string, requests bigint",
        "novelty int, visits bigint, numbers array<bigint>, requests array<bigint>, hit boolean, grade string",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def request_counts(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests per page, store and time window."""
    return (
        requests.withWatermark("ts", WATERMARK)
        .groupBy("page_key", "store", F.window("ts", width))
        .agg(F.count("*").alias("requests"))
        .select("page_key", "store", F.col("window.start").alias("window_start"), "requests")
    )


def health_over_time(steps: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Store health in tumbling windows: the same roll-up as the batch one."""
    windowed = steps.withWatermark("ts", WATERMARK)
    return store_health(windowed, ["store", F.window("ts", width).alias("window")]).select(
        "store", F.col("window.start").alias("window_start"), "steps", "items", "failures", "health"
    )


def current_errors(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last error per key while no later success cleared it (complete mode)."""
    return latest_errors(log, keys)
