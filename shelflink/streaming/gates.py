"""Per-tab stream gates: settled pages, one analysis per page, no stale results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Config
from ..functions import urls as U
from ..scale import carry_last

SETTLED = "tab bigint, url string, signature string, navigated_at timestamp, settled_at timestamp, reason string"
_STATE = "url string, signature string, before string, started bigint, mutated bigint, waiting boolean, seen bigint"
WATERMARK = "10 minutes"


def _prepared(snapshots: DataFrame) -> DataFrame:
    """``snapshots(tab, url, signature, kind, ts)`` with the address made comparable
    (a change of the fragment is no navigation)."""
    return snapshots.withColumn("page", F.expr("regexp_replace(url, '#.*$', '')")).withColumn(
        "at", F.expr("unix_millis(ts)")
    )


def settle_gate(snapshots: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """After an address change, emit the page once its content differs from what was
    shown before and stayed quiet for ``settle_quiet_ms``, or at the deadline.  Another
    address change restarts the clock.  Works on a stream with a watermark on ``ts``.

    A tab's state ends by an event-time timer ``tab_lifetime_s`` after its last event, so state is
    bounded by the tabs of that time; a tab that comes back later starts as a new one."""
    quiet, deadline, lifetime = cfg.settle_quiet_ms, cfg.settle_deadline_ms, cfg.tab_lifetime_s * 1000

    def settle_time(s: dict) -> tuple[int, str]:
        limit = s["started"] + deadline
        calm = max(s["started"], s["mutated"]) + quiet
        if s["signature"] and s["signature"] != s["before"] and calm <= limit:
            return calm, "settled"
        return limit, "deadline"

    def fold(key, frames, state: GroupState):
        names = ("url", "signature", "before", "started", "mutated", "waiting", "seen")
        s = dict(zip(names, state.get)) if state.exists else dict(zip(names, ("", "", "", 0, 0, False, 0)))
        out = []

        def close_until(now: int) -> None:
            if s["waiting"]:
                at, reason = settle_time(s)
                if at <= now:
                    out.append((key[0], s["url"], s["signature"], s["started"], at, reason))
                    s["waiting"] = False

        if state.hasTimedOut:
            close_until(state.getCurrentWatermarkMs())
        else:
            events = pd.concat(list(frames)).sort_values(["at", "kind"], ascending=[True, False])
            for e in events.itertuples(index=False):
                close_until(e.at - 1)
                s["seen"] = max(s["seen"], e.at)
                if e.kind == "url":
                    if e.page != s["url"]:
                        s.update(url=e.page, before=s["signature"], started=e.at, mutated=e.at, waiting=True)
                else:
                    s["signature"] = e.signature or s["signature"]
                    if s["waiting"]:
                        s["mutated"] = e.at
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut and not s["waiting"] and s["seen"] + lifetime <= now:
            state.remove()
        else:
            state.update(tuple(s[n] for n in names))
            state.setTimeoutTimestamp(max(settle_time(s)[0] if s["waiting"] else s["seen"] + lifetime, now + 1))
        frame = pd.DataFrame(out, columns=["tab", "url", "signature", "navigated_at", "settled_at", "reason"])
        for c in ("navigated_at", "settled_at"):
            frame[c] = pd.to_datetime(frame[c], unit="ms")
        yield frame

    return (
        _prepared(snapshots)
        .withWatermark("ts", WATERMARK)
        .select("tab", "page", "signature", "kind", "at", "ts")
        .groupBy("tab")
        .applyInPandasWithState(fold, SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def settled_pages(snapshots: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """Batch twin of :func:`settle_gate`, without Python.

    Only the events within the deadline after a navigation decide it, and what was
    shown before is carried across hour buckets, so no group grows with the life of a
    tab."""
    hour = "floor(at / 3600000)"
    # at one instant the address change comes first
    events = _prepared(snapshots).withColumns(
        {
            "_url": F.expr("if(kind = 'url', page, null)"),
            "_sig": F.expr("if(kind <> 'url', nullif(signature, ''), null)"),
            "_late": F.expr("if(kind = 'url', 0, 1)"),
        }
    )
    shown = carry_last(events, "tab", ["at", "_late"], hour, {"_prev": "_url", "_before": "_sig"})
    marked = shown.withColumn(
        "_nav",
        F.expr(
            "if(kind = 'url' and (_prev is null or page <> _prev),"
            " named_struct('start', at, 'url', page, 'old', coalesce(_before, '')), null)"
        ),
    )
    current = carry_last(marked, "tab", ["at", "_late"], hour, {"_open": "_nav"})
    deadline = f"_in.start + {cfg.settle_deadline_ms}"
    steps = (
        current.withColumn("_in", F.coalesce("_nav", "_open"))
        .withColumn("_now", F.coalesce("_sig", "_before"))
        .where(f"_in is not null and at <= {deadline} and (_nav is not null or kind <> 'url')")
    )
    nav = Window.partitionBy("tab", "_in.start", "_in.url").orderBy("at", "_late")
    calm = f"at + {cfg.settle_quiet_ms}"
    settled = f"(_next is null or _next > {calm}) and _now is not null and _now <> _in.old and {calm} <= {deadline}"
    per_nav = (
        steps.withColumn("_next", F.lead("at").over(nav))
        .groupBy("tab", F.col("_in.start").alias("_start"), F.col("_in.url").alias("url"))
        .agg(
            F.min(F.expr(f"if({settled}, {calm}, null)")).alias("_calm"),
            F.min_by("_now", F.expr(f"if({settled}, {calm}, null)")).alias("_calm_sig"),
            F.max_by("_now", F.struct("at", "_late")).alias("_limit_sig"),
        )
        .withColumn("_at", F.expr(f"coalesce(_calm, _start + {cfg.settle_deadline_ms})"))
    )
    # a navigation that starts before the page settled restarts the clock; it can only lie
    # in the same or the next hour, so the look-ahead is bounded too
    copies = per_nav.withColumn("_own", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn(
        "_hour", F.expr("floor(_start / 3600000) - 1 + _own")
    )
    following = F.lead("_start").over(Window.partitionBy("tab", "_hour").orderBy("_start", "url"))
    return (
        copies.withColumn("_end", following)
        .where("_own = 1 and (_end is null or _at < _end)")
        .select(
            "tab",
            "url",
            F.coalesce(F.expr("if(_calm is null, _limit_sig, _calm_sig)"), F.lit("")).alias("signature"),
            F.expr("timestamp_millis(_start)").alias("navigated_at"),
            F.expr("timestamp_millis(_at)").alias("settled_at"),
            F.expr("if(_calm is null, 'deadline', 'settled')").alias("reason"),
        )
    )


def one_in_flight(requests: DataFrame, within: str = "30 seconds") -> DataFrame:
    """``requests(tab, url, ts)``: repeats of a running analysis are dropped."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(["tab", "url"])


def drop_stale(events: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``events(tab, url, kind in ('url', 'result'), payload, ts)``: results whose tab has
    moved on are dropped.  Only the current address of a tab is kept as state, and only until
    ``tab_lifetime_s`` after its last event."""
    lifetime = cfg.tab_lifetime_s * 1000

    def fold(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        current, seen = state.get if state.exists else (None, 0)
        kept = []
        for e in pd.concat(list(frames)).sort_values(["ts", "kind"], ascending=[True, False]).itertuples(index=False):
            seen = max(seen, int(e.at))
            if e.kind == "url":
                current = e.page
            elif current is None or current == e.page:
                kept.append((key[0], e.url, e.payload, e.ts))
        if current is not None:
            state.update((current, seen))
            state.setTimeoutTimestamp(max(seen + lifetime, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=["tab", "url", "payload", "ts"])

    return (
        events.withColumn("page", F.expr(U.page_url("url")))
        .withColumn("at", F.unix_millis("ts"))
        .withWatermark("ts", WATERMARK)
        .groupBy("tab")
        .applyInPandasWithState(
            fold, "tab bigint, url string, payload string, ts timestamp", "page string, seen bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def current_results(events: DataFrame) -> DataFrame:
    """Batch twin of :func:`drop_stale`; the address is carried across hour buckets."""
    marked = events.withColumns(
        {
            "page": F.expr(U.page_url("url")),
            "_url": F.expr(f"if(kind = 'url', {U.page_url('url')}, null)"),
            "_late": F.expr("if(kind = 'url', 0, 1)"),
        }
    )
    now = carry_last(marked, "tab", ["ts", "_late"], "floor(unix_seconds(ts) / 3600)", {"_now": "_url"})
    return now.where("kind = 'result' and (_now is null or _now = page)").select("tab", "url", "payload", "ts")
