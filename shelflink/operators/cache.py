"""Result-cache semantics over tables: keys, live entries, capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions.sql import Sql, quote

KEY_VERSION = "v2"


def cache_key(store: Sql, queries: Sql) -> Sql:
    """Equal store and query list <=> equal key (128-bit digest, versioned prefix)."""
    joined = f"array_join({queries}, '\\u0001')"
    return f"concat({quote(KEY_VERSION + ':')}, {store}, ':', left(sha2({joined}, 256), 32))"


def time_to_live(n_items: Sql, cfg: Config = DEFAULTS) -> Sql:
    return f"if({n_items} > 0, {cfg.hit_ttl_s}, {cfg.miss_ttl_s})"


def lookup(requests: DataFrame, entries: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``requests(cache_key, ts, ...)`` left-joined with ``entries(cache_key, at, n_items)``
    (one entry per key): adds ``entry_found`` and ``cache_hit``.  Empty answers are kept
    in the cache but only served with ``serve_negative``."""
    entry = entries.select("cache_key", "at", "n_items")
    live = f"coalesce(at <= ts and ts <= at + make_interval(0, 0, 0, 0, 0, 0, {time_to_live('n_items', cfg)}), false)"
    served = live if cfg.serve_negative else f"({live} and n_items > 0)"
    return (
        requests.join(entry, "cache_key", "left")
        .withColumn("entry_found", F.expr(live))
        .withColumn("cache_hit", F.expr(served))
        .drop("at", "n_items")
    )


def lookup_log(lookups: DataFrame, writes: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """``lookups(cache_key, ts, ...)`` against the write log ``writes(cache_key, at,
    n_items)``: each lookup sees the last write at or before it.

    No entry outlives ``hit_ttl_s``, so the write that matters lies in the lookup's time
    bucket of that length or in the one before.  Writes are copied into the next bucket
    and the window is per key *and* bucket: a key that fills the log is still cut into
    bounded pieces."""
    bucket = f"floor(unix_seconds({{t}}) / {cfg.hit_ttl_s})"
    asked = lookups.withColumn("_b", F.expr(bucket.format(t="ts"))).withColumns(
        {"_is_write": F.lit(0), "_at": F.col("ts"), "_w": F.expr("cast(null as struct<at:timestamp,n_items:int>)")}
    )
    written = writes.select(
        "cache_key",
        F.explode(F.expr(f"array({bucket.format(t='at')}, {bucket.format(t='at')} + 1)")).alias("_b"),
        F.lit(1).alias("_is_write"),
        F.col("at").alias("_at"),
        F.expr("named_struct('at', at, 'n_items', cast(n_items as int))").alias("_w"),
    )
    order = Window.partitionBy("cache_key", "_b").orderBy("_at", F.desc("_is_write"), "_w.n_items")
    both = asked.unionByName(written, allowMissingColumns=True)
    seen = both.withColumn("_w", F.last("_w", ignorenulls=True).over(order)).where("_is_write = 0")
    live = f"coalesce(unix_micros(ts) - unix_micros(_w.at) <= {time_to_live('_w.n_items', cfg)} * 1000000L, false)"
    served = live if cfg.serve_negative else f"({live} and _w.n_items > 0)"
    return (
        seen.withColumn("entry_found", F.expr(live))
        .withColumn("cache_hit", F.expr(served))
        .drop("_b", "_is_write", "_at", "_w")
    )


def within_capacity(entries: DataFrame, cfg: Config = DEFAULTS) -> DataFrame:
    """The newest ``cache_entries`` entries (a capacity limit, so a global top-k)."""
    return entries if cfg.cache_entries is None else entries.orderBy(F.desc("at"), F.asc("cache_key")).limit(cfg.cache_entries)


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"))
