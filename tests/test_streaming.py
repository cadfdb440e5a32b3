import os
import random

import pytest
from pyspark.sql import functions as F

from shelflink import schemas
from shelflink.operators import cache as K
from shelflink.operators import health as H
from shelflink.streaming import gates as G
from shelflink.streaming import state as S

T0 = 1_700_000_000_000


def replay(spark, df, build, tmp_path, mode="append", order="ts", chunks=3):
    """Feed ``df`` as a file stream in ``chunks`` batches and return the result rows."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // chunks)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out_{random.randrange(10**9)}"
    for i in range(chunks):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.parquet(str(tmp_path / f"p{i}"))
        (src,) = [f for f in os.listdir(tmp_path / f"p{i}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"p{i}" / src, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    replay.state_rows = [o["numRowsTotal"] for o in q.lastProgress["stateOperators"]] if q.lastProgress else []
    q.stop()
    return spark.table(name)


def snapshots(spark, rows):
    df = spark.createDataFrame(rows, "tab bigint, url string, signature string, kind string, ms bigint")
    return df.withColumn("ts", F.expr("timestamp_millis(ms)")).drop("ms")


@pytest.fixture(scope="module")
def tabs(spark):
    rows = [
        (1, "http://a/1", "", "url", T0), (1, "http://a/1", "s1", "mutation", T0 + 100), (1, "http://a/1", "s2", "mutation", T0 + 300),
        (1, "http://a/1#x", "", "url", T0 + 2000),  # fragment only
        (1, "http://a/2", "", "url", T0 + 9000),  # no change: deadline
        (1, "http://a/3", "", "url", T0 + 30000), (1, "http://a/4", "", "url", T0 + 30200),  # restarted
        (1, "http://a/4", "s3", "mutation", T0 + 30300),
        (2, "http://b/1", "", "url", T0 + 50), (2, "http://b/1", "t1", "mutation", T0 + 5300),
        (9, "http://z/", "", "url", T0 + 3_600_000),
    ]
    return snapshots(spark, rows)


EXPECTED = {
    (1, "http://a/1", "s2", 700, "settled"), (1, "http://a/2", "s2", 14000, "deadline"), (1, "http://a/4", "s3", 30700, "settled"),
    (2, "http://b/1", "", 5050, "deadline"),
}


def as_set(df):
    return {(r.tab, r.url, r.signature, r.ms - T0, r.reason) for r in df.withColumn("ms", F.expr("unix_millis(settled_at)")).collect() if r.tab != 9}


def test_settle_gate_batch(tabs):
    assert as_set(G.settled_pages(tabs)) == EXPECTED


def test_settle_gate_stream(spark, tabs, tmp_path):
    late = tabs.unionByName(snapshots(spark, [(9, "http://z/2", "", "url", T0 + 7_200_000)]))
    assert as_set(replay(spark, late, G.settle_gate, tmp_path, chunks=4)) == EXPECTED


def test_stale_results(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "http://a/1", "url", "", 1), (1, "http://a/1/", "result", "ok", 2), (1, "http://a/2", "url", "", 3), (1, "http://a/1", "result", "stale", 4)],
        "tab bigint, url string, kind string, payload string, s bigint").withColumn("ts", F.expr("timestamp_seconds(s)")).drop("s")
    assert [r.payload for r in G.current_results(df).collect()] == ["ok"]
    assert [r.payload for r in replay(spark, df, G.drop_stale, tmp_path).collect()] == ["ok"]


def test_ttl_cache_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", i, rng.random() < 0.3, rng.randrange(3), T0 // 1000 + i * 97) for i in range(240)]
    log = spark.createDataFrame(rows, "cache_key string, event_id bigint, is_write boolean, n_items int, s bigint").withColumn("ts", F.expr("timestamp_seconds(s)")).drop("s")
    batch = K.lookup_log(log.where("not is_write").select("cache_key", "event_id", "ts"), log.where("is_write").selectExpr("cache_key", "ts as at", "n_items"))
    want = {(r.cache_key, r.event_id, r.entry_found, r.cache_hit) for r in batch.collect()}
    state, plain = {}, set()
    for k, i, w, n, s in rows:
        if w:
            state[k] = (s, n)
        else:
            at, m = state.get(k, (None, 0))
            live = at is not None and s - at <= (1800 if m > 0 else 300)
            plain.add((k, i, live, live and m > 0))
    assert want == plain
    got = replay(spark, log, S.ttl_cache, tmp_path)
    assert {(r.cache_key, r.event_id, r.entry_found, r.cache_hit) for r in got.collect()} == want


def test_capture_upserts(spark, tmp_path):
    rows = [(f"p{i % 3}", i, i % 4, i == 7, "found" if i > 8 else "none", 100 - i, 1_700_000_000 + i) for i in range(24)]
    log = spark.createDataFrame(rows, "page_key string, capture_no bigint, requests int, cache_hit boolean, grade string, novelty int, s bigint").withColumn("ts", F.expr("timestamp_seconds(s)")).drop("s")
    out = replay(spark, log, S.capture_upserts, tmp_path, mode="update")
    last = {r.page_key: r for r in out.orderBy("visits").collect()}
    assert (last["p1"].novelty, last["p1"].visits, last["p1"].observed) == (99, 8, "7,10,13,16,19,22") and last["p1"].cache_behavior == "PASS"
    assert last["p0"].cache_behavior == "NOT_TESTED" and last["p0"].grade == "found"


def test_windowed_health_and_counts(spark, tmp_path):
    rows = [("a", "q", "s", 200, True, "ok", i % 2, 1_700_000_400 + i * 60) for i in range(30)]
    df = spark.createDataFrame(rows, schemas.SEARCH_STEPS + ", sec bigint").withColumn("ts", F.expr("timestamp_seconds(sec)")).drop("sec")
    got = {(r.store, r.window_start, r.steps, r.health) for r in replay(spark, df, S.health_over_time, tmp_path, "complete").collect()}
    want = {(r.store, r.window.start, r.steps, r.health) for r in H.store_health(df, ["store", F.window("ts", "10 minutes").alias("window")]).collect()}
    assert got == want and len(got) == 3


def test_in_flight_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", 1), (1, "u", 2), (2, "u", 3)], "tab bigint, url string, s bigint").withColumn("ts", F.expr("timestamp_seconds(s)")).drop("s")
    assert replay(spark, df, G.one_in_flight, tmp_path, chunks=1).count() == 2
    log = spark.createDataFrame([("x", 1, False, "e1"), ("x", 2, True, ""), ("y", 1, True, ""), ("y", 2, False, "e2")], "k string, s bigint, ok boolean, message string").withColumn("at", F.expr("timestamp_seconds(s)")).drop("s")
    assert [(r.k, r.message) for r in S.current_errors(log, ["k"]).collect()] == [("y", "e2")]


@pytest.mark.parametrize("gate", [G.settle_gate, G.drop_stale])
def test_state_of_a_tab_ends_with_its_lifetime(spark, tmp_path, gate):
    """Forty tabs, then days later a single one: the others' state is gone, their pages are out."""
    day = 24 * 3_600_000
    rows = [(k, f"http://a/{k}", f"s{k}", "mutation" if gate is G.settle_gate else "result", T0 + k + 1000) for k in range(40)]
    rows += [(k, f"http://a/{k}", "", "url", T0 + k) for k in range(40)]
    rows += [(99, f"http://z/{k}", "", "url", T0 + k * day) for k in (2, 3, 4)]
    df = snapshots(spark, rows).withColumn("payload", F.col("signature"))
    got = {r.tab for r in replay(spark, df, gate, tmp_path, chunks=5).collect()}
    assert got - {99} == set(range(40))
    assert replay.state_rows == [1]
