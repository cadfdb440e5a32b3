"""Captures merged batch by batch equal the merge of the whole log."""

import json

import pytest
from pyspark.sql import functions as F

from shelflink.operators import captures as C
from shelflink.operators.capture_parts import join_parts, parts_of, records_of
from shelflink.plans import queries as Q
from shelflink.streaming import sink as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Pages of one to some dozen visits; decisions, cache hits and marks differ from visit to visit."""
    path = str(tmp_path_factory.mktemp("captures") / "log")
    Q._event_captures(spark, DATA).withColumn("page_key", F.concat(F.lit("p"), F.col("capture_no") % 37)).repartition(6, "capture_no").write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(json.dumps(json.loads(x), sort_keys=True) for (x,) in df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).collect())


@pytest.fixture(scope="module")
def whole(log):
    found = rows(C.merge_captures(log))
    assert len(found) == 37
    return found


@pytest.mark.parametrize("batch", ["0", "capture_no % 5", "int(capture_no / 200)", "page_key"])
def test_parts_joined_in_any_grouping(log, whole, batch):
    keys = [r.b for r in log.select(F.expr(batch).alias("b")).distinct().limit(4).collect()]
    cut = [log.where(F.expr(batch) == k) for k in keys] + [log.where(~F.expr(batch).isin(keys))]
    parts = [parts_of(x) for x in cut]
    early = join_parts(parts[0].unionByName(parts[1]))
    for other in parts[2:]:
        early = early.unionByName(other)
    assert rows(records_of(join_parts(early))) == whole


def test_stream_into_the_sink(spark, log, whole, tmp_path):
    path, table = str(tmp_path / "log"), str(tmp_path / "table")
    log.repartition(7).write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.writeStream.foreachBatch(S.capture_sink(table, fan=2)).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert S.current(S.committed(spark, table)) == [(0, 3), (4, 5), (6, 6)]
    assert rows(S.read_captures(spark, table)) == whole


def test_a_batch_twice_and_a_killed_writer(spark, log, whole, tmp_path):
    table = str(tmp_path / "table")
    with pytest.raises(ValueError):
        S.read_captures(spark, table)
    add, batches = S.capture_sink(table, fan=3), [log.where(f"capture_no % 4 = {k}") for k in range(4)]
    add(batches[0], 0)
    once = rows(S.read_captures(spark, table))
    add(batches[0], 0)  # delivered again
    assert rows(S.read_captures(spark, table)) == once
    # a writer that died: files without a marker are not seen and give way to the batch that comes again
    parts_of(batches[2]).write.parquet(S._folder(table, (1, 1)))
    assert rows(S.read_captures(spark, table)) == once
    for k in (1, 2):
        add(batches[k], k)
    assert S.current(S.committed(spark, table)) == [(0, 2)] and len(S.committed(spark, table)) == 4
    add(batches[1], 1)  # again, after its segment was merged; what is covered goes now
    add(log.limit(0), 3)
    add(batches[3], 4)
    assert S.committed(spark, table) == [(0, 2), (3, 3), (4, 4)]
    assert rows(S.read_captures(spark, table)) == whole
