"""Helpers that keep jobs safe at cluster size."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir`` names.  Where it is unset, a local session
    (tests, a laptop) gets a temporary folder; a cluster gets an error, since what executors
    write to their own disks cannot be read back."""
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current:
        if not context.getCheckpointDir():
            context.setCheckpointDir(current)
        return current
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a reused intermediate as a table in the checkpoint folder and read it back:
    it is computed once however often it is read, survives lost executors, keeps column
    pruning, and the optimiser sees a short plan.  A reader that names values of the columns
    ``by`` (a few, never empty texts) reads no others."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def drop_stage(staged: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``stage`` returned, once nothing reads it any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: once driver objects are collected, Spark deletes the
    shuffle files and broadcasts behind them.  Jobs of many steps call it between steps, so that
    disk and driver memory hold one step's data and not that of all."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one task where a row is a short record that costs much work.
SPREAD_ROWS = 4_000


def spread(df: DataFrame, rows: int | None = None, rows_per_task: int = SPREAD_ROWS) -> DataFrame:
    """Deal narrow rows evenly over tasks of a few thousand rows.  A scan is cut by bytes, so millions
    of short records are two or three tasks, however much work each record becomes.  The number of
    tasks follows the rows (``rows``, else counted)."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(1, -(-rows // rows_per_task)))


def carry_last(df: DataFrame, key: str, order: list[str], bucket: str, values: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column``, the last non-null ``column`` of the same ``key``
    strictly before the row (rows ordered by ``order``, whose first column also decides
    the ``bucket`` expression).

    A plain window per key would put a hot key into one task.  Here windows run per key
    and bucket; what earlier buckets leave behind is one row per key and bucket, carried
    forward in a second, far smaller window."""
    cut = df.withColumn("_bucket", F.expr(bucket))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)
    left_behind = cut.groupBy(key, "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_l_{n}") for n, c in values.items()]
    )
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = left_behind.select(
        key, "_bucket", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    seen = cut.withColumns({f"_i_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in values.items()})
    carried = carried.withColumnsRenamed({key: "_key", "_bucket": "_b"})
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    joined = seen.join(carried, same).drop("_key", "_b")
    return joined.withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values}).drop(
        "_bucket", *[f"_i_{n}" for n in values], *[f"_c_{n}" for n in values]
    )


BUCKET_ROWS = 20_000


def number_rows(df: DataFrame, order: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds 1, 2, 3, ... in the order of the unique column ``order``.

    A window without partitions would sort everything in one task.  Instead rows are dealt by
    range into buckets of about ``bucket_rows``, numbered inside their bucket, and shifted by the
    rows before it.  The input is evaluated once and the dealt rows are a table, so a lost
    executor cannot move the borders between buckets.
    """
    once = stage(df)
    buckets = max(1, -(-once.count() // bucket_rows))
    placed = stage(once.repartitionByRange(buckets, order).withColumn("_bucket", F.spark_partition_id()))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # one row per bucket, so this window sees one row for every ``bucket_rows`` of the table
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )
