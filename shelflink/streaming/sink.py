"""A sink that merges captures of a stream into a table of versions, once each.

Every micro-batch is written as a segment: its captures reduced to parts (``capture_parts``), in a
folder named by the batches it covers.  A segment counts once its marker is there, which is put
last: a killed writer leaves nothing that readers see, and its folder is written anew when the
batch comes again.  A batch that a committed segment covers is skipped, so a batch delivered twice
changes nothing.

Of ``fan`` segments of one width the aligned run of batches they cover becomes one wider segment,
so a row is rewritten log(batches) times and a reader joins at most ``fan - 1`` segments a level.
Segments that a wider one covers are deleted a batch later, when readers that had listed them
before are past them.

A table belongs to one stream: batch numbers come from its checkpoint and one query writes it.
An empty batch writes an empty segment; a table without a segment cannot be read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS, Config
from ..operators.capture_parts import join_parts, parts_of, records_of

FAN = 8
MARKER = "_COMMITTED"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _folder(table: str, span: tuple[int, int]) -> str:
    return f"{table}/batches-{span[0]}-{span[1]}"


def committed(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """(first, last batch) of every segment that has its marker, widest first."""
    files, path = _path(spark, table)
    if not files.exists(path):
        return []
    found = []
    for entry in files.listStatus(path):
        name = re.fullmatch(r"batches-(\d+)-(\d+)", entry.getPath().getName())
        span = name and (int(name[1]), int(name[2]))
        if span and files.exists(_path(spark, f"{_folder(table, span)}/{MARKER}")[1]):
            found.append(span)
    return sorted(found, key=lambda s: (s[0] - s[1], s[0]))


def _covers(wide: tuple[int, int], span: tuple[int, int]) -> bool:
    return wide[0] <= span[0] and span[1] <= wide[1]


def current(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The segments no wider one covers; ``spans`` come widest first."""
    live: list[tuple[int, int]] = []
    for span in spans:
        if not any(_covers(wide, span) for wide in live):
            live.append(span)
    return sorted(live)


def _write(parts: DataFrame, table: str, span: tuple[int, int]) -> None:
    folder = _folder(table, span)
    parts.write.mode("overwrite").parquet(folder)
    files, marker = _path(parts.sparkSession, f"{folder}/{MARKER}")
    files.create(marker).close()


def _read(spark: SparkSession, table: str, spans: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[_folder(table, span) for span in spans])


def capture_sink(table: str, cfg: Config = DEFAULTS, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: merges a batch of captures into ``table``."""
    if fan < 2:
        raise ValueError("segments are merged by two at least")

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spans = committed(spark, table)
        live = current(spans)
        for span in set(spans) - set(live):
            files, path = _path(spark, _folder(table, span))
            files.delete(path, True)
        if not any(_covers(span, (batch_id, batch_id)) for span in live):
            _write(parts_of(batch, cfg), table, (batch_id, batch_id))
        width = fan
        while (batch_id + 1) % width == 0:
            whole = (batch_id + 1 - width, batch_id)
            live = current(committed(spark, table))
            inside = [span for span in live if _covers(whole, span)]
            if len(inside) > 1:
                _write(join_parts(_read(spark, table, inside), cfg), table, whole)
            width *= fan

    return add


def read_captures(spark: SparkSession, table: str, cfg: Config = DEFAULTS) -> DataFrame:
    """The merged record of every page, as of the committed batches."""
    live = current(committed(spark, table))
    if not live:
        raise ValueError(f"{table} holds no committed batch")
    return records_of(join_parts(_read(spark, table, live), cfg))
