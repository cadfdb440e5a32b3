"""Exact deduplication against immutable snapshots.

A snapshot holds the digests of documents already kept, cut into buckets by the head of the
digest, with one static binary fuse filter per bucket.  An incoming batch is reduced to its
distinct digests (duplicates inside the batch are grouped there, apart from any snapshot) and
screened: what no filter lets pass is new for certain; what passes joins the exact bucket, which
settles chance hits.  Last, the texts under one digest are compared byte for byte: the least and
the greatest text of a digest must be the same string.  Should digests ever collide, the rows
concerned are grouped by their whole text instead.

Only digests travel up to the groups; the byte check joins texts with the digests of groups of two
or more, which deals every text by its digest once (unique ones leave at the join).  Reductions of
digests pre-aggregate before their shuffle, so a text that a third of all rows repeat is one row a
task there; the check's join meets such a text as one hot key, which AQE's skew join may split.

Texts are equal when identical after replacing each run of ASCII blanks by one space.
Edge cases: null text counts as empty; empty texts equal each other; rows that repeat a doc_id
and a text are copies of which one stays; a null doc_id sorts after all others; extra columns are
ignored; a very long text is one row, hashed and compared whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage
from .common import buckets_for, text_of, unused
from .fuse_filter import build, contains

#: Keys of one filter on average; the number of buckets follows the table.
BUCKET_KEYS = 32_768


def normalised(text: Column) -> Column:
    """Each run of blanks as one space (runs that are a single space already are left alone)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass
class Snapshot:
    """Immutable: ``exact`` (digest, bucket, keep_id, rows) and ``filters`` (bucket, filter)."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(buckets))


def _key(digests: pd.Series):
    """The second 64 bits of each digest, as the filters' keys (the bucket uses the first)."""
    return digests.str.slice(16, 32).map(lambda x: int(x, 16)).to_numpy(dtype="uint64")


def digests(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, doc_id, rows): one row for each distinct pair."""
    body = digest(normalised(text_of()))
    return docs.select(body.alias("digest"), "doc_id").groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))


def group(found: DataFrame) -> DataFrame:
    """Duplicates of one batch: (digest, keep_id, rows)."""
    return found.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("rows"))


def build_snapshot(groups: DataFrame) -> Snapshot:
    """Write grouped digests as a snapshot: exact buckets and a filter for each."""
    buckets = buckets_for(groups.count(), BUCKET_KEYS)
    exact = stage(groups.withColumn("bucket", _bucket(buckets)))

    def fill(key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [build(_key(rows["digest"]))]})

    filters = exact.select("bucket", "digest").groupBy("bucket").applyInPandas(fill, "bucket bigint, filter binary")
    return Snapshot(exact, stage(filters), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of a batch that the snapshot's filters let pass (never fewer than it holds)."""

    def probe(key: Any, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filters.empty:
            return rows.iloc[:0]
        return rows[contains(bytes(filters["filter"].iloc[0]), _key(rows["digest"]))]

    keyed = groups.select("digest", _bucket(snapshot.buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(probe, "digest string, bucket bigint").select("digest")


def match(groups: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """A batch's groups with the older documents of the same digest added: (digest, keep_id,
    rows, old_rows)."""
    found = None
    for snapshot in snapshots:
        hit = screen(groups, snapshot).join(snapshot.exact.select("digest", "keep_id", "rows"), "digest")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return groups.withColumn("old_rows", F.lit(0).cast("long"))
    old = found.groupBy("digest").agg(F.min("keep_id").alias("old_id"), F.sum("rows").alias("old_rows"))
    return groups.join(old, "digest", "left").select(
        "digest", F.least("keep_id", "old_id").alias("keep_id"), "rows", F.coalesce("old_rows", F.lit(0)).alias("old_rows")
    )


def _split_at(found: DataFrame) -> DataFrame:
    """A lone table as two batches in the order of ids: the older half of the id range is the
    snapshot, the newer half arrives.  Rows without an id arrive last."""
    ends = found.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = (ends.lo + ends.hi) // 2 if ends.lo is not None else 0
    return found.withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False)))


def deduplicate(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, digest."""
    found = stage(_split_at(stage(digests(docs, digest))))
    old = build_snapshot(group(found.where("old")))
    new = match(group(found.where("not old")), [old])
    every = (
        new.select("digest", "keep_id", (F.col("rows") + F.col("old_rows")).alias("rows"))
        .unionByName(old.exact.select("digest", "keep_id", "rows"))
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.max("rows").alias("group_size"))
    )
    groups = stage(every)
    shared = groups.where("group_size > 1").select("digest")
    body = normalised(text_of())
    members = docs.select(digest(body).alias("digest"), body.alias("body")).join(shared, "digest")
    ends = members.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    collided = stage(ends.where("lo <> hi").select("digest"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    if collided.isEmpty():
        return _rows(found, groups, ["digest"]).select(*columns)
    # digests that stand for different texts: these rows alone are grouped by text
    apart = (
        docs.select(digest(body).alias("digest"), "doc_id", body.alias("body"))
        .join(collided, "digest")
        .groupBy("digest", "body", "doc_id")
        .agg(F.count("*").alias("rows"))
    )
    texts = apart.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    fine = found.join(collided, "digest", "left_anti")
    return _rows(fine, groups, ["digest"]).select(*columns).unionByName(_rows(apart, texts, ["digest", "body"]).select(*columns))


def _rows(found: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Back to one row a document; of rows that repeat the kept id the first stays."""
    copy = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.join(groups, key).select(*found.columns, "keep_id", "group_size", copy).withColumn("kept", stays)


def keep_documents(docs: DataFrame, digest=sha256) -> DataFrame:
    """The documents that stay, all columns as they came.  Of rows equal in doc_id and text one stays."""
    own, row, copy = (unused(docs, name) for name in ("own_digest", "kept_row", "copy_number"))
    found = deduplicate(docs, digest).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
    kept = stage(found.select(F.struct("doc_id", "digest", "rows").alias(row)))
    keyed = docs.withColumn(own, digest(normalised(text_of())))
    joined = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[row]["doc_id"]) & (keyed[own] == kept[row]["digest"])).drop(row)
    if not kept.where(F.col(row)["rows"] > 1).isEmpty():
        once = Window.partitionBy(own, "doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
        joined = joined.withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1).drop(copy)
    return joined.drop(own)
