"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a digest of their id.  A document's virtual finish
time is the number of words its source has served up to and including it, divided by the
source's target; each further pass over a source adds the source's whole size.  Sorted by
finish time, all sources advance in step with their targets, and the order is cut where the
words served reach the budget.

Both running sums are taken without a window over a whole source or corpus: rows are cut
into slices of the digest order (of the finish time), summed inside a slice, and shifted by
the sum of the slices before it.  A source with a third of all rows is spread like any other.

Edge cases: null text has no words; null source is a source of its own, last in the order;
a source without words has target 0 and is never taken; rows that repeat doc_id, source and
size are one block that is taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage
from .common import buckets_for, count_words, hash_bucket, text_of, unused

SLICE_ROWS = 4096


def weigh_by_rank(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, 1, 2, ... for sources by code point, null last.  One row a source."""
    rank = F.row_number().over(Window.orderBy("source_null", "source_key"))
    weights = F.array(*[F.lit(w) for w in cycle])
    return sizes.withColumn("weight", F.element_at(weights, (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int")))


def targets(sizes: DataFrame, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """Adds ``target`` to (source_size, weight): the budget shared by weight, no target above
    ``repeats`` times its source.  Sources sorted by cap per weight fill up in that order, so
    the excess is shared out in one pass over running sums of the (few) sources."""
    by_cap = Window.orderBy("cap_per_weight", "source_null", "source_key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * repeats
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = (
        sizes.withColumn("cap", cap)
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("open", F.when(F.col("cap_per_weight") >= F.col("level"), F.struct("place", "level")))
        .withColumn("first_open", F.min("open").over(every))
    )
    full = F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first_open.level"))
    return filled.withColumn("target", target).drop("cap", "cap_per_weight", "level", "place", "open", "first_open")


def _copies(cut: float | None, repeats: int) -> Column:
    taken = [F.when(F.col("finish")[e] <= F.lit(cut), 1).otherwise(0) for e in range(repeats)]
    return sum(taken[1:], taken[0])


def virtual_times(docs: DataFrame, share: float = 1.0, repeats: int = 3, weigh=weigh_by_rank) -> DataFrame:
    """One row for each distinct (doc_id, source, size) with its source's size and target and
    ``finish``, the finish time of each of its ``repeats`` passes."""
    sized = stage(
        docs.select("doc_id", "source", count_words(text_of()).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn("source_null", F.col("source").isNull())
        .withColumn("source_key", F.coalesce("source", F.lit("")))
        .withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    )
    slices = buckets_for(sized.count(), SLICE_ROWS)
    placed = sized.withColumn("slice", hash_bucket(F.col("digest"), slices))
    key = ["source_null", "source_key"]
    sums = placed.groupBy(*key, "slice").agg(F.sum("words").alias("slice_words"))
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("slice_words").over(before), F.lit(0))).drop("slice_words")
    sizes = sums.groupBy(*key).agg(F.sum("slice_words").alias("source_size"))
    shared = targets(weigh(sizes), share, repeats).select(*key, "source_size", "target", "budget")
    inside = Window.partitionBy(*key, "slice").orderBy("digest", "doc_id", "size")
    served = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")
    finish = F.array(*[(F.col("served") + e * F.col("source_size")) / F.col("target") for e in range(repeats)])
    return stage(
        placed.join(offsets.join(shared, key), [*key, "slice"])
        .withColumn("served", served)
        .withColumn("finish", F.when(F.col("target") > 0, finish))
        .select("doc_id", "source", "size", "rows", "words", "source_size", "target", "budget", "finish")
    )


def cut_time(times: DataFrame) -> float | None:
    """The largest finish time up to which all passes together fit into the budget."""
    slices = buckets_for(times.count(), SLICE_ROWS)
    passes = times.select("words", "budget", F.explode("finish").alias("time")).where("words > 0")
    passes = passes.withColumn("slice", F.floor(F.col("time") * slices).cast("long"))
    sums = passes.groupBy("slice").agg(F.sum("words").alias("words"), F.max("budget").alias("budget"), F.max("time").alias("last"))
    # one row a slice, so this window is small against the table
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("words").over(upto))
    edge = running.agg(
        F.max(F.when(F.col("upto") <= F.col("budget"), F.col("last"))).alias("cut"),
        F.min(F.when(F.col("upto") > F.col("budget"), F.struct("slice", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"),
    ).first()
    if edge.edge is None:
        return edge.cut
    # the one slice in which the budget ends, word by word; passes that end together stay together
    inside = Window.partitionBy("slice").orderBy("time")
    fits = F.sum("words").over(inside) + F.lit(edge.edge.before) <= F.col("budget")
    last = passes.where(F.col("slice") == edge.edge.slice).withColumn("fits", fits).where("fits").agg(F.max("time").alias("cut"))
    return max((c for c in (edge.cut, last.first().cut) if c is not None), default=None)


def mix(docs: DataFrame, share: float = 1.0, repeats: int = 3, weigh=weigh_by_rank) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies, taken, finish), one row for each
    distinct (doc_id, source, size): in how many passes the mix takes the document."""
    times = virtual_times(docs, share, repeats, weigh)
    copies = F.coalesce(_copies(cut_time(times), repeats), F.lit(0))
    return times.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).drop("words", "budget")


def mixed_documents(docs: DataFrame, share: float = 1.0, repeats: int = 3, weigh=weigh_by_rank) -> DataFrame:
    """The mixed corpus itself: documents repeated as often as they are taken, sorted over the
    whole corpus by virtual finish time."""
    own, place = unused(docs, "own_size"), unused(docs, "place")
    taken = mix(docs, share, repeats, weigh).where("copies > 0").withColumn("finish", F.explode(F.slice("finish", F.lit(1), F.col("copies"))))
    plan = taken.select(F.struct("doc_id", "source", "size", "finish").alias(place))
    sized = docs.withColumn(own, count_words(text_of()))
    same = sized["doc_id"].eqNullSafe(plan[place]["doc_id"]) & sized["source"].eqNullSafe(plan[place]["source"]) & (sized[own] == plan[place]["size"])
    return sized.join(plan, same).orderBy(F.col(place)["finish"], F.col(place)["doc_id"]).drop(own, place)
