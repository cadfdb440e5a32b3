"""Connected components of an edge table by alternating large and small stars.

Each step is a minimum per node (pre-aggregated) and a join back, so no neighbourhood is ever
gathered: a node with a third of all edges is only a skewed join key.  Converges in a number of
rounds that grows with the logarithm of the longest path.  Before that the edges are read by tasks
of at most about ``PIECE_EDGES``, each of which replaces its own by stars of the same components: a
few thousand edges, whatever number of files they are in, are done then, without a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import drop_stage, stage


#: Edges that one task holds at a time.
PIECE_EDGES = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: every node with the least one it is connected to there."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def done(like: pa.Schema) -> pa.RecordBatch:
        ends = [(x, find(x)) for x in list(root) if find(x) != x]
        columns = list(zip(*ends)) if ends else [(), ()]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like)], schema=like)

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 2 * PIECE_EDGES:
            yield done(schema)
    if schema is not None:
        yield done(schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of an edge but the roots, with the least node of its component."""
    given = stage(edges.where("a <> b").select("a", "b").distinct())
    tasks = -(-given.count() // PIECE_EDGES)
    if not tasks:
        return given
    edges = stage(given.coalesce(tasks).mapInArrow(_stars, given.schema))
    drop_stage(given)
    if tasks == 1:
        return edges
    while not edges.isEmpty():
        # done when every node has one edge out, to a node without one
        ends = edges.select("a", F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out")))
        sides = ends.groupBy("a").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
        if sides.where("out > 1 or (out = 1 and least = 0)").isEmpty():
            break
        before, edges = edges, stage(_small_star(_large_star(edges).where("a <> b")).distinct())
        drop_stage(before)
    return edges
