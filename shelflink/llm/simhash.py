"""SimHash near duplicates by an inverted index over byte positions, with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions.  Two fingerprints that differ in at
most b <= 4 bits differ in at most b bytes, so they share at least 8 - b positional bytes.  That
guaranteed minimum makes the index selective: among any four of the eight positions there is one
of twenty fixed triples (``TRIPLES``), so linked fingerprints share all three bytes of some
triple.  Each distinct fingerprint is posted under its twenty triples (24-bit keys instead of
2048 lists of single bytes); inside a list the shared positional bytes of a pair are tallied,
pairs below the minimum are dropped, the rest is verified by counting differing bits.

Scale: only distinct fingerprints are posted, so any number of copies is one posting.  A list of
up to ``LONGEST`` fingerprints is compared in one task beside many others (parts are sized by
entries).  Longer lists, such as those of a large group of near copies, are cut into blocks and
every two blocks meet in a group of their own, so no list is ever one task.  A long list returns
the links of a spanning forest, not its pairs: each fingerprint is a source once and is compared
with what no source has reached yet, so dense groups cost little more than their size and no
connection is lost.  Nothing but the number of fingerprints reaches the driver.

Edge cases: null, empty and blank texts have no words and the fingerprint zero, which links like
any other; with fewer words than a shingle the whole sequence is one; a text of any length is
hashed whole, its hashes are counted in pieces; a null doc_id takes part but names no component
that holds an id; repeated rows each return their row; a bit set in exactly half the hashes (a
tie) is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stage
from .common import buckets_for
from .components import connected_components
from .shingles import texts_as_bytes

BYTES = 8
#: Longest list that is compared beside others, and fingerprints in a block of longer ones.
LONGEST = 4096
#: Lists up to this length return their linked pairs, longer ones a spanning forest.
PAIRED = 16
#: Postings in one part of the index.
PART_ENTRIES = 1 << 16
_PIECE = 1 << 16


def _triples() -> list[tuple[int, ...]]:
    """Twenty triples of positions of which every four positions contain one: positions fall into
    three classes, a triple lies in one class or has two positions there and one in the next."""
    out = []
    for triple in combinations(range(BYTES), 3):
        low, pair, high = sorted(p % 3 for p in triple)
        single = high if low == pair else low
        if low == high or pair in (low, high) and single == (pair + 1) % 3:
            out.append(triple)
    return out


TRIPLES = _triples()


def fingerprint(raw: bytes, words: int, seed: int) -> int:
    """Bit k is 1 if it is set in more than half of the hashes of the shingles, repeats included."""
    found = raw.lower().split()
    if not found:
        return 0
    text = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(text, seed)
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(length) + np.arange(len(found))
    begin = (end - length)[: len(found) - words + 1].tolist()
    end = end[words - 1 :].tolist()
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(end), _PIECE):
        pieces = map(text.__getitem__, map(slice, begin[k : k + _PIECE], end[k : k + _PIECE]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(end), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, print): one row a document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(raw.tobytes(), words, seed) for raw in texts_as_bytes(batch.column(1))]
            signed = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs are linked: shared positional bytes are tallied first, the rest is verified."""
    apart = np.ascontiguousarray(a ^ b)
    shared = (apart.view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(axis=-1)
    linked = shared >= BYTES - bits
    linked[linked] = np.bitwise_count(apart[linked].view(np.uint64)) <= bits
    return linked


def _forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct fingerprints."""
    a, b, rest = [], [], prints
    while len(rest) > 1:
        sources, rest = [rest[0]], rest[1:]
        while sources and len(rest):
            source = sources.pop()
            hit = _close(rest, source, bits)
            reached = rest[hit]
            if len(reached):
                a.append(np.full(len(reached), source))
                b.append(reached)
                sources.extend(reached)
                rest = rest[~hit]
    none = prints[:0]
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _list_links(prints: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the lists that begin at ``starts``; equal lengths are compared together."""
    length = np.diff(np.append(starts, len(prints)))
    a, b = [prints[:0]], [prints[:0]]
    for size in np.unique(length[length > 1]):
        rows = prints[starts[length == size][:, None] + np.arange(size)]
        if size <= PAIRED:
            i, j = np.triu_indices(size, 1)
            x, y = rows[:, i], rows[:, j]
            linked = _close(x, y, bits)
            a.append(x[linked])
            b.append(y[linked])
        else:
            for row in rows:
                x, y = _forest(row, bits)
                a.append(x)
                b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def links(prints: DataFrame, bits: int = 4, longest: int = LONGEST) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``print``; those of a long list are a
    spanning forest of it."""
    if not 0 <= bits <= 4:
        raise ValueError("twenty triples of positions cover at most 4 differing bits")
    masks = [sum(0xFF << (8 * p) for p in triple) for triple in TRIPLES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("triple"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]))
    postings = prints.select("print", keyed.alias("at")).select("print", "at.triple", "at.key")
    long_lists = stage(postings.groupBy("triple", "key").agg(F.count("*").alias("length")).where(F.col("length") > longest))
    parts = buckets_for(prints.count() * len(TRIPLES), PART_ENTRIES)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        triple, key, own = rows["triple"].to_numpy(), rows["key"].to_numpy(), rows["print"].to_numpy()
        order = np.lexsort((key, triple))
        triple, key, own = triple[order], key[order], own[order]
        new = np.append(True, (triple[1:] != triple[:-1]) | (key[1:] != key[:-1]))
        return _pairs(*_list_links(own, np.flatnonzero(new), bits))

    def compare_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        return _pairs(*_forest(rows["print"].to_numpy(), bits))

    placed = postings.join(long_lists, ["triple", "key"], "left")
    short = placed.where("length is null").select("print", "triple", "key", F.pmod(F.xxhash64("triple", "key"), F.lit(parts)).alias("part"))
    blocks = F.ceil(F.col("length") / longest)
    others = F.expr("filter(sequence(0L, blocks - 1), x -> x <> block)")
    dealt = (
        placed.where("length is not null")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("print"), "blocks"))
        .withColumn("other", F.explode(others))
        .select("triple", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print")
    )
    return (
        short.groupBy("part")
        .applyInPandas(compare, "a bigint, b bigint")
        .unionByName(dealt.groupBy("triple", "key", "i", "j").applyInPandas(compare_blocks, "a bigint, b bigint"))
    )


def near_components(docs: DataFrame, words: int = 4, seed: int = 42, bits: int = 4, longest: int = LONGEST) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id reachable over links of at most ``bits`` differing bits)."""
    found = stage(fingerprints(docs, words, seed))
    nodes = stage(found.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("print"), bits, longest))
    member = nodes.join(roots, F.col("print") == F.col("a"), "left").select("print", "least", F.coalesce("b", "print").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(member.join(named, "root").select("print", "component_id"))
    return found.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
