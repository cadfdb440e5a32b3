"""Near duplicates by word n-grams: an exact Jaccard join with token-combination prefixes.

A document is the set of its word shingles, each a 64-bit hash.  Equal sets are one node.  If two
sets reach the threshold, at most tau shingles of either are missing in the other, so the tau + 1
shingles that come first in any common order (the prefix) contain a shared one.

* Sizes are cut into bands of doubling size; sets meet in the band of the larger one.
* First pass, order by hash: each node indexes the shingles of its prefix one by one.  Lists of at
  most ``FREQUENT`` nodes give candidate pairs; longer lists only name their shingle as frequent.
* Second pass, for nodes whose prefix held a frequent shingle: rare shingles come before frequent
  ones, the prefix is extended, rare shingles are indexed alone and frequent ones as combinations
  of two inside classes.  Of c shingles of a class c - 1 count towards tau + 1: if fewer than that
  many are missing, some class keeps two that both nodes index.  A pair of which one node never
  met a frequent shingle shares an infrequent one already in the first pass.
* Candidates are cut by two exact bounds on the overlap (the shared part of the hash order up to
  the shorter first prefix; parity bitmaps of a few bits a shingle), then verified on whole sets.

Links are verified in rounds, each against few centres: first every node with its best partner,
then candidate pairs that are still in different components, last what long lists still hold apart.
That is compared by bitmaps, in passes: equal lists once; list by list where that is fewer pairs, else
all lists that share nodes together, in blocks.  First each block names a forest of the pairs that
pass, then every node its nearest partners in other components, eight times as many in each pass,
until no pair was left out between components.  Pairs inside a component need no verification, so a
large group of near copies costs a few comparisons a member, and yet no link between components is
missed.  Only pairs that pass the bitmaps and prove to be no links are all verified.

Bounds: the frequent shingles sent to the tasks are at most ``MOST_FREQUENT`` (the most frequent
ones; any other stays indexed alone, which is right but slower).  Groups of the verification hold
about ``BLOCK_SHINGLES`` shingles; larger ones are salted.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are their own
component; a null doc_id takes part but never names a component with ids; rows that repeat a text
are one node; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import drop_stage, release, stage
from .common import buckets_for, unused
from .components import connected_components
from .shingles import mix, shingle_set, texts_as_bytes

FREQUENT = 16
MOST_FREQUENT = 1 << 20
BLOCK_SHINGLES = 1 << 20
#: Candidate documents whose ids may be broadcast; beyond that the texts are joined by a shuffle.
SMALL_SIDE = 1_000_000
#: Bitmaps in one block of the comparison of long lists.
BLOCK_NODES = 8192
#: Partners that a node of long lists names in the second pass; eight times as many in each further one.
PARTNERS = 8
#: Nodes of a list whose pairs are listed as they are, and pairs so listed by one task; longer lists are blocks.
LIST_NODES, LIST_PAIRS = 1024, 1 << 20
#: Nodes that share a part of the inverted index.
PART_NODES = 8192
_U = np.uint64


def _missing(n: int, t: Fraction) -> int:
    """How many shingles of a set of ``n`` may be missing in a linked one."""
    return n - -(-t.numerator * n // t.denominator)


def _bands(n: int, t: Fraction) -> list[int]:
    """The bands in which a set of ``n`` meets others: its own, and the next if a linked set can lie there."""
    own = n.bit_length() - 1
    return [own, own + 1] if t.denominator * n >= t.numerator << (own + 1) else [own]


def _signature(tokens: np.ndarray, band: int) -> np.ndarray:
    return mix(tokens ^ mix(np.full(1, band + 1, dtype=np.uint64)))


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(key: bytes) -> int:
    """Short name of a set; should two sets share one, both are verified."""
    return int.from_bytes(key[:8], "big", signed=True)


def _bitmap(tokens: np.ndarray) -> bytes:
    """The parity of the shingles on each of about three bits a shingle."""
    bits = max(64, 4 << (len(tokens).bit_length() - 1))
    return np.packbits((np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(bitmap: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bits for the same set."""
    while len(bitmap) > width:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def _differ(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    width = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())


def _frequent(signatures: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, signatures), len(known) - 1)
    return known[at] == signatures


def combination_prefix(tokens: np.ndarray, band: int, t: Fraction, known: np.ndarray) -> np.ndarray:
    """Signatures of the extended prefix: rare shingles alone, frequent ones in twos."""
    need = _missing(len(tokens), t) + 1
    own = _signature(tokens, band)
    common = _frequent(own, known)
    rare, often = own[~common], own[common]
    if len(rare) >= need:
        return rare[:need]
    least = -(-t.numerator << band) // t.denominator  # the smallest set of this band
    classes = max(1, _missing(max(least, 1), t) // 8)
    kind = (often % _U(classes)).astype(np.int64)
    # a shingle counts unless it is the first of its class
    counts = np.ones(len(often), dtype=np.int64)
    counts[np.unique(kind, return_index=True)[1]] = 0
    end = int(np.searchsorted(np.cumsum(counts), need - len(rare))) + 1
    often, kind = often[:end], kind[:end]
    out = [rare]
    for k in range(classes):
        members = often[kind == k]
        i, j = np.triu_indices(len(members), 1)
        out.append(mix(mix(np.minimum(members[i], members[j])) + np.maximum(members[i], members[j])))
    return np.concatenate(out)


def _index(docs: DataFrame, words: int, t: Fraction, parts: int) -> DataFrame:
    """First pass.  Rows with ``doc_id`` describe documents; rows with ``part`` hold packed
    (signature, node) entries of one part of the index."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("last", pa.int64()), ("bitmap", pa.binary()), ("part", pa.int64()), ("entries", pa.binary())])

    def flush(signatures: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not signatures:
            return
        s, v = np.concatenate(signatures), np.concatenate(nodes)
        order = np.lexsort((v, s))
        s, v = s[order], v[order]
        # a list longer than FREQUENT is only named later on, so one entry more is all it needs
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
        s, v = s[rank <= FREQUENT], v[rank <= FREQUENT]
        part = (s % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        s, v, part = s[order], v[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [np.stack([a.view(np.int64), b]).tobytes() for a, b in zip(np.split(s, starts[1:]), np.split(v, starts[1:]))]
        none = pa.nulls(len(starts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(starts), pa.binary()), none, none, pa.nulls(len(starts), pa.binary()), pa.array(part[starts]), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, nodes, held, seen = [], [], 0, set()
        for batch in batches:
            rows = []
            for doc_id, text_hash, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_as_bytes(batch.column(1))):
                tokens = shingle_set(raw, words)
                if not len(tokens):
                    rows.append((doc_id, text_hash, 0, None, None, None, None))
                    continue
                key = _key(tokens)
                node, prefix = _node(key), tokens[: _missing(len(tokens), t) + 1]
                rows.append((doc_id, text_hash, len(tokens), key, node, int(prefix[-1:].view(np.int64)[0]), _bitmap(tokens)))
                if key not in seen:
                    seen.add(key)
                    for band in _bands(len(tokens), t):
                        signatures.append(_signature(prefix, band))
                        nodes.append(np.full(len(prefix), node, dtype=np.int64))
                        held += len(prefix)
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)] + [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], schema=schema
            )
            if held > 1 << 20:
                yield from flush(signatures, nodes)
                signatures, nodes, held = [], [], 0
        yield from flush(signatures, nodes)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, key binary, node bigint, last bigint, bitmap binary, part bigint, entries binary")


def _lists(index: DataFrame) -> DataFrame:
    """The inverted index by parts: candidate pairs (a, b, shared), and frequent signatures as
    (a, null, nodes)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in rows["entries"]], axis=1)
        order = np.lexsort((both[1], both[0]))
        s, v = both[0][order], both[1][order]
        new = np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1]))
        s, v = s[new], v[new]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        length = np.diff(np.append(starts, len(s)))
        many = length > FREQUENT
        a, b = [], []
        for size in range(2, FREQUENT + 1):
            first = starts[length == size]
            i, j = np.triu_indices(size, 1)
            a.append(v[first[:, None] + i].ravel())
            b.append(v[first[:, None] + j].ravel())
        pairs = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).groupby(["a", "b"], as_index=False).size().rename(columns={"size": "w"})
        often = pd.DataFrame({"a": s[starts[many]], "b": pd.Series([None] * int(many.sum()), dtype="Int64"), "w": length[many]})
        return pd.concat([pairs.astype({"b": "Int64"}), often])[["a", "b", "w"]]

    return index.where("part is not null").select("part", "entries").groupBy("part").applyInPandas(run, "a bigint, b bigint, w bigint")


def _extended(docs: DataFrame, words: int, t: Fraction, known: np.ndarray) -> DataFrame:
    """Second pass: (node, often, signatures) of the nodes whose first prefix holds a frequent
    shingle; ``often`` is how many it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, often, found = [], [], []
            for raw in texts_as_bytes(batch.column(0)):
                tokens = shingle_set(raw, words)
                prefix = tokens[: _missing(len(tokens), t) + 1] if len(tokens) else tokens
                bands = _bands(len(tokens), t) if len(tokens) else []
                most = max((int(_frequent(_signature(prefix, band), shared.value).sum()) for band in bands), default=0)
                if not most:
                    continue
                node = _node(_key(tokens))
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    often.append(most)
                    found.append(np.concatenate([combination_prefix(tokens, band, t, shared.value) for band in bands]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(often, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "often", "signatures"])

    return docs.select("text").mapInArrow(run, "node bigint, often bigint, signatures array<bigint>")


def _plain(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(node, signature) of the first prefix of every node, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for raw in texts_as_bytes(batch.column(0)):
                tokens = shingle_set(raw, words)
                if len(tokens):
                    prefix = tokens[: _missing(len(tokens), t) + 1]
                    nodes.append(_node(_key(tokens)))
                    found.append(np.concatenate([_signature(prefix, band) for band in _bands(len(tokens), t)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "signatures"])

    return docs.select("text").mapInArrow(run, "node bigint, signatures array<bigint>").select("node", F.explode("signatures").alias("signature"))


def _verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The links among ``pairs`` (a, b), as sets' keys.  All partners of a centre ``a`` meet it in
    blocks of bounded size; a centre with many partners is repeated, once a block."""
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n"), "b")
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    partners = pairs.join(blocks, "a").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.pmod(F.hash("b"), "blocks").alias("block"), F.lit(False).alias("is_centre"))
    centres = blocks.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_centre"))
    roles = partners.unionByName(centres).join(nodes.select("node", "doc_id"), "node")
    side = stage(roles.select(F.col("doc_id").alias("rep"), "node", "centre", "block", "is_centre"))
    if side.count() <= SMALL_SIDE:
        side = F.broadcast(side)
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("rep")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last = [], (None, None, None)
            own = zip(*(batch.column(k).to_pylist() for k in range(1, 5)))
            for (node, centre, block, is_centre), raw in zip(own, texts_as_bytes(batch.column(0))):
                if last[0] is None or len(last[0]) != len(raw) or not np.array_equal(last[0], raw):
                    tokens = shingle_set(raw, words)
                    last = (raw, tokens, _key(tokens))
                if last[2] and _node(last[2]) == node:
                    rows.append((centre, block, is_centre, last[2], last[1].tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["centre", "block", "is_centre", "key", "tokens"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = {k: np.frombuffer(x, dtype=np.uint64) for k, x in zip(rows["key"], rows["tokens"])}
        links = []
        for own in set(rows["key"][rows["is_centre"]]):
            for other in set(rows["key"]) - {own}:
                x, y = sets[own], sets[other]
                most = min(len(x), len(y))
                if t.denominator * most < t.numerator * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if t.denominator * both >= t.numerator * (len(x) + len(y) - both):
                    links.append((own, other))
        return pd.DataFrame(links, columns=["a", "b"])

    cut_up = texts.select("text", "node", "centre", "block", "is_centre").mapInArrow(cut, "centre bigint, block int, is_centre boolean, key binary, tokens binary")
    return cut_up.groupBy("centre", "block").applyInPandas(compare, "a binary, b binary")


def _possible(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b, w) that can reach the threshold.  Of the two first prefixes the one that
    ends earlier in hash order has all its shingles up to there missing in the other set, but for
    the shared ones: ``w`` from short lists, and at most as many frequent ones as both hold.  And
    the parity bitmaps of two sets differ in no more bits than the sets in shingles."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "last", "often")])
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    n = F.when(unsigned("last_a") <= unsigned("last_b"), F.col("n_a")).otherwise(F.col("n_b"))
    missing = n - F.ceil(n * t.numerator / F.lit(float(t.denominator))) + 1 - (F.col("w") + F.least("often_a", "often_b"))
    fits = (n - missing) * (t.numerator + t.denominator) >= (F.col("n_a") + F.col("n_b")) * t.numerator
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "w", (F.col("n_a") + F.col("n_b")).alias("both"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, both: pd.Series) -> pd.Series:
        apart = np.array([_differ(x, y) for x, y in zip(a, b)], dtype=np.int64)
        return pd.Series((t.numerator + t.denominator) * (both.to_numpy() - apart) >= 2 * t.numerator * both.to_numpy())

    maps = lambda x: nodes.select(F.col("node").alias(x), F.col("bitmap").alias(f"map_{x}"))
    mapped = likely.join(maps("a"), "a").join(maps("b"), "b")
    return mapped.where(near("map_a", "map_b", "both")).select("a", "b", "w").distinct()


def _placed(some: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n, bitmap, root): ``some`` of the nodes, each with a short name of its component."""
    named = nodes.select("key", F.col("number").alias("root"))
    own = some.select("key", "node", "n", "bitmap").withColumnRenamed("key", "own").join(roots, F.col("own") == F.col("a"), "left").withColumn("top", F.coalesce("b", "own")).select("node", "n", "bitmap", "top")
    return own.join(named, F.col("top") == F.col("key")).select("node", "n", "bitmap", "root")


def _hoods(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, hood, part) of the nodes in lists that span components; of equal lists one is kept.  Lists that
    share nodes are one neighbourhood; where its lists hold fewer pairs than all its nodes, each of them
    is a hood of its own, and the short ones are dealt over parts."""
    open_ = stage(postings.join(placed.select("node", "root"), "node").groupBy("signature").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("signature"))
    held = stage(postings.join(open_, "signature").select("signature", "node", F.col("a").alias("first")).distinct())
    own = held.groupBy("signature", "first").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    lists = stage(own.groupBy("first", "c", "x", "y").agg(F.min("signature").alias("signature")).select("signature", "first", "c"))
    edges = stage(held.join(lists.select("signature"), "signature"))
    joined = connected_components(edges.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    of = stage(edges.select("node").distinct().join(joined, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("hood")))
    placed_lists = lists.join(of.withColumnRenamed("node", "first"), "first")
    pairs = placed_lists.groupBy("hood").agg(F.sum(F.col("c") * F.col("c")).alias("listed"))
    sizes = of.groupBy("hood").agg(F.count("*").alias("nodes")).join(pairs, "hood").withColumn("apart", F.col("listed") < F.col("nodes") * F.col("nodes"))
    chosen = stage(placed_lists.join(sizes.select("hood", "apart"), "hood"))
    whole = of.join(chosen.where("not apart").select("hood").distinct(), "hood").select("node", "hood", F.lit(None).cast("long").alias("part"))
    listed = chosen.where("apart").select("signature", "c")
    work = listed.where(F.col("c") <= LIST_NODES).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
    part = F.when(F.col("c") <= LIST_NODES, F.pmod(F.xxhash64("signature"), F.lit(-(-work // (2 * LIST_PAIRS)) or 1)))
    return whole.unionByName(edges.join(listed, "signature").select("node", F.col("signature").alias("hood"), part.cast("long").alias("part")))


def _pairs_of_lists(rows: pd.DataFrame, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """The distinct pairs (x, y, apart) of nodes that are in one list, in different components, and that
    sizes and bitmaps allow, and the nodes they are places of."""
    nodes = rows.drop_duplicates("node").reset_index(drop=True)
    n, root = nodes["n"].to_numpy(), nodes["root"].to_numpy()
    at = pd.Series(np.arange(len(nodes)), index=nodes["node"]).loc[rows["node"]].to_numpy()
    order = np.argsort(rows["hood"].to_numpy(), kind="stable")
    hood, at = rows["hood"].to_numpy()[order], at[order]
    starts = np.flatnonzero(np.append(True, hood[1:] != hood[:-1]))
    length = np.diff(np.append(starts, len(hood)))
    keys = [np.zeros(0, dtype=np.int64)]
    for size in np.unique(length[length > 1]):
        first = starts[length == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, LIST_PAIRS // len(i))
        for k in range(0, len(first), step):
            x, y = at[first[k : k + step, None] + i].ravel(), at[first[k : k + step, None] + j].ravel()
            x, y = np.minimum(x, y), np.maximum(x, y)
            fits = (root[x] != root[y]) & (t.denominator * np.minimum(n[x], n[y]) >= t.numerator * np.maximum(n[x], n[y]))
            keys.append(np.unique(x[fits] * len(nodes) + y[fits]))
    keys = np.unique(np.concatenate(keys))
    x, y = np.divmod(keys, max(len(nodes), 1))
    width = nodes["bitmap"].map(len).to_numpy()
    least, apart = np.minimum(width[x], width[y]), np.zeros(len(keys), dtype=np.int64)
    for w in np.unique(least):
        some = np.flatnonzero(least == w)
        used, place = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
        maps = np.stack([_fold(np.frombuffer(nodes["bitmap"][k], dtype=np.uint8), int(w)) for k in used]).view(np.uint64)
        left, right = np.split(place, 2)
        step = max(1, (1 << 23) // int(w))
        for k in range(0, len(some), step):
            apart[some[k : k + step]] = np.bitwise_count(maps[left[k : k + step]] ^ maps[right[k : k + step]]).sum(axis=1, dtype=np.int64)
    both = n[x] + n[y]
    near = (t.numerator + t.denominator) * (both - apart) >= 2 * t.numerator * both
    return x[near], y[near], apart[near], nodes


def _named(x: np.ndarray, y: np.ndarray, apart: np.ndarray, nodes: pd.DataFrame, partners: int) -> list[tuple[int, int]]:
    """Of pairs the nearest ``partners`` of each node or, for 0, a forest over all components they connect, and
    a pair (a, a) for each node of which pairs were left out."""
    node, root = nodes["node"].tolist(), nodes["root"].tolist()
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := top.get(r, r)) != r:
            r = up
        return r

    found, named, left_out = [], [0] * len(nodes), set()
    for k in np.argsort(apart, kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        r, s = find(root[i]), find(root[j])
        if min(named[i], named[j]) < partners if partners else r != s:
            top[max(r, s)] = min(r, s)
            named[i], named[j] = named[i] + 1, named[j] + 1
            found.append((min(node[i], node[j]), max(node[i], node[j])))
        else:
            left_out |= {node[i], node[j]}
    return found + [(v, v) for v in left_out]


def _across(members: DataFrame, placed: DataFrame, t: Fraction, partners: int) -> DataFrame:
    """Pairs (a, b) of different components in one neighbourhood that their bitmaps allow, and a pair
    (a, a) for each node of which pairs were left out.

    The nodes of a neighbourhood are compared band by band in blocks: each task gets two blocks of at
    most about ``BLOCK_NODES`` bitmaps, so neither pairs nor a whole neighbourhood are ever rows of
    one task.  Of the pairs that pass, a task names so many that grow with its nodes only: the nearest
    ``partners`` of each node or, for 0, a forest over all components that pairs connect.  Of short lists
    a task gets whole ones, lists their pairs and names among these in the same way."""

    def compare_lists(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_named(*_pairs_of_lists(rows, t), partners), columns=["a", "b"], dtype="int64")

    listed = members.where("part is not null").join(placed, "node").groupBy("part").applyInPandas(compare_lists, "a bigint, b bigint")
    members = members.where("part is null").drop("part")
    band = F.length(F.bin("n")) - 1
    higher = F.col("n") * t.denominator >= F.expr(f"shiftleft({t.numerator}L, length(bin(n)))")
    banded = members.join(placed, "node").withColumn("band", F.explode(F.when(higher, F.array(band, band + 1)).otherwise(F.array(band))))
    sizes = banded.groupBy("hood", "band").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").drop("r", "s")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        banded.join(sizes, ["hood", "band"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hood", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", "bitmap")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        width = min(map(len, rows["bitmap"]))
        maps = np.stack([_fold(np.frombuffer(x, dtype=np.uint8), width) for x in rows["bitmap"]]).view(np.uint64)
        n, node, root = rows["n"].to_numpy(), rows["node"].to_numpy(), rows["root"].to_numpy()
        left = np.flatnonzero(rows["block"] == rows["i"])
        right = np.flatnonzero(rows["block"] == rows["j"])
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        tree, left_out = np.unique(root, return_inverse=True)[1], np.zeros(len(rows), dtype=bool)
        found = []
        for k, x in enumerate(left):
            others = right[k + 1 :] if same else right
            both = n[x] + n[others]
            apart = np.bitwise_count(maps[x] ^ maps[others]).sum(axis=1, dtype=np.int64)
            fits = ((t.numerator + t.denominator) * (both - apart) >= 2 * t.numerator * both) & (root[others] != root[x])
            if not fits.any():
                continue
            others = others[fits][np.argsort(apart[fits], kind="stable")]
            if partners:
                named = others[:partners]
            else:
                met, first = np.unique(tree[others], return_index=True)
                named = others[first[met != tree[x]]]
                tree[np.isin(tree, met)] = tree[x]
            if len(named) < len(others):
                left_out[x] = left_out[np.setdiff1d(others, named)] = True
            found += [(min(node[x], node[y]), max(node[x], node[y])) for y in named]
        found += [(x, x) for x in node[left_out]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("hood", "band", "i", "j").applyInPandas(compare, "a bigint, b bigint").unionByName(listed).distinct()


def _apart(pairs: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    where = nodes.join(roots, nodes["key"] == roots["a"], "left").select("node", F.coalesce("b", "key").alias("root"))
    return (
        pairs.join(where.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a")
        .join(where.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b")
        .where("_ra <> _rb")
        .select("a", "b")
        .distinct()
    )


def link_components(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key, text_hash, root): the components of documents
    whose shingle sets have a Jaccard similarity of ``threshold`` or more; ``root`` names a
    component, null where a document has no words."""
    t = Fraction(threshold)
    if not Fraction(1, 2) <= t <= 1:
        raise ValueError("the threshold must lie between 1/2 and 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = stage(_index(docs, words, t, buckets_for(docs.count(), PART_NODES)))
    rows = index.where("part is null")
    found = stage(rows.select("doc_id", "text_hash", "n", "key"))
    nodes = stage(rows.where("n > 0").groupBy("key", "node", "n", "last").agg(F.min("doc_id").alias("doc_id"), F.min("bitmap").alias("bitmap"), F.lit(0).cast("long").alias("often")).withColumn("number", F.monotonically_increasing_id()))
    lists = stage(_lists(index))
    drop_stage(index)
    release(docs.sparkSession)
    pairs = lists.where("b is not null").groupBy("a", "b").agg(F.sum("w").alias("w"))
    named = lists.where("b is null")
    often = stage(named.orderBy(F.desc("w"), "a").limit(MOST_FREQUENT).select("a"))
    known = np.sort(np.array([r.a for r in often.collect()], dtype=np.int64).view(np.uint64))

    candidates, postings = pairs, None
    if len(known):
        extended = stage(_extended(docs, words, t, known))
        plain, nodes = nodes, stage(nodes.drop("often").join(extended.groupBy("node").agg(F.max("often").alias("often")), "node", "left").fillna(0, ["often"]))
        drop_stage(plain)
        release(docs.sparkSession)
        postings = extended.select("node", F.explode("signatures").alias("signature"))
        if named.count() > MOST_FREQUENT:
            # shingles beyond the bound stay indexed alone, as lists of any length; how many of
            # them a prefix holds is not counted, so no pair is cut by the overlap bound
            others = named.join(often, "a", "left_anti").select(F.col("a").alias("signature"))
            postings = postings.unionByName(_plain(docs, words, t).join(others, "signature", "left_semi"))
            nodes = nodes.withColumn("often", F.col("n"))
        # only lists of two nodes or more matter from here on; most signatures have one
        centres = postings.groupBy("signature").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("signature", "a")
        centres = stage(centres)
        postings = stage(postings.join(centres, "signature"))
        drop_stage(extended)
        drop_stage(centres)
        release(docs.sparkSession)
        stars = postings.where("node <> a").select("a", F.col("node").alias("b"), F.lit(0).cast("long").alias("w"))
        candidates = pairs.unionByName(stars.distinct()).groupBy("a", "b").agg(F.max("w").alias("w"))
    candidates = stage(_possible(candidates, nodes, t))
    drop_stage(lists)
    release(docs.sparkSession)

    # round 1: every node with the partner it shares most with
    best = candidates.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b")
    links = stage(_verify(docs, best, nodes, words, t))
    roots = connected_components(links)
    release(docs.sparkSession)
    # round 2: candidates still apart
    rest = stage(_apart(candidates, nodes, roots))
    if not rest.isEmpty():
        links = links.unionByName(stage(_verify(docs, rest, nodes, words, t)))
        roots = connected_components(links)
    release(docs.sparkSession)
    # round 3: lists of the second pass that still span components.  A pass verifies some pairs of each
    # node; the next one looks at nodes of which pairs were left out, where they are still apart
    if postings is not None:
        placed, partners, tested = stage(_placed(nodes, nodes, roots)), 0, candidates.select("a", "b")
        members = stage(_hoods(postings, placed))
        while not members.isEmpty():
            compared = stage(_across(members, placed, t, partners))
            across = stage(compared.where("a <> b").join(tested, ["a", "b"], "left_anti"))
            before = [placed, members, compared]
            members = stage(members.join(compared.where("a = b").select(F.col("a").alias("node")), "node", "left_semi"))
            if not across.isEmpty():
                links = links.unionByName(stage(_verify(docs, across, nodes, words, t)))
                roots = connected_components(links)
            tested, partners = tested.unionByName(across), max(PARTNERS, 8 * partners)
            placed = stage(_placed(nodes.join(members, "node", "left_semi"), nodes, roots))
            for done in before:
                drop_stage(done)
            release(docs.sparkSession)
        for done in (placed, members):
            drop_stage(done)
    release(docs.sparkSession)
    member = nodes.join(roots, nodes["key"] == roots["a"], "left").select("key", "doc_id", F.coalesce("b", "key").alias("root"))
    named = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = stage(member.join(named, "root").select("key", "component_id", "root"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("set_key"), "text_hash", "root"]
    named = found.where("n > 0").join(classes, "key").select(*columns)
    empty = found.where("n = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("binary")}).select(*columns)
    return named.unionByName(empty)


def keep_one_each(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents of which one of each component stays: the one with the smallest doc_id; of
    several with that id, or without ids, the one with the least shingle set and text hash.
    Documents without words are no copies of anything and all stay."""
    own, row, copy = (unused(docs, name) for name in ("own_hash", "kept_row", "copy_number"))
    linked = stage(link_components(docs, words, threshold))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_key", "text_hash")
    first = linked.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
    stay = stage(
        linked.where("n_shingles > 0").join(first.withColumnsRenamed({"doc_id": "i", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
        .groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
        .unionByName(linked.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(0).cast("long").alias("rows")).distinct())
        .select(F.struct("doc_id", "text_hash", "rows").alias(row))
    )
    drop_stage(linked)
    keyed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay[row]["doc_id"]) & (keyed[own] == stay[row]["text_hash"]))
    if not stay.where(F.col(row)["rows"] > 1).isEmpty():
        once = Window.partitionBy(own, "doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
        joined = joined.withColumn(copy, F.when(F.col(row)["rows"] > 1, F.row_number().over(once)).otherwise(1)).where(F.col(copy) == 1).drop(copy)
    return joined.drop(own, row)
