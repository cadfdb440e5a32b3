"""Exact dedup against a plain grouping, with a digest that collides, and the fuse filter."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflink.llm import exact_dedup as D
from shelflink.llm.fuse_filter import build, contains

ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (1, "a b "), (7, None), (6, ""), (4, "x" * 200_000), (2, "x" * 200_000), (8, "X"),
    (10, "b a"), (11, "b\n\na"), (3, "a b"), (None, "a b"), (None, "lonely"), (12, " "), (13, "\x0b"), (14, "a b"),
]


def plain(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        stays = [True] if keep is not None or ids else []
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and bool(stays)
            if kept:
                stays = []
            out.append((i, keep, len(ids), kept))
    return sorted(out, key=repr)


def weak(text):
    """A digest that only sees whether a text starts with an x or a blank."""
    return F.sha2(F.translate(F.substring(text, 1, 1), "aAbBlLX", "ccccccc").cast("binary"), 256)


@pytest.mark.parametrize("digest", [D.sha256, weak])
def test_groups(spark, digest):
    docs = spark.createDataFrame([(*r, "extra") for r in ROWS], "doc_id bigint, text string, digest string")
    got = D.deduplicate(docs, digest)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == plain(ROWS)
    kept = D.keep_documents(docs, digest)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in plain(ROWS) if x[3]), key=repr)


def test_filter_screens_a_second_batch_and_empty_table(spark):
    old = D.build_snapshot(D.group(D.digests(spark.createDataFrame([(i, f"old {i}") for i in range(3000)], "doc_id bigint, text string"))))
    new = D.group(D.digests(spark.createDataFrame([(i, f"{'old' if i % 3 else 'new'} {i}") for i in range(3000)], "doc_id bigint, text string")))
    passed = D.screen(new, old).count()
    assert 2000 <= passed <= 2030
    matched = D.match(new, [old])
    assert matched.where("old_rows > 0").count() == 2000 and matched.count() == 3000
    assert D.deduplicate(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 5000])
def test_fuse_filter_never_misses(n):
    rng = np.random.default_rng(n)
    keys, others = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, 20_000))
    data = build(np.concatenate([keys, keys]))
    assert contains(data, keys).all()
    assert contains(data, others).mean() < 0.01 and len(data) < 64 + 2 * n


def test_kept_documents_keep_columns_of_any_name(spark):
    rows = [(1, "a b", "x", 3), (2, "a  b", "y", 4), (2, "a  b", "y", 4), (3, "c", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _own string, own_digest int")
    out = D.keep_documents(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b", "x", 3), (3, "c", "z", 5)]
