"""Mixing against plain Python, and its promises on awkward tables."""

import hashlib
import re

import pytest

from shelflink.llm import mixing as M


def plain(rows, repeats=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in sources}
    target, open_, budget = {}, set(sources), sum(total.values())
    while open_:
        share = budget - sum(target.values())
        over = [s for s in open_ if weight[s] * share / sum(weight[x] for x in open_) > repeats * total[s]]
        for s in over or open_:
            target[s] = repeats * total[s] if over else weight[s] * share / sum(weight[x] for x in open_)
        open_ -= set(over or open_)
    passes, served = [], {}
    for s in sources:
        run = 0
        own = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], z) for z, r in zip(size, rows) if r[2] == s)
        for _, doc_id, z in own:
            run += z
            served[doc_id] = run
            passes += [((run + e * total[s]) / target[s], doc_id, z) for e in range(repeats) if z]
    taken, words = dict.fromkeys(served, 0), 0
    for time, doc_id, z in sorted(passes):
        if words + z > budget:
            break
        words += z
        taken[doc_id] += z
    return target, taken


def corpus():
    rows = [(k, " ".join("w" * (k % 5 + 1) for _ in range(k % 37)), "big" if k % 3 == 0 else f"s{k % 11}") for k in range(600)]
    return rows + [(1000, "a b c", None), (1001, None, "s1"), (1002, "", None), (1003, "lone word", "Z"), (1004, "word " * 3000, "ä")]


def test_mix_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 32)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, size int")
    target, taken = plain(rows)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == taken[r.doc_id] and r.taken <= 3 * r.size
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    order = [r.doc_id for r in mixed.collect()]
    assert len(order) == sum(r.copies for r in got) and len({*order}) == sum(r.copies > 0 for r in got)


def test_small_and_empty_tables(spark):
    kind = "doc_id bigint, text string, source string"
    assert M.mix(spark.createDataFrame([], kind)).collect() == []
    blank = M.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], kind)).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0)] * 2
    twice = M.mix(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c d", "x")], kind)).collect()
    assert sorted((r.doc_id or 0, r.rows, r.taken) for r in twice) == [(0, 1, 2), (1, 2, 2)]


def test_columns_of_any_name_stay(spark):
    rows = [(k, f"word {k} and more", "s", 8, "mine", 0.5) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _size int, place string, _id double")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and {r._size for r in out.collect()} == {8} and {r.place for r in out.collect()} == {"mine"}
