"""Encoder against a full enumeration of the lattice, and exact round trips."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shelflink.llm import pieces as P

TOY = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca", "▁b"]


@pytest.fixture(scope="module")
def toy():
    rng = random.Random(5)
    scores = [-rng.uniform(1, 6) for _ in TOY]
    return P.Vocabulary(TOY + [None] * 256, scores + [-20.0] * 256, list(range(len(TOY), len(TOY) + 256)))


@pytest.fixture(scope="module")
def real():
    pytest.importorskip("public_tokenizers")
    return P.Vocabulary.load(P.default_model())


def every_path(v, text):
    """(score, ids) of all segmentations of a whole text, best first."""
    marked = "▁" + text.replace(" ", "▁")

    def paths(at):
        if at == len(marked):
            yield 0.0, ()
            return
        options = [(e, v.real(p), s) for e, p, s in v.edges(marked, at) if p >= 0]
        if not options:
            options = [(at + 1, [v.bytes_at[b] for b in marked[at].encode()], v.byte_score * len(marked[at].encode()))]
        for end, ids, score in options:
            for rest, more in paths(end):
                yield score + rest, (*ids, *more)

    return sorted(paths(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["abc", "ab ca", "abcabc ab", "  ab", "a\nb", "abc bc ab ca", "xay", "é abc", "c"])
@pytest.mark.parametrize("n", [1, 4, 9])
def test_n_best_equal_enumeration(toy, text, n):
    ids, ends, nbest = P.Encoder(toy, n).encode([text])
    want = every_path(toy, text)[:n]
    found = [(s, tuple(P.expand(ids.tolist(), changes))) for s, _, changes in nbest[0]]
    assert np.allclose([s for s, _ in found], [s for s, _ in want])
    assert len({x for _, x in found}) == len(found) and found[0][1] == want[0][1]
    assert {x for _, x in found} <= {x for _, x in every_path(toy, text)}


def test_search_equals_enumeration(toy):
    for text in ("abcab", "caabcbc"):
        unit = "▁" + text
        want = every_path(toy, text)
        found = toy.search(unit, len(want) + 5)
        assert len(found) == len(want) and np.allclose([s for s, _ in found], [s for s, _ in want])


ODD = ["", None, "a", "  two  spaces ", "tab\tnew\r\nline\n", "mark ▁ here▁", "▁", "▁▁ x", "日本語のテキスト 漢字", "x" * 300, "😀 emoji ñandú", "é" * 70 + " ok", "Ω≈ç√∫", "null\x00byte", "lorem ipsum dolor " * 4000]


def test_round_trip_of_odd_texts(real):
    e = P.Encoder(real, 4)
    ids, ends, nbest = e.encode(ODD)
    for k, text in enumerate(ODD):
        own = ids[ends[k] : ends[k + 1]]
        want = b" " + text.encode() if text else b""
        assert e.decoded(own) == want
        for score, size, changes in nbest[k]:
            other = P.expand(own.tolist(), changes)
            assert len(other) == size and e.decoded(np.array(other, dtype=np.int64)) == want
        assert [x[0] for x in nbest[k]] == sorted((x[0] for x in nbest[k]), reverse=True)


def test_query_form(spark, real):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(1, None, "y"), (None, "again", "z")], "doc_id bigint, text string, ids string")
    encoded = P.encode(docs)
    rows = encoded.collect()
    assert len(rows) == len(ODD) + 2 and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in P.decode(encoded.where("doc_id > 1")).collect()}
    assert all(back[k] == t for k, t in enumerate(ODD) if k > 1)
    assert P.encode(docs.limit(0)).collect() == []


def test_memory_follows_the_parts_of_a_batch(real):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubdkst") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(500)) for _ in range(1200)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    encoder, seen = P.Encoder(real, 4), []
    tracemalloc.start()
    for doc_ids, own in P._parts(batch):
        assert [texts[k] for k in doc_ids.to_pylist()] == own
        encoder.encode(own)
        seen += doc_ids.to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(len(texts))) and peak < 100e6


def test_parts_do_not_change_results(real, monkeypatch):
    texts = ["lorem ipsum dolor", "x" * 300, "", None, "日本語 漢字", "tab\tnew\r\nline"] * 40
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    def encoded():
        out = []
        for _, own in P._parts(batch):
            ids, ends, nbest = P.Encoder(real, 4).encode(own)
            out += [(ids[ends[k] : ends[k + 1]].tolist(), nbest[k]) for k in range(len(own))]
        return out

    whole = encoded()
    monkeypatch.setattr(P, "BATCH_LETTERS", 50)
    monkeypatch.setattr(P, "BATCH_ROWS", 7)
    assert encoded() == whole
