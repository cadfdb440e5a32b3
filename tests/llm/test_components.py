"""Connected components against a plain union-find, on paths, stars, rings and random graphs."""

import random

from shelflink.llm.components import connected_components


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)] + [(5, 5), (1, 0), (400, 401), (401, 400)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.a: r.b for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for e in edges for x in e if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_few_edges_are_done_without_a_round(spark, monkeypatch):
    """A few edges in many files took a chain of small jobs for every round."""
    from shelflink.llm import components as C

    monkeypatch.setattr(C, "_large_star", lambda edges: 1 / 0)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7)], "a bigint, b bigint").repartition(40)
    assert {(r.a, r.b) for r in C.connected_components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_many_edges_are_cut_into_pieces(spark, monkeypatch):
    from shelflink.llm import components as C

    monkeypatch.setattr(C, "PIECE_EDGES", 20)
    edges = spark.createDataFrame([(str(i).encode(), str(i + 3).encode()) for i in range(200)], "a binary, b binary").repartition(16)
    want = {str(i).encode(): min(str(k).encode() for k in range(i % 3, 203, 3)) for i in range(203)}
    assert {(bytes(r.a), bytes(r.b)) for r in C.connected_components(edges).collect()} == {x for x in want.items() if x[0] != x[1]}
