"""Fingerprints and components against plain Python over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from shelflink.llm import simhash as S


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute(rows, bits=4):
    prints = [plain(t) for _, t in rows]
    group, least = components(prints, bits), {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group)), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "cD", "é", "漢", "x"]) + str(rng.randrange(90))
    base = [[word() for _ in range(150)] for _ in range(4)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "One  two\tthree", "a b c d", "A B C D e"]
    while len(texts) < n:
        near = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near) if rng.random() < 0.7 else " ".join(word() for _ in range(rng.randrange(1, 30))))
    return texts


def run(spark, rows, **given):
    docs = spark.createDataFrame([(i, t, "print", 0) for i, t in rows], "doc_id bigint, text string, print string, a int")
    return sorted((tuple(r) for r in S.near_components(docs, **given).collect()), key=repr)


def test_triples_meet_every_four_positions():
    assert len(S.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in S.TRIPLES) for q in combinations(range(8), 4))


def test_components_of_texts(spark):
    texts = corpus(3, 130)
    rows = [(k * 7 % 131, t) for k, t in enumerate(texts)] + [(None, texts[20]), (None, "alone and without id"), (5, texts[30]), (5, texts[30])]
    want = brute(rows)
    assert len({c for *_, c in want}) < len(want) - 30
    assert run(spark, rows) == want
    assert run(spark, rows, longest=4) == want  # the same by blocks of long lists
    assert run(spark, []) == []


def test_links_at_every_distance(spark):
    """Planted fingerprints that differ in 0 to 6 bits, in as many bytes as possible, in chains and dense balls."""
    rng = random.Random(8)
    prints = set()
    for _ in range(25):
        own = rng.getrandbits(64)
        prints.add(own)
        for bits in range(1, 7):
            places = [8 * p + rng.randrange(8) for p in rng.sample(range(8), bits)]
            prints.add(own ^ sum(1 << p for p in places))
    ball = rng.getrandbits(64)
    prints |= {ball ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(5))) for _ in range(250)}
    prints |= {0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "print bigint")
    for bits, longest in ((4, 4096), (4, 10), (2, 10), (0, 10)):
        found = [tuple(r) for r in S.links(table, bits, longest).distinct().collect()]
        unsigned = lambda x: x & ((1 << 64) - 1)
        assert all(0 < (unsigned(a) ^ unsigned(b)).bit_count() <= bits for a, b in found)
        root = {p: p for p in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            root[find(a)] = find(b)
        want, got = components(prints, bits), [find(p) for p in signed]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_very_long_text():
    rng = random.Random(1)
    text = "\n".join(f"W{rng.randrange(5000)}" for _ in range(150_000))
    assert S.fingerprint(text.encode(), 4, 42) == plain(text)
