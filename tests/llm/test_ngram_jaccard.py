"""The join against brute force over all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from shelflink.llm import ngram_jaccard as J
from shelflink.llm.shingles import shingle_set, word_hashes


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, t):
    sets = [shingles(text, k) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and t.denominator * both >= t.numerator * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows, k, t):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r)[:3] for r in J.link_components(docs, k, t).collect()), key=repr)


def corpus(seed, n):
    """Unique texts, near copies at all distances, chains, short texts, shared passages, hot groups."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(40)]
    hot = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.randrange(8)
        if kind < 2 and texts:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 6)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
        elif kind == 2:
            texts.append(" ".join(word() for _ in range(rng.randrange(1, 9))))
        elif kind == 3:
            texts.append(" ".join(passage + [word() for _ in range(rng.randrange(0, 30))]))
        elif kind == 4:
            near = list(hot)
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
        elif kind == 5 and texts:
            texts.append(rng.choice(texts).upper() + "\n")
        else:
            texts.append(" ".join(word() for _ in range(rng.randrange(20, 120))))
    return list(enumerate(texts))


@pytest.mark.parametrize("k, t, frequent", [(4, Fraction(85, 100), 16), (5, Fraction(4, 5), 2)])
def test_components_equal_brute_force(spark, monkeypatch, k, t, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BLOCK_NODES", 8)
    rows = corpus(3, 260) + [(None, "a1 a2 a3 a4 a5 a6"), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "ONE"), (905, "x " * 30_000)]
    rows += rows[:3]
    assert run(spark, rows, k, t) == brute(rows, k, t)


def test_more_frequent_shingles_than_may_be_sent(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "MOST_FREQUENT", 5)
    rows = corpus(11, 150)
    assert run(spark, rows, 4, Fraction(85, 100)) == brute(rows, 4, Fraction(85, 100))


def test_empty_table_and_one_of_each_group(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n int")
    assert J.link_components(empty).collect() == []
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (2, "other words stand here alone", "z"), (9, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    kept = J.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    from shelflink.llm import shingles as S

    raw = np.frombuffer(("lorem ipsum " * 50 + "x" * 400 + " dolor sit\n" * 20).encode(), dtype=np.uint8)
    whole = word_hashes(raw)
    monkeypatch.setattr(S, "PIECE", 64)
    assert (whole == word_hashes(raw)).all() and len(shingle_set(raw, 5)) > 1


def test_words_that_a_power_sum_cannot_tell_apart():
    """Thue-Morse words and their complements: every power of a base modulo 2^64 sums alike."""
    word, other = "a", "b"
    for _ in range(12):
        word, other = word + other, other + word
        hashes = word_hashes(np.frombuffer(f"{word} {other} {word}".encode(), dtype=np.uint8))
        assert hashes[0] == hashes[2] != hashes[1]


def test_word_hashes_do_not_depend_on_the_place():
    rng = random.Random(9)
    words = ["".join(rng.choice("abé漢Z") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    once = {w: int(word_hashes(np.frombuffer(w.encode(), dtype=np.uint8))[0]) for w in words}
    assert len(set(once.values())) == len({re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words})
    text = "\t".join(words * 3)
    assert word_hashes(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == [once[w] for w in words * 3]


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    near = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59)) + " other"]
    alone = "quite another text of several words that stands alone"
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in J.keep_one_each(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, _id int, own_hash string")).collect()), key=repr)
    assert kept([(1, near[0]), (None, near[1]), (None, alone)]) == sorted([(1, near[0]), (None, alone)], key=repr)
    found = kept([(1, near[0]), (5, near[1]), (5, alone)])
    assert found == [(1, near[0]), (5, alone)]
    assert len(kept([(7, near[0]), (7, near[1]), (7, near[0])])) == 1
    assert len(kept([(None, near[0]), (None, near[1]), (None, near[0])])) == 1
    assert kept([(3, ""), (3, ""), (None, None), (4, alone), (4, alone)]) == sorted([(3, ""), (3, ""), (None, None), (4, alone)], key=repr)


def near_copies(seed, n, length, most):
    """Copies of one text, each with one to ``most`` other words: about as alike as the threshold asks."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(length), rng.randrange(1, most + 1)):
            own[at] = f"v{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    return rows


def test_a_group_of_near_copies_is_verified_by_few_pairs_a_member(spark, monkeypatch):
    """What the rounds before leave apart, here everything, is not verified pair by pair."""
    verified, verify, possible = [], J._verify, J._possible
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "_possible", lambda *args: possible(*args).where("false"))
    monkeypatch.setattr(J, "_verify", lambda docs, pairs, *rest: verified.append(pairs.count()) or verify(docs, pairs, *rest))
    rows = near_copies(4, 150, 120, 1)
    assert run(spark, rows, 5, Fraction(4, 5)) == brute(rows, 5, Fraction(4, 5))
    assert 149 <= sum(verified) <= 10 * len(rows)


@pytest.mark.parametrize("block", [8, 8192])
def test_passes_over_near_misses_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "BLOCK_NODES", block)
    monkeypatch.setattr(J, "PARTNERS", 1)
    passes, across = [], J._across
    monkeypatch.setattr(J, "_across", lambda *args: passes.append(args[-1]) or across(*args))
    rows = [(100 * group + k, text) for group in range(3) for k, text in near_copies(group, 30, 40, 2)]
    assert run(spark, rows, 5, Fraction(4, 5)) == brute(rows, 5, Fraction(4, 5))
    assert passes[:2] == [0, 1]


def test_lists_that_chain_nodes_together_are_compared_list_by_list(spark):
    """One passage after the other links neighbours only; all nodes of the chain used to meet each other."""
    t = Fraction(4, 5)
    rows = [(100 * group + k, text) for group in range(12) for k, text in near_copies(group, 6, 40, 2)]
    sets = {i: J.shingle_set(np.frombuffer(text.encode(), dtype=np.uint8), 5) for i, text in rows}
    placed = spark.createDataFrame([(i, len(x), bytearray(J._bitmap(x)), i) for i, x in sets.items()], "node bigint, n bigint, bitmap binary, root bigint")
    lists = {g: [100 * g + k for k in range(6)] for g in range(12)} | {50 + g: [100 * g + 5, 100 * g + 100] for g in range(11)}
    lists |= {80 + g: lists[g] for g in range(12)}
    postings = spark.createDataFrame([(s, v, min(nodes)) for s, nodes in lists.items() for v in nodes + nodes[:1]], "signature bigint, node bigint, a bigint")
    members = J._hoods(postings, placed).collect()
    assert sorted({r.hood for r in members}) == [*range(12), *range(50, 61)] and all(r.part is not None for r in members)
    assert len(members) == 12 * 6 + 11 * 2
    held = spark.createDataFrame(members, "node bigint, hood bigint, part bigint")
    every = {(r.a, r.b) for r in J._across(held, placed, t, 1000).collect()}
    like = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y]))
    pairs = {(min(x, y), max(x, y)) for nodes in lists.values() for x in nodes for y in nodes if x != y}
    assert {p for p in pairs if like(*p) >= 0.8} <= every <= pairs and any(like(*p) >= 0.8 for p in pairs)
    forest = {(r.a, r.b) for r in J._across(held, placed, t, 0).collect()}
    assert {p for p in forest if p[0] != p[1]} <= every and {x for p in every - forest for x in p} <= {a for a, b in forest if a == b}


@pytest.mark.parametrize("longest", [1, 4, 1024])
def test_short_and_long_lists_lose_no_link(spark, monkeypatch, longest):
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "PARTNERS", 1)
    monkeypatch.setattr(J, "LIST_NODES", longest)
    monkeypatch.setattr(J, "_possible", lambda *args, plain=J._possible: plain(*args).where("false"))
    rows = [(100 * group + k, text) for group in range(4) for k, text in near_copies(20 + group, 12, 60, 3)]
    assert run(spark, rows, 5, Fraction(4, 5)) == brute(rows, 5, Fraction(4, 5))
