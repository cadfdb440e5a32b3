import random

from hypothesis import given, settings
from hypothesis import strategies as st

from shelflink.config import Config
from shelflink.functions import scores as S
from shelflink.operators import match as M
from shelflink.operators.search import search_catalogue


def lcs_reference(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def half_up(x):
    return int(x * 100 + 0.5)


def dice_reference(a, b):
    grams = lambda s: [s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)]
    x, y = grams(a), grams(b)
    left, shared = list(x), 0
    for g in y:
        if g in left:
            left.remove(g)
            shared += 1
    return 2 * shared / (len(x) + len(y))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcあ漢😀", min_size=1, max_size=90), st.text("abcあ漢😀", min_size=1, max_size=90)), min_size=1, max_size=6))
def test_overlap_against_plain_definitions(pairs):
    dice, lcs = S.overlap_arrays([a for a, _ in pairs], [b for _, b in pairs])
    assert dice.tolist() == [half_up(dice_reference(a, b)) for a, b in pairs]
    assert lcs.tolist() == [half_up(lcs_reference(a, b) / max(len(a), len(b))) for a, b in pairs]


def test_score_pairs(spark):
    df = spark.createDataFrame(
        [(0, "", "x"), (1, "abc", "abc"), (2, "abcdefghi", "abcdefghij"), (3, "abc", "abcd"), (4, "ab", "axb"),
         (5, "abcd", "dcba"), (6, "ab", "abcdef")], "i int, a string, b string")
    rows = S.score_pairs(df).orderBy("i").collect()
    assert [(r.score, r.method) for r in rows] == [
        (0, "empty"), (100, "exact"), (94, "dice"), (80, "containment"), (67, "lcs"), (25, "lcs"), (42, "containment"),
    ]
    # dice of 8 shared of 8 + 9 bigrams = 94 beats the containment step 90


def hits(spark, rows):
    return spark.createDataFrame(rows, "request_id int, pos int, title string, queries array<string>, chapter_hint int")


def test_rank_and_classify(spark):
    q = ["夜明けのノート"]
    rows = [
        (1, 0, "夜明けのノート", q, None), (1, 1, "別の本", q, None),
        (2, 0, "夜明けのノート 第2巻", q, 2), (2, 1, "夜明けのノート 第3巻", q, 2),
        (3, 0, "全く違う題名です", q, None),
        (4, 0, "【PC版】夜明けのノート", q, None), (4, 1, "夜明けのノート", q, None),
    ]
    ranked = M.rank_candidates(hits(spark, rows)).cache()
    got = {(r.request_id, r.pos): (r.score, r.method, r.rank, r.hint_applied) for r in ranked.collect()}
    assert got[1, 0] == (100, "exact", 1, False)
    # both volumes are exact once the chapter is stripped; the bonus is capped at 100
    assert got[2, 0][0] == 100 and got[2, 0][3] and got[2, 1][:2] == (100, "exact") and got[2, 1][2] == 2
    kinds = {r.request_id: r for r in M.classify_ranked(ranked).collect()}
    assert kinds[1].kind == "high" and len(kinds[1].candidates) == 1
    assert kinds[2].kind == "high_with_alternatives"
    assert kinds[3].kind == "none" and kinds[3].best is None
    assert kinds[4].kind == "high_with_alternatives" and kinds[4].best.pos == 0


def test_fallback_queries_are_penalised(spark):
    rows = [(1, 0, "別の題名", ["夜明けのノート", "別の題名"], None)]
    r = M.rank_candidates(hits(spark, rows)).first()
    assert (r.score, r.raw_score, r.matched_query, r.method) == (95, 100, "別の題名", "exact")


def test_empty_score(spark):
    r = M.rank_candidates(hits(spark, [(1, 0, "!!", ["夜明け"], None)])).first()
    assert (r.score, r.method, r.matched_query) == (0, "none", "夜明け")


def test_search_is_exact(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    titles = [" ".join(rng.choices(words, [12 - i for i in range(12)], k=rng.randint(1, 6))) for _ in range(120)]
    queries = list({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)})
    items = spark.createDataFrame([(i, "s", "search", i, t) for i, t in enumerate(titles)], "item_id int, store string, step_id string, pos int, title string")
    out = search_catalogue(spark.createDataFrame([(q,) for q in queries], "query string"), items, Config(items_per_step=1000))
    got = {(r["query"], r.item_id) for r in out.collect()}
    need = lambda n: -(-n * 70 // 100)
    want = {(q, i) for q in queries for i, t in enumerate(titles)
            if len(set(q.split()) & set(t.split())) >= need(len(set(q.split())))}
    assert got == want and len(want) > 50


def test_a_page_size_cuts_answers_only_where_it_is_set(spark):
    items = spark.createDataFrame([(i, "s", "search", i, "common title") for i in range(50)], "item_id int, store string, step_id string, pos int, title string")
    asked = spark.createDataFrame([("common title",), ("共通の題名",)], "query string")
    assert sorted(r.item_id for r in search_catalogue(asked, items).collect()) == list(range(50))
    assert sorted((r.item_id, r.pos) for r in search_catalogue(asked, items, Config(items_per_step=30)).collect()) == [(i, i) for i in range(30)]


def test_long_titles_are_scored_exactly_and_one_by_one():
    """Repeats beyond any counter, and one very long title between short ones."""
    from shelflink.functions.scores import overlap_arrays

    left = ["a" * 4500, "a" * 6000, "ab" * 50_000, "abc", "x" * 2000 + "y", ""]
    right = ["a" * 4400, "b" * 6000, "ab" * 49_000, "abd", "y" + "x" * 2000, "abc"]
    dice, lcs = overlap_arrays(left, right)
    assert dice.tolist() == [99, 0, 99, 50, 100, 0] and lcs.tolist() == [98, 0, 98, 67, 100, 0]


def test_token_lists_stay_out_of_the_token_join(spark):
    """A list carried once a token would grow with the square of its length, and look small enough
    for a broadcast; the joins carry keys, and lists are met once a pair."""
    items = spark.createDataFrame([(i, "s", "t", i, " ".join(f"w{i * k % 90}" for k in range(80))) for i in range(60)], "item_id int, store string, step_id string, pos int, title string")
    asked = spark.createDataFrame([("w1 w2 w3",), ("w4 w8 w12 w1",)], "query string")
    found = search_catalogue(asked, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(" in line]
    assert exploded and not any(f"{name}#" in line.split("),", 1)[1] for line in exploded for name in ("tokens", "asked", "prefix", "title"))
    assert "BroadcastHashJoin" not in plan
    words = {r.item_id: set(r.title.split()) for r in items.collect()}
    want = {(q.query, i) for q in asked.collect() for i, w in words.items() if 10 * len(w & set(q.query.split())) >= 7 * len(q.query.split())}
    assert {(r.query, r.item_id) for r in found.collect()} == want != set()


def test_ranking_crosses_to_python_twice(spark):
    """Once for the forms of both sides, once for the scores: each crossing is a worker of every task."""
    hits = spark.createDataFrame(
        [("r", 0, "ＡＢＣ 第1話", ["abc", "ＸＹＺ"], 1), ("r", 1, None, ["abc", "ＸＹＺ"], 1)],
        "request_id string, pos int, title string, queries array<string>, chapter_hint int",
    )
    ranked = M.rank_candidates(hits)
    ranked.collect()
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    both = M.with_both_forms(hits).select("forms", "query_forms", "title_nfkc").collect()
    assert both == M.with_query_forms(M.with_item_forms(hits)).select("forms", "query_forms", "title_nfkc").collect()


def test_a_title_is_compared_once_however_many_items_carry_it(spark):
    """Copies of a title used to be joined, given their token lists and scored one by one."""
    from shelflink.operators.search import answers, search_titles

    items = spark.createDataFrame([(i, "s", "t", i, "the same old title" if i % 2 else f"other {i} title") for i in range(60)], "item_id int, store string, step_id string, pos int, title string")
    asked = spark.createDataFrame([("the same old title",), ("title",), ("nothing",)], "query string")
    hits = search_titles(asked, items)
    assert hits.titles.count() == 31 and hits.found.count() == 1 + 31
    got = sorted((r.query, r.item_id, r.pos) for r in answers(hits).collect())
    assert got == sorted([("the same old title", i, k) for k, i in enumerate(range(1, 60, 2))] + [("title", i, i) for i in range(60)])


def test_answers_are_placed_before_they_carry_the_query(spark):
    """Rows of the answer are dealt as numbers; a pair is only compared where the title holds two rare words of the query."""
    items = spark.createDataFrame([(i, "s", "t", i, f"w{i % 7} w{i % 5} common word") for i in range(70)], "item_id int, store string, step_id string, pos int, title string")
    asked = spark.createDataFrame([("w1 w2 common word",), ("w3 common",)], "query string")
    found = search_catalogue(asked, items)
    words = {r.item_id: set(r.title.split()) for r in items.collect()}
    want = {(q.query, i) for q in asked.collect() for i, w in words.items() if 10 * len(w & set(q.query.split())) >= 7 * len(q.query.split())}
    assert {(r.query, r.item_id) for r in found.collect()} == want != set()
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    placing = [line for line in plan if "Window [" in line]
    assert placing and not any("query#" in line for line in placing)
    assert any("Filter" in line and "_k#" in line for line in plan)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abcあ漢😀", max_size=90), st.text("abcあ漢😀", max_size=90)), min_size=1, max_size=6))
def test_the_strongest_overlap_is_that_of_measuring_everything(pairs):
    left, right = [a for a, _ in pairs] + ["a" * 4500, "abc"], [b for _, b in pairs] + ["b" + "a" * 4400, "abc" * 700]
    dice, lcs = S.overlap_arrays(left, right)
    fast, longest = S.strongest_arrays(left, right)
    assert fast.tolist() == dice.tolist()
    assert [max(d, l) for d, l in zip(fast, longest)] == [max(d, l) for d, l in zip(dice, lcs)]
    assert [l > d for d, l in zip(fast, longest)] == [l > d for d, l in zip(dice, lcs)]


def test_a_longest_subsequence_that_cannot_win_is_not_measured(monkeypatch):
    measured = []
    monkeypatch.setattr(S, "_lcs_words", lambda a, la, b, plain=S._lcs_words: measured.append(len(a)) or plain(a, la, b))
    monkeypatch.setattr(S, "_lcs_long", lambda a, b, plain=S._lcs_long: measured.append(1) or plain(a, b))
    title = "the quick brown fox " * 200
    dice, lcs = S.strongest_arrays([title[:40], "abcd"], [title, "abxd"])
    assert measured == [1] and lcs.tolist()[1] == 75 and dice.tolist()[0] == S.overlap_arrays([title[:40]], [title])[0][0]
