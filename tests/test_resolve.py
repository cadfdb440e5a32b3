"""Staged answers against asking every store and cutting afterwards; search by similarity."""

import random

import pytest
from pyspark.sql import functions as F

from shelflink.config import DEFAULTS
from shelflink.operators import match as M
from shelflink.operators import search
from shelflink.operators.similar import all_pairs
from shelflink.plans import resolve as R

TITLES = ["夜明けのノート", "quiet morning letters", "green harbour", "月の庭"]
STEPS = {"dlsite": ["primary", "female"], "fanza": ["search"], "melonbooks": ["search"], "pixiv": ["tag", "title-caption"], "fantia": ["search"]}


@pytest.fixture(scope="module")
def answers(spark):
    """Some requests are settled by the first store, some by a later one, some by none; gates and errors occur."""
    rng = random.Random(12)
    requests = [(f"r{k}", [t, t + " 2"][: 1 + k % 2], None if k % 3 else 2) for k, t in enumerate(TITLES * 3)]
    requests = [(i, [f"{q} {n}" for q in qs], h) for n, (i, qs, h) in enumerate(requests)]
    items, steps = [], []
    for i, queries, _ in requests:
        for store, names in STEPS.items():
            for step in names:
                for q in queries:
                    reason = rng.choice(["ok", "ok", "ok", "age-check", "network-error"])
                    steps.append((store, step, q, 200 if reason == "ok" else 0, reason != "network-error", reason))
                    for pos in range(rng.randrange(4) if reason == "ok" else 0):
                        title = rng.choice([q, q + "!", q[:-2], q[1:] + " extra words", "unrelated thing", q[::-1]])
                        items.append((store, step, q, pos, title, f"{store}-{rng.randrange(40)}"))
    r = spark.createDataFrame(requests, "request_id string, queries array<string>, chapter_hint int")
    return (
        M.with_query_forms(r),
        spark.createDataFrame(items, "store string, step_id string, query string, pos int, title string, product_id string"),
        spark.createDataFrame(steps, "store string, step_id string, query string, http_status int, ok boolean, reason string"),
    )


def as_rows(df):
    return sorted((r.asDict(recursive=True) for r in df.select("request_id", "store_rank", *R.STORE_FIELDS).collect()), key=lambda r: (r["request_id"], r["store_rank"]))


@pytest.mark.parametrize("captured", [True, False])
def test_staged_equals_cut_afterwards(spark, answers, captured, monkeypatch):
    requests, items, steps = answers
    steps = steps if captured else None
    every = as_rows(R.store_answers(requests, items, steps))
    settled, want = set(), []
    for row in sorted(every, key=lambda r: r["store_rank"]):
        if row["request_id"] not in settled:
            want.append(row)
            if row["kind"] == "high":
                settled.add(row["request_id"])
    assert 0 < len(settled) < 12 and len(want) < len(every)
    scored = []
    plain = M.score_rows
    monkeypatch.setattr(M, "score_rows", lambda rows, *a, **k: scored.append(rows.where("item is not null").count()) or plain(rows, *a, **k))
    got = as_rows(R.staged_answers(requests, items, steps))
    assert got == sorted(want, key=lambda r: (r["request_id"], r["store_rank"]))
    staged, scored[:] = sum(scored), []
    R.store_answers(requests, items, steps)
    assert staged < 0.75 * sum(scored)


def test_similarity_search_finds_what_shares_no_word(spark):
    items = spark.createDataFrame(
        [(1, "a", "s", 5, "夜明けのノオト"), (2, "a", "s", 3, "夜明けのノート"), (3, "a", "s", 1, "別の本"), (4, "b", "s", 9, "夜明けノート"), (5, "b", "s", 2, "Green Harbor")],
        "item_id bigint, store string, step_id string, pos int, title string",
    )
    queries = spark.createDataFrame([("夜明けのノート",), ("green harbour",), ("",), ("green harbour",)], "query string")
    found, scores = search.search_similar(queries, items)
    got = sorted((r.query, r.item_id, r.similarity, r.pos) for r in found.collect())
    assert got == [("green harbour", 5, 92, 0), ("夜明けのノート", 1, 86, 1), ("夜明けのノート", 2, 100, 0), ("夜明けのノート", 4, 86, 0)]
    assert set(scores.columns) == {"a", "b", "score", "method"}


def test_known_scores_give_the_same_best(spark):
    rows = spark.createDataFrame([("r", k, ["夜明けのノート", "夜明け ノート 2"], t) for k, t in enumerate(["夜明けのノート 第2話", "夜明け", "ノート", "全く違う", "夜明けのノオト"])], "request_id string, pos int, queries array<string>, title string")
    rows = M.with_query_forms(M.with_item_forms(rows)).selectExpr("*", "cast(2 as int) as chapter_hint")
    pairs = all_pairs(rows.selectExpr("explode(query_forms.form) as a"), rows.selectExpr("explode(forms) as b"), DEFAULTS.min_candidate)
    best = lambda s: sorted((r.pos, r.score, r.method, r.matched_query) for r in M.score_rows(rows, ["request_id", "pos"], [], scores=s).collect() if r.score >= 50)
    assert best(pairs) == best(None) and len(best(None)) >= 3


def test_a_search_by_numbers_gives_what_whole_rows_give(spark):
    """Rounds used to shuffle every answer with its titles' forms, and to fold exploded pairs by a shuffle."""
    from shelflink.operators.match import with_item_forms
    from shelflink.operators.search import search_catalogue
    from shelflink.plans import tables as T

    words = ["quiet", "morning", "letters", "第2巻", "夜明け", "ノート", "old"]
    rows = [(i, s, step, i, f"D{i}", " ".join(words[(i * k) % 7] for k in (1, 2, 3 + i % 2)), i, "JPY")
            for i, (s, step) in enumerate([("dlsite", "primary"), ("dlsite", "female"), ("fanza", "search"), ("pixiv", "tag"), ("pixiv", "title-caption")] * 9)]
    items = spark.createDataFrame(rows, "item_id int, store string, step_id string, pos int, product_id string, title string, price int, currency string")
    asked = [["quiet morning letters"], ["夜明け ノート", "old letters"], ["letters 夜明け old 第2巻", "ノート"], ["nothing here"]]
    requests = M.with_query_forms(spark.createDataFrame([(f"r{k}", q, 2 if k == 2 else None) for k, q in enumerate(asked)], "request_id string, queries array<string>, chapter_hint int")).cache()
    queries = requests.selectExpr("explode(queries) as query")
    formed = with_item_forms(items)
    whole = R.from_table(search_catalogue(queries, formed).join(formed.drop("store", "step_id", "pos"), "item_id"))
    numbers = T.keyword_search(requests, items)
    found, _, titles = numbers(queries.selectExpr("'pixiv' as store", "'tag' as step_id", "query"))
    assert {"title", "forms", "title_nfkc"} <= set(titles.columns) and not {"title", "forms", "title_nfkc"} & set(found.columns)
    plan = found.where("store = 'pixiv' and step_id in ('tag')")._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in line and "pixiv" in line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines())
    rows_of = lambda search: sorted(map(repr, (r.asDict(True) for r in R.staged_answers(requests, search).collect())))
    got = rows_of(numbers)
    assert got == rows_of(whole) and any("'kind': 'possible'" in r or "'kind': 'high" in r for r in got)


def test_rows_are_scored_where_they_are(spark):
    """Best of all pairs of forms, penalties, first of equals; rows of the same keys become one unless they are known to be single."""
    rows = spark.createDataFrame(
        [("r", 0, [(0, "abc", "abc"), (1, "xyz", "xyz")], ["xyz", "abcd"], "t"), ("r", 0, [(0, "abc", "abc")], ["abc"], "t"), ("r", 1, [(0, "abc", "abc")], None, None)],
        "request_id string, pos int, query_forms array<struct<pos:int,query:string,form:string>>, forms array<string>, title_nfkc string",
    ).withColumn("chapter_hint", F.lit(None).cast("int"))
    out = M.score_rows(rows, ["request_id", "pos"], [])
    assert [(r.pos, r.score, r.raw_score, r.method, r.matched_query) for r in out.orderBy("pos").collect()] == [(0, 100, 100, "exact", "abc"), (1, 0, 0, "none", "abc")]
    single = M.score_rows(rows, ["request_id", "pos"], [], once=True)
    assert sorted((r.score, r.raw_score, r.matched_query) for r in single.collect()) == [(0, 0, "abc"), (95, 100, "xyz"), (100, 100, "abc")]
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
