"""Title cleaning, tested rule by rule: titles are put together from parts whose role is known,
so the expected result follows from the parts, and properties hold for every composition."""

import random

import pytest
from pyspark.sql import functions as F

from shelflink import schemas
from shelflink.functions import titles as T
from shelflink.operators import clean as C

CORES = ["海辺のランプ工房", "Copper Lantern Atlas", "灰色猫と梯子", "Seventeen Paper Boats"]


def cleaned(spark, titles, host=""):
    df = spark.createDataFrame([(i, t, host) for i, t in enumerate(titles)], "i int, raw string, host string")
    return [r.clean for r in C.clean_titles(df).orderBy("i").collect()]


def test_each_rule_alone_leaves_the_core(spark):
    """One decoration at a time, over every core: markers, labels, editions, wrapping, page furniture."""
    wraps = {
        "chapter marker": lambda c: f"{c} 第41話",
        "wrapped whole": lambda c: f"【{c}】",
        "leading label": lambda c: f"[灯台組] {c}",
        "edition": lambda c: f"{c} [DL版]",
        "two editions": lambda c: f"{c} [英訳] [無修正]",
        "site after »": lambda c: f"{c} » shelf",
        "issue note": lambda c: f"{c} (季刊灯台 Vol.7)",
        "nested label": lambda c: f"[[灯] 台] {c}",
    }
    titles = [(name, core, wrap(core)) for name, wrap in wraps.items() for core in CORES]
    got = cleaned(spark, [t for *_, t in titles], "shelf.example")
    wrong = [(name, t, g.cleaned) for (name, core, t), g in zip(titles, got) if g.cleaned != core]
    assert not wrong
    hints = {name: {g.chapter_hint for (n, *_), g in zip(titles, got) if n == name} for name in ("chapter marker", "edition")}
    assert hints == {"chapter marker": {41}, "edition": {None}}


def test_properties_of_random_compositions(spark):
    """Whatever is put around a core: the result is stable under cleaning, begins and ends clean,
    is empty or has two meaningful characters, and empty titles are of low confidence."""
    rng = random.Random(17)
    before = ["", "[灯台組] ", "【単話】", "(C99) ", "raw ", "[a [b] c] "]
    after = ["", " 第3話", " [Chinese]", " (見本 12号)", " - 灯台文庫", " | Lamp Site", "_最新", " [DL版][英訳]", "!!"]
    titles = ["".join((rng.choice(before), rng.choice([*CORES, "!?", ""]), rng.choice(after), rng.choice(after))) for _ in range(120)]
    once = cleaned(spark, titles, "lamp.example")
    twice = cleaned(spark, [c.cleaned for c in once], "lamp.example")
    edges = tuple(" -–—_·•|｜、,，。;；~～")
    for title, a, b in zip(titles, once, twice):
        assert a.cleaned == "" or sum(ch.isalnum() for ch in a.cleaned) >= 2, title
        assert not a.cleaned.startswith(edges) and not a.cleaned.endswith(edges), title
        assert len(b.cleaned) <= len(a.cleaned), title
        assert (a.confidence == "low") or a.cleaned, title
        assert a.raw_title is not None and a.confidence in ("high", "medium", "low")


def test_nothing_left_means_low_confidence(spark):
    assert [(c.cleaned, c.confidence) for c in cleaned(spark, ["", "   ", "第8話", "#12"])][:3] == [("", "low")] * 3


def test_leading_brackets_pair_up(column):
    """The bracket that opens the title is split at its own partner, however deep it nests."""
    deep = "[" * 5 + "x" + "]" * 5
    got = column(T.split_leading_bracket, [deep + " tail", "【表】裏", "(half", "no [bracket]", "[]tail", "[a](b)"])
    assert [tuple(g) if g else None for g in got] == [(deep[1:-1], "tail"), ("表", "裏"), None, None, None, ("a", "(b)")]


def test_section_headings_are_told_from_titles(column):
    furniture = ["Related", "Comments", "#4711"]
    assert column(T.is_section_heading, CORES) == [False] * len(CORES)
    assert column(T.is_section_heading, furniture)[2] and not any(column(T.is_section_heading, ["海辺", "灯台の話"]))


def test_boundary_noise_goes_from_both_ends_only(column):
    words = ["漫画海辺のランプ工房", "海辺のランプ工房漫画", "海辺の漫画工房"]
    assert column(T.strip_boundary_noise, words) == ["海辺のランプ工房", "海辺のランプ工房", "海辺の漫画工房"]


@pytest.fixture(scope="module")
def page(spark):
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schemas.PAGE_INFO).fieldNames()
    blank = {"host": "shelf.example", "headings": [], "h1": [], "h2": [], "h3": [], "settled": True, "image_count": 0, "info_fields": [], "navigation_type": "load"}

    def build(*pages):
        return spark.createDataFrame([tuple(({"page_id": i} | blank | p).get(n) for n in fields) for i, p in enumerate(pages)], schemas.PAGE_INFO)

    return build


def test_better_sources_win(page):
    """A heading in the work's own script beats a romanised heading, which beats the page title;
    furniture headings never count, and the losers become variants."""
    df = page(
        {"title": "Copper Lantern Atlas » shelf", "h1": ["[Team] Copper Lantern Atlas [English]"], "h2": ["[灯台組] 海辺のランプ工房 [英訳]", "More Like This"]},
        {"title": "Seventeen Paper Boats » shelf", "h1": ["Seventeen Paper Boats [Digital]"]},
        {"title": "海辺のランプ工房 [English]", "h1": ["海辺のランプ工房", "海辺のランプ工房 [DL版]"]},
        {},
    )
    e = [r.extraction for r in C.work_titles(df).orderBy("page_id").collect()]
    assert e[0].variants == ["海辺のランプ工房", "Copper Lantern Atlas"] and e[0].cleaned_title == e[0].variants[0] and e[0].source.startswith("h2")
    assert e[1].variants == ["Seventeen Paper Boats"] and e[2].variants == ["海辺のランプ工房"]
    assert (e[3].cleaned_title, e[3].confidence, e[3].variants) == ("", "low", [])


def test_artists_come_from_labels_or_the_leading_bracket(page):
    df = page(
        {"info_text": "Pages: 12 Artists: mira lund Groups: paper crane | tin whistle Languages: japanese"},
        {"info_text": "Artists: unknown Groups: 98765"},
        {"info_text": "Artists: nobody", "h2": ["[灯台守] 海辺のランプ工房"]},
    )
    got = [r.artists for r in C.work_titles(df).orderBy("page_id").collect()]
    assert got[0] == ["mira lund", "paper crane", "tin whistle"] and got[1] == []
    assert "灯台守" in got[2] or "nobody" in got[2]


def test_queries_are_plain_and_distinct(page):
    df = page({"title": "Copper！Lantern", "h1": ["海辺！ランプ", "海辺！ランプ"]}, {"title": "灯台"})
    rows = C.effective_queries(C.work_titles(df)).orderBy("page_id").collect()
    assert rows[0].queries[0] == "海辺 ランプ" and "Copper Lantern" in rows[0].queries and len(set(rows[0].queries)) == len(rows[0].queries)
    assert rows[1].queries == ["灯台"]


def test_filters_and_explodes_after_cleaning(spark, page, tmp_path):
    """Predicates on cleaned columns over a file scan must not drag Python into lambdas."""
    page({"title": "灰色猫と梯子 第3話", "h1": ["灰色猫と梯子"]}, {"title": "!!"}).write.parquet(str(tmp_path / "p"))
    info = spark.read.parquet(str(tmp_path / "p"))
    high = C.clean_titles(info.select("page_id", "host", F.col("title").alias("raw"))).where("clean.confidence = 'high'")
    assert [r.clean.cleaned for r in high.collect()] == ["灰色猫と梯子"]
    sources = C.title_sources(info).select("page_id", F.explode("sources").alias("s")).where("s.confidence <> 'low'")
    assert {r.s.source for r in sources.collect()} == {"h1[0]", "title"}
    asked = C.effective_queries(C.work_titles(info)).select(F.explode("queries").alias("q"))
    assert "灰色猫と梯子" in {r.q for r in asked.collect()}
