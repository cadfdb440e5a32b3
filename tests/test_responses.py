import json

import pytest

from shelflink import schemas
from shelflink.sources import responses as R

PAD = "<!-- " + "x" * 3200 + " -->"
CARD_A = """<li data-list_item_product_id="{id}"><dl><dd class="work_name"><div><a href="{href}" title="{title}">short</a></div></dd>
<dd class="maker_name"><a href="/m">丸 &amp; 角</a> <span class="author"><a>作者 一</a></span></dd>
<dd class="work_category type_MNG"><a href="#">マンガ</a></dd>
<dd class="work_price_wrap"><span class="work_price"><span class="work_price_base">1,100</span><span class="work_price_suffix">円</span></span>
<span class="work_price strike"><span class="work_price_base">2,200</span><span class="work_price_suffix">円</span></span></dd>
<span class="icon type_sale">50%OFF</span>
<div data-currency_price='{{"JPY":1100,"CNY":48.4}}' thumb-candidates="['//img.test/a.jpg','//img.test/b.jpg']"></div>
<dd class="work_deals work_labels"><span>独占</span><span> 割引 </span></dd></li>"""
PAGE_A = PAD + '<div id="search_result_list">' + CARD_A.format(id="AA1", href="//www.dlsite.com/x/AA1.html", title="題名の本") + CARD_A.format(
    id="AA1", href="/x/AA1.html", title="again") + CARD_A.format(id="AA2", href="/x/other.html", title="no id in link") + CARD_A.format(
    id="AA3", href="/x/AA3.html", title="") + "</div>"
CARD_B = """<a href="https://www.dmm.co.jp/dc/doujin/-/detail/=/cid={id}/?a=1&amp;b=2"><img></a>
<a href="https://www.dmm.co.jp/dc/doujin/-/detail/=/cid={id}/?t=1"><p class="text-sm font-bold line-clamp-2">{title}</p></a>
<p class="text-[#b42f59] x"><span class="font-bold text-lg">1,234円</span></p><p class="text-xs">サークル：丸サークル</p>
<span class="inline-block text-white bg">同人</span>""" + " " * 2600
PAGE_B = "<title>検索</title>" + " " * 1000 + CARD_B.format(id="d_1", title="題名 &amp; 本") + CARD_B.format(id="d_2", title="二冊目") + CARD_B.format(id="d_1", title="また")
PAGE_C = PAD + """<ul><li class="product_100200"><p class="item-ttl product_title"><a>三冊目 &amp; 本</a></p><p class="item-price">&yen;990</p>
<a href="/circle/index.php?circle_id=5" title="丸サークル">x</a><a href="/s?text_type=author&name=x" title="角作者">x</a>
<a href="/l?category_id=3" title="同人誌">x</a></li><li class="product_100201"><p class="item-price">無料</p></li></ul>"""
PAGE_D = json.dumps({"error": False, "body": {"illustManga": {"total": 2, "data": [
    {"id": "11", "title": " 絵の題名 ", "userName": "絵師", "xRestrict": 1, "url": "https://i.test/1.jpg"}, {"title": "no id"},
    {"id": 12, "title": "二枚目", "userName": "絵師二"}]}}})
PAGE_E = """<div><a class="x" href="/posts/501" title="t">絵師の投稿「<b>題名 &amp; 本</b>」</a><a href="/fanclubs/9">丸クラブ</a></div>
<div><a href="/posts/502">a</a></div><div><a href="/posts/501">絵師の投稿「repeat」</a></div><a href="/posts/503">そのまま</a>"""

BODIES = [
    ("a_ok", "dlsite", PAGE_A, "ok"), ("a_empty", "dlsite", " ", "empty-response"),
    ("a_block", "dlsite", "<title>403 Forbidden</title>", "blocked"), ("a_short", "dlsite", "<p>hi</p>", "unexpected-page"),
    ("a_none", "dlsite", PAD + '<div class="work_not_found">', "not-found"), ("a_odd", "dlsite", PAD, "no-items-parsed"),
    ("b_ok", "fanza", PAGE_B, "ok"), ("b_age", "fanza", '<div id="agecheck">', "age-check"), ("b_none", "fanza", "検索結果 0 件", "not-found"),
    ("b_block", "fanza", "<title>Error 429</title>", "blocked"), ("b_odd", "fanza", "<p>hm</p>", "no-items-parsed"),
    ("c_ok", "melonbooks", PAGE_C, "ok"), ("c_none", "melonbooks", PAD + "該当する商品はありません", "not-found"), ("c_short", "melonbooks", "x", "unexpected-page"),
    ("d_ok", "pixiv", PAGE_D, "ok"), ("d_bad", "pixiv", "<html>", "invalid-json"), ("d_err", "pixiv", '{"error":true,"message":"no"}', "blocked"),
    ("d_err2", "pixiv", '{"error":true}', "unexpected-payload"), ("d_none", "pixiv", '{"body":{"illustManga":{"data":[],"total":0}}}', "not-found"),
    ("d_odd", "pixiv", '{"body":{}}', "no-items-parsed"), ("d_part", "pixiv", '{"body":{"manga":{"data":[],"total":4}}}', "no-items-parsed"),
    ("e_ok", "fantia", PAGE_E, "ok"), ("e_login", "fantia", '<a href="/sessions/signin">', "login-required"),
    ("e_age", "fantia", "年齢確認", "age-check"), ("e_none", "fantia", "検索結果", "not-found"), ("e_odd", "fantia", "", "no-items-parsed"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(n, s, 1, "q", 200, "", b, None) for n, s, b, _ in BODIES]
    return {r.step_id: r for r in R.parse_responses(spark.createDataFrame(rows, schemas.RESPONSES)).collect()}


def test_reasons(parsed):
    assert {n: parsed[n].reason for n, *_ in BODIES} == {n: r for n, _, _, r in BODIES}
    assert parsed["a_none"].ok and not parsed["a_odd"].ok and parsed["a_odd"].item_count == 0


def test_first_store_items(parsed):
    a, c = parsed["a_ok"].items
    assert (a.product_id, a.title, a.url) == ("AA1", "題名の本", "https://www.dlsite.com/x/AA1.html")
    assert (a.maker, a.author, a.category) == ("丸 & 角", "作者 一", "マンガ")
    assert (a.price, a.price_text, a.original_price, a.original_price_text, a.discount_label) == (1100, "1,100円", 2200, "2,200円", "50%OFF")
    assert (a.approx_cny, a.image_url, a.labels) == (48, "https://img.test/a.jpg", ["独占", "割引"])
    assert (c.product_id, c.title) == ("AA3", "short")


def test_other_stores(parsed):
    b = parsed["b_ok"].items
    assert [(x.product_id, x.title, x.price, x.price_text) for x in b] == [("d_1", "題名 & 本", 1234, "¥1,234"), ("d_2", "二冊目", 1234, "¥1,234")]
    assert (b[0].url, b[0].maker, b[0].category) == ("https://www.dmm.co.jp/dc/doujin/-/detail/=/cid=d_1/", "丸サークル", "同人")
    (c,) = parsed["c_ok"].items
    assert (c.product_id, c.title, c.price, c.price_text, c.maker, c.author, c.category) == ("100200", "三冊目 & 本", 990, "¥990", "丸サークル", "角作者", "同人誌")
    d = parsed["d_ok"].items
    assert [(x.product_id, x.title, x.author, x.age_rating, x.price) for x in d] == [("11", "絵の題名", "絵師", 1, None), ("12", "二枚目", "絵師二", 0, None)]
    e = parsed["e_ok"].items
    assert [(x.product_id, x.title, x.maker) for x in e] == [("501", "題名 & 本", "丸クラブ"), ("503", "そのまま", "")]


def test_product_page(spark):
    body = PAD + '<h1 id="work_name">題 <b>名</b></h1><span class="work_price_base">0</span>'
    rows = R.parse_product_page(spark.createDataFrame([("u", body), ("v", "x")], "url string, body string")).orderBy("url").collect()
    assert (rows[0].title, rows[0].price, rows[0].price_text) == ("題 名", 0, "0円") and rows[1].title is None and rows[1].price_text is None


def test_resolution_over_responses(spark, parsed):
    """Captured responses drive the same resolution: first store wins, then stops."""
    from shelflink.plans.resolve import resolve

    rows = [("primary", "dlsite", 1, "題名の本", 200, "", PAGE_A, None), ("search", "fanza", 1, "二冊目", 200, "", PAGE_B, None),
            ("primary", "dlsite", 1, "二冊目", 200, "", PAD + "work_not_found", None), ("female", "dlsite", 2, "二冊目", 200, "", PAD, None),
            ("primary", "dlsite", 1, "無い本だよ", 403, "", "<title>403</title>", None), ("female", "dlsite", 2, "無い本だよ", 403, "", "<title>403</title>", None)]
    p = R.parse_responses(spark.createDataFrame(rows, schemas.RESPONSES))
    pages = spark.createDataFrame(
        [(i, True, "strong-signal", ["x"], (t, "title", t, "high", [], None, [t]), [t], ["絵師"]) for i, t in enumerate(["題名の本", "二冊目", "無い本だよ"])]
        + [(3, False, "site-root", [], ("", None, "", "low", [], None, []), [], [])],
        "page_id int, allowed boolean, reason string, signals array<string>, extraction struct<raw_title:string,source:string,cleaned_title:string,"
        "confidence:string,notes:array<string>,chapter_hint:int,variants:array<string>>, queries array<string>, artists array<string>")
    got = {r.page_id: r for r in resolve(pages, R.store_items(p), R.search_steps(p)).collect()}
    assert (got[0].status, got[0].match.product_id, got[0].match.score, got[0].match.approx_cny, got[0].requests) == ("ok_high", "AA1", 100, 48, 1)
    assert [s.store for s in got[0].stores] == ["dlsite"] and got[0].stores[0].health == "healthy"
    assert (got[1].status, got[1].match.store, got[1].requests, got[1].match.approx_cny) == ("ok_high", "fanza", 3, 54)
    assert [(s.store, s.kind, s.health) for s in got[1].stores] == [("dlsite", "none", "parser-broken"), ("fanza", "high", "healthy")]
    assert got[2].status == "error" and got[2].requests == 7 and got[2].stores[0].health == "blocked"
    assert [l.label for l in got[2].search_links][:1] == ["Pixiv 作者: 絵師"] and [l.label for l in got[0].search_links] == ["DLsite", "Pixiv 作者: 絵師"]
    assert (got[3].status, got[3].state_reason, got[3].requests) == ("unrecognized", "site-root", 0)


def test_other_stores_are_scored_with_what_they_were_asked(spark):
    """The second store is asked the first query only; an item that equals the second one is no match."""
    from shelflink.plans.resolve import resolve

    nothing = PAD + "work_not_found"
    rows = [(step, "dlsite", tier, q, 200, "", nothing, None) for step, tier in (("primary", 1), ("female", 2)) for q in ("月の階段物語", "銀色の帆船日誌")]
    rows.append(("search", "fanza", 1, "月の階段物語", 200, "", "<title>x</title>" + " " * 1000 + CARD_B.format(id="d_7", title="銀色の帆船日誌"), None))
    p = R.parse_responses(spark.createDataFrame(rows, schemas.RESPONSES))
    queries = ["月の階段物語", "銀色の帆船日誌"]
    pages = spark.createDataFrame(
        [(0, True, "strong-signal", ["x"], (queries[0], "title", queries[0], "high", [], None, queries), queries, [])],
        "page_id int, allowed boolean, reason string, signals array<string>, extraction struct<raw_title:string,source:string,cleaned_title:string,"
        "confidence:string,notes:array<string>,chapter_hint:int,variants:array<string>>, queries array<string>, artists array<string>")
    got = resolve(pages, R.store_items(p), R.search_steps(p)).first()
    assert got.status == "no_result" and not {s.kind for s in got.stores} & {"high", "possible"}


def test_items_are_parsed_once(spark):
    """A filter that Spark derives from ``posexplode`` would hold the whole parser several times."""
    parsed = R.parse_responses(spark.createDataFrame(
        [("s", "dlsite", 1, "q", 200, "", PAGE_A, None)], "step_id string, store string, tier int, query string, http_status int, final_url string, body string, ts timestamp"))
    marks = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("work_price_base")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        assert 0 < marks(R.store_items(parsed)) <= marks(parsed.select("items"))
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
        spark.conf.unset("spark.sql.maxPlanStringLength")
