"""Rendering: implied tags, visibility, lists, tables, and odd pages."""

import pytest

from shelflink.llm import html_render as H

CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<head><title>t</title></head><body>x", "x"), ("a<!-- b -->c", "ac"), ("a<!-- never closed", "a"),
    ("<script>var a='</p>'</script>b<style>p{}</style>", "b"), ("<b>a</b> <i>b</i>", "a b"), ("  a \n b\t c ", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>i<li>j</ol>", "9. i\n10. j"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
    ("<table><tr><th>h</th></tr><tr><td>x<table><tr><td>in</table></td></tr></table>", "h\nx\nin"),
    ("<p hidden>a</p><p style='color:red;display: none'>b</p><p>c</p>", "c"), ("<style>.ad, #x{display:none}</style><div class='k ad'>a</div><i id=x>b</i>c", "c"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("</div></p>x</b>", "x"), ("<td>loose", "loose"), ("a < b", "a < b"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"), ("<input type=hidden value=a><input value=b>", "b"), ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_render(page, want):
    assert H.render(page) == want


def test_deep_and_long_pages():
    assert H.render("<div>" * 20_000 + "x") == "x"
    assert H.render("<p>" + "word " * 100_000).count("word") == 100_000
    assert len(H.render("<b>" * 3000 + "<p>a" * 3000).split()) == 3000


def test_every_visible_word_is_kept_in_order(spark):
    pages = spark.createDataFrame([(1, "u", "<nav><ul><li><a href=x>n1</a></ul></nav><article><h1>h</h1><p>a <b>b</b><br><p>c</article><footer>&copy; f</footer>", 1), (1, None, None, 2)], "page_id bigint, url string, html string, text int")
    rows = sorted(H.extract_text(pages).collect(), key=lambda r: r.n_chars)
    assert rows[0].text == "" and rows[1].text.split() == "- n1 h a b c © f".split() and rows[1].n_chars == len(rows[1].text)
    assert H.extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<style>@media print{.main{display:none}} .ad{display:none}</style><div class=main>a</div><div class=ad>b</div>", "a"),
    ("<style>@media (max-width:600px){nav{display:none} .x{color:red}}@supports (a:b){@media screen{nav{display:none}}}</style><nav>a</nav>", "a"),
    ("<style>@import 'a;{.css'; @media screen{.x{display:none}} p{color:red}</style><p class=x>a</p>b", "b"),
    ("<style media=print>p{display:none}</style><p>a", "a"), ("<style>@font-face{src:url(x)} .x{color:red;display:none;top:0}</style><p class=x>a</p>b", "b"),
    ("<style>.main{display:none}</style><style>.main{display:block}</style><p class=main>a", "a"),
    ("<style>.main{display:block}.main{display:none}</style><p class=main>a</p>b", "b"),
    ("<style>p{display:none}.x{display:block}p{display:none}</style><p class=x>a<p>b</p>c", "a\n\nc"),
    ("<style>.x{display:none!important}.x{display:block}</style><p class=x>a</p>b", "b"), ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
    ("<style>/* .x{display:none} */.y{content:'}.x{display:none}'}</style><p class=x>a", "a"),
    ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>.", "so x=2."), ("<svg><title>t</title><defs><text>d</text></defs><text>sales</text><text>costs</text></svg>", "sales costs"), ("<style>.x{display:flex}</style><p hidden class=x>a", "a"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b |  | c\nd |   |  | e\nf |   |  | g"),
    ("<table><thead><tr><th rowspan=9>a<th>b</thead><tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
])
def test_conditional_rules_drawings_and_rowspan(page, want):
    assert H.render(page) == want


def test_deep_tables_and_tags_that_never_end():
    import time

    deep = "<table><tr><td>" * 3000 + "inside" + "</td></tr></table>" * 3000
    assert "inside" in H.render(deep)
    for page in ("<a " * 100_000, "<a href=\"" * 60_000, "<a \">\" " * 40_000 + "\"", "<" * 200_000, "<!x" * 60_000, "<a ''" * 60_000):
        start = time.time()
        H.render("<p>first</p>" + page)
        assert time.time() - start < 6
    assert H.render("<p title=\"a > b\">shown</p><b title='>'>too</b>") == H.render("<p>shown</p><b>too</b>")
    assert H.render("one <b>two</b> <i three") == "one two <i three"
