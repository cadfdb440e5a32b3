import pytest
from pyspark.sql import functions as F

from shelflink.operators import extract as E

GALLERY = """<!DOCTYPE html><html lang="ja"><head>
<meta charset="utf-8"><meta content="  題名 &amp; 副題 " property="og:title"/>
<meta name="description" content=""><meta property="og:description" content="説明">
<meta property='og:site_name' content='Site'>
<link rel="canonical" href="/g/77"><meta property="og:url" content="https://x.test/g/77/">
<title>
  題名 &amp; 副題 | Site</title>
<script type="application/ld+json"><!-- {"@graph":[{"@type":"WebPage"},{"@type":["Book","CreativeWork"],"headline":"LD題名","author":[{"name":"作家"}]}]} --></script>
<script type="application/ld+json">{broken</script>
<script>var t = "<h1>not a title</h1>";</script></head>
<body><!-- <h1>hidden</h1> --><div id="info"><h1>題名</h1><div class="sub title">別題</div>
<h2>題名</h2><h2>Second <b>one</b></h2></div>
<div role="heading" aria-level="2">役割</div>
<div id="tags"><div>Tags: <a>one</a></div><div>Languages: Japanese Pages: 24</div></div>
<main><p>本文 第3話</p><div>more</div></main><img src=1><IMG src=2></body></html>"""

PLAIN = "<html><head><title>t</title></head><body><p>one</p> two&nbsp;three</body></html>"


@pytest.fixture(scope="module")
def info(spark):
    pages = spark.createDataFrame(
        [(1, "https://x.test/g/77/?p=2", GALLERY), (2, "https://x.test/other", PLAIN),
         (3, "https://x.test/other", PLAIN.replace("<head>", '<head><link href="https://x.test/else" rel=canonical>')),
         (4, "https://x.test/w/1/2", PLAIN.replace("<head>", '<head><meta property="og:url" content="https://x.test/w/1">'))],
        "page_id bigint, url string, html string",
    )
    return {r.page_id: r for r in E.extract_pages(pages).collect()}


def test_head_values(info):
    r = info[1]
    assert r.title == "題名 & 副題 | Site"
    assert (r.og_title, r.description, r.site_name, r.og_url) == ("題名 & 副題", "説明", "Site", "https://x.test/g/77/")
    assert (r.json_ld_name, r.json_ld_type, r.json_ld_author) == ("LD題名", "Book,CreativeWork", "作家")
    assert (r.lang, r.image_count, r.canonical_url) == ("ja", 2, "/g/77")


def test_headings(info):
    r = info[1]
    assert [(h.level, h.tag, h.text) for h in r.headings] == [
        (1, "h1", "題名"), (2, "h2", "Second one"), (2, "div", "役割"), (3, "div", "別題"),
    ]
    assert (r.h1, r.h2, r.h3) == (["題名"], ["題名", "Second one"], [])


def test_blocks(info):
    r = info[1]
    assert r.info_text == "Tags: one Languages: Japanese Pages: 24".replace("one Lang", "oneLang")
    assert r.info_fields == ["tag", "page"]
    assert r.text_sample == "本文 第3話more"
    assert info[2].text_sample == "one two three"
    assert info[2].info_text == ""


def test_settled(info):
    assert [info[i].settled for i in (1, 2, 3, 4)] == [True, True, False, True]


def test_nested_blocks(spark):
    html = '<div class="x info"><div>Tags: a</div> <div>Pages: 12 here</div></div><p>after</p>'
    df = spark.createDataFrame([(html,)], "doc string")
    from shelflink.functions import html as H

    assert df.select(F.expr(H.info_text("doc"))).first()[0] == "Tags: a Pages: 12 here"


def test_signature_and_replay(spark, info):
    from shelflink import schemas

    df = spark.createDataFrame([info[1]], schemas.PAGE_INFO)
    row = E.content_signature(df).first()
    assert row.signature.startswith("題名 & 副題 | Site::題名 | 題名 | Second one::Tags: one") and "::2::" in row.signature
    long = df.withColumn("title", F.repeat(F.lit("x"), 400)).withColumn("analysis_count", F.lit(0))
    out = E.replay_projection(long).first()
    assert out.title == "x" * 300 + "…" and out.analysis_count == 1 and len(out.headings) == 4
