import pytest

from shelflink import schemas
from shelflink.config import Config
from shelflink.operators import classify as K

FIELDS = [f.strip().split()[0] for f in "".join(schemas.PAGE_INFO.split("\n")).replace("struct<level:int,tag:string,text:string>", "x").split(",")]
EMPTY = {n: None for n in FIELDS} | {"page_id": 0, "h1": [], "h2": [], "h3": [], "headings": [], "info_fields": [], "image_count": 0, "settled": True}
META1 = "meta:" + K.TOPIC_SIGNALS[0][:24]

CASES = [
    ({}, "no-page-info", []),
    ({"url": "nonsense"}, "invalid-url", []),
    ({"url": "chrome://settings/x"}, "unsupported-scheme", []),
    ({"url": "https://www.pixiv.net/artworks/1"}, "denylisted-host", []),
    ({"url": "https://a.test/search?q=1"}, "denylisted-url", []),
    ({"url": "https://a.test/x", "settled": False}, "page-settling", []),
    ({"url": "https://a.test/?page=2"}, "site-root", []),
    ({"url": "https://a.test/index.html"}, "site-root", []),
    ({"url": "https://a.test/x", "title": "題名 第3話"}, "strong-signal", ["chapter-marker-in-title", "meta:" + K.TOPIC_SIGNALS[1][:24]]),
    ({"url": "https://a.test/x", "text_sample": "Chapter 12 begins"}, "strong-signal", ["chapter-marker-in-page"]),
    ({"url": "https://a.test/x", "info_text": "Tags: a Pages: 12"}, "strong-signal", ["gallery-structure"]),
    ({"url": "https://a.test/g/1", "info_text": "作者: a", "image_count": 8}, "strong-signal", ["gallery-structure", "detail-like-url", "gallery-images"]),
    ({"url": "https://a.test/x", "info_text": "作者: a"}, "no-comic-signal", []),
    ({"url": "https://mymanga.test/g/1"}, "manga-host-detail-url", ["manga-like-host", "detail-like-url"]),
    ({"url": "https://mymanga.test/list"}, "no-comic-signal", ["manga-like-host"]),
    ({"url": "https://a.test/x", "title": "comic", "keywords": "同人"}, "multiple-meta-signals", [META1, "meta:" + K.TOPIC_SIGNALS[2][:24]]),
    ({"url": "https://a.test/view/1", "title": "manga", "image_count": 6}, "detail-page-with-images", [META1, "detail-like-url", "gallery-images"]),
    ({"url": "https://a.test/x", "json_ld_type": "ComicIssue"}, "strong-signal", ["structured-data-book"]),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i, (p, *_ ) in enumerate(CASES):
        p = EMPTY | {"page_id": i, "host": p.get("url", "").split("/")[2] if "//" in p.get("url", "") else ""} | p
        rows.append(tuple(p[n] for n in FIELDS))
    return spark.createDataFrame(rows, schemas.PAGE_INFO)


def test_classification(pages):
    rows = K.classify_pages(pages).orderBy("page_id").collect()
    assert [(r.reason, r.signals) for r in rows] == [(reason, signals) for _, reason, signals in CASES]
    assert [r.allowed for r in rows] == [s not in ("no-comic-signal",) and i >= 8 for i, (_, s, _) in enumerate(CASES)]


def test_forced(pages):
    rows = K.classify_pages(pages, Config(ignore_site_filter=True)).orderBy("page_id").collect()
    assert {r.reason for r in rows[8:]} == {"forced"} and rows[3].reason == "denylisted-host"


def test_denied_host_joins(spark):
    df = spark.createDataFrame([("a.dlsite.com",), ("dlsite.com",), ("notdlsite.com",), ("x.test",), ("",)], "host string")
    assert {r.host for r in K.on_denied_hosts(df).collect()} == {"a.dlsite.com", "dlsite.com"}
    assert {r.host for r in K.off_denied_hosts(df).collect()} == {"notdlsite.com", "x.test", ""}
    own = spark.createDataFrame([("X.test",), ("site.com",)], "entry string")
    assert {r.host for r in K.on_denied_hosts(df, denied=own).collect()} == {"x.test"}
    assert K.off_denied_hosts(df, denied=own).count() == 4
