import time

from pyspark.sql import functions as F

from shelflink.functions import text as X
from shelflink.functions import urls as U
from shelflink.functions.sql import quote
from shelflink.scale import spread


def test_decode_entities(column):
    assert column(X.decode_entities, ["a &amp;lt; b", "&#x3042;&#65;", "&nope; &#1114112; &", None, "&YEN;100"]) == [
        "a &lt; b", "あA", "&nope; &#1114112; &", "", "¥100",
    ]


def test_spaces_and_tags(column):
    assert column(X.collapse_spaces, ["　a   b\t", None]) == ["a b", ""]
    assert column(X.strip_tags, ["<b>x</b>&lt;y&gt;<br>z"]) == ["x <y> z"]


def test_match_and_store_forms(column):
    assert column(X.match_form, ["ABC　~テスト！ No5", "", None]) == ["abcテストno5", "", ""]
    assert column(X.store_form, ["青い鳥！再会 第2巻", "本・総集編", "plain"]) == ["青い鳥 再会 第2巻", "本 総集編", "plain"]


def test_chapters(column):
    assert column(X.strip_chapters, ["題名 第12话", "題名 Vol.3", "題名 (3/12)", "題名 - 7", "題名 第十二話", "題名 全12巻"]) == [
        "題名", "題名", "題名", "題名", "題名", "題名 全",
    ]
    assert column(X.chapter_number, ["題名 第12话", "x Chapter 7", "x #41", "無し", "3巻"]) == [12, 7, 41, None, 3]


def test_decoration(column):
    assert column(X.strip_decorations, ["【PC版】題名（完）", "[a][b][c][d]題名", "題名"]) == ["題名", "[d]題名", "題名"]


def test_bigrams_and_measures(column):
    assert column(X.bigrams, ["a😀b", "x", ""]) == [["a😀", "😀b"], ["x"], []]
    assert column(X.meaningful_length, ["a b!漢"]) == [3]
    assert column(X.has_meaningful_chars, ["!!", "漢", "1"]) == [False, True, True]
    assert column(lambda c: X.truncate(c, 4), ["abcde", "abcd"]) == ["abc…", "abcd"]
    assert column(X.script_of, ["漢a1", "あ", "!", "x"]) == ["cjk+latin+digit", "cjk", "none", "latin"]
    assert column(X.lang_family, ["漢あ", "漢", "x", "1", ""]) == ["ja", "zh", "latin", "none", "none"]


def test_short_hash_matches_published_fnv_vectors(column):
    assert column(X.short_hash, ["", "a", "foobar"]) == ["811c9dc5", "e40c292c", "bf9cf968"]


def test_url_parts(column):
    urls = ["https://User@Ex.COM:443/g/000123/?q#f", "http://h:8080", "nope", None]
    assert column(U.origin_of, urls) == ["https://ex.com", "http://h:8080", "", ""]
    assert column(U.page_key, urls) == ["https://ex.com/g/000123", "http://h:8080", "nope", ""]
    assert column(U.url_pattern, urls) == ["/g/:id/", "/", "", ""]
    assert column(U.url_pattern, ["http://h/doujinshi/some-very-long-slug-7.html#1", "http://h/a/b/c/d/e", "http://h/ab12/x"]) == [
        "/doujinshi/:slug.html", "/a/b/c/d/…", "/:slug/x",
    ]
    assert column(U.host_suffixes, ["a.b.c", ""]) == [["a.b.c", "b.c", "c"], [""]]
    assert column(U.store_of_url, ["https://www.pixiv.net/x", "https://notpixiv.net/", "https://al.dmm.co.jp/"]) == ["pixiv", "other", "fanza"]


def test_search_urls(column):
    q = lambda s, st: (lambda c: U.search_url(quote(s), quote(st), c))
    assert column(q("dlsite", "primary"), ["a b"]) == ["https://www.dlsite.com/books/fsr/=/language/jp/keyword/a+b/"]
    assert column(q("fanza", "search"), ["a b'"]) == ["https://www.dmm.co.jp/search/=/searchstr=a%20b'/"]
    assert column(U.artist_search_url, ["名"]) == ["https://www.pixiv.net/search/users?nick=%E5%90%8D&s_mode=s_usr"]


def test_nfkc(spark):
    df = spark.createDataFrame([("ＡＢＣ ①",), ("plain",), (None,)], "v string")
    assert [r[0] for r in df.select(X.nfkc("v")).collect()] == ["ABC 1", "plain", None]


def test_blanks_inside_a_text_are_tried_once(column):
    """From each of its places on, a run of 300,000 blanks takes minutes."""
    start = time.time()
    assert column(X.trim_blanks, ["\t a" + " " * 300_000 + "b　", " \n ", "", None, "x \u0085", "a\r\n"]) == [
        "a" + " " * 300_000 + "b", "", "", None, "x\u0085", "a",
    ]
    assert time.time() - start < 30


def test_spread_deals_rows_over_tasks(spark):
    dealt = spread(spark.range(10_000).coalesce(1), rows_per_task=1_000)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and sum(sizes) == 10_000 and max(sizes) < 2_000
    assert spread(spark.range(0)).count() == 0


def test_short_hash_reads_a_long_text_once(column):
    """Counting to each unit from the start of the text again takes minutes here."""
    start, value = time.time(), "a題" * 100_000
    h = 2166136261
    for ch in value:
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    assert column(X.short_hash, [value, "", None]) == [f"{h:08x}", "811c9dc5", "811c9dc5"]
    assert time.time() - start < 30
