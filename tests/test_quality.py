"""Quality log on a hand-made resolution: capture -> merge -> judge -> report -> replay."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from shelflink import schemas
from shelflink.config import Config
from shelflink.functions.scores import estimate_cny, resolve_rate
from shelflink.operators import captures as C
from shelflink.operators import fingerprint as P
from shelflink.operators import health as H
from shelflink.operators import identifiers as I
from shelflink.operators import quality as Q
from shelflink.operators import redact as D
from shelflink.operators import replay as RP
from shelflink.operators.cache import cache_key, lookup, within_capacity
from shelflink.operators.classify import classify_pages
from shelflink.operators.clean import effective_queries, work_titles
from shelflink.plans import queries
from shelflink.plans.resolve import resolve
from shelflink.scale import number_rows, stage
from shelflink.sources import reports as R
from tests.test_classify import EMPTY, FIELDS

GALLERY = {"info_text": "Tags: a Pages: 12 Artists: 絵師", "image_count": 50, "h1": ["見出し"], "navigation_type": "spa", "analysis_count": 2}
PAGES = [
    {"url": "https://g.test/g/1", "host": "g.test", "title": "夜明けのノート 第3話", **GALLERY},
    {"url": "https://g.test/g/1", "host": "g.test", "title": "夜明けのノート 第3話", **GALLERY},
    {"url": "https://g.test/g/2", "host": "g.test", "title": "存在しない作品だ", **GALLERY, "navigation_type": "load"},
    {"url": "https://blog.test/posts/9", "host": "blog.test", "title": "my day", "h1": ["my day"]},
]
ITEMS = [("dlsite", "primary", "夜明けのノート", 0, "RJ00000001", "夜明けのノート"), ("dlsite", "primary", "夜明けのノート", 1, "RJ00000002", "別の本")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i, p in enumerate(PAGES):
        p = EMPTY | {"page_id": i} | p
        rows.append(tuple(p[n] for n in FIELDS))
    df = spark.createDataFrame(rows, schemas.PAGE_INFO)
    return stage(df.withColumns({"captured_at": F.expr("timestamp_seconds(1700000000 + page_id)"), "capture_no": F.expr("page_id + 1")}))


@pytest.fixture(scope="module")
def states(spark, pages):
    titled = stage(effective_queries(work_titles(classify_pages(pages))))
    items = spark.createDataFrame(ITEMS, "store string, step_id string, query string, pos int, product_id string, title string")
    cached = spark.createDataFrame([(cache_key_of(spark, "'夜明けのノート', '見出し'"), 2)], "cache_key string, n_items int")
    return {"plain": stage(resolve(titled, items)), "cached": resolve(titled, items, cached=cached)}


def cache_key_of(spark, q):
    return spark.range(1).select(F.expr(cache_key("'dlsite'", f"array({q})"))).first()[0]


@pytest.fixture(scope="module")
def built(pages, states):
    return stage(C.build_captures(pages, states["plain"]))


def test_states(states):
    rows = {r.page_id: r for r in states["plain"].collect()}
    assert (rows[0].status, rows[0].match.score, rows[0].requests, rows[0].repeat_requests) == ("ok_high", 100, 1, 0)
    assert (rows[2].status, rows[2].requests, rows[2].repeat_requests) == ("no_result", 8, 8)
    assert (rows[3].status, rows[3].state_reason, rows[3].requests) == ("unrecognized", "no-comic-signal", 0)
    hit = {r.page_id: r for r in states["cached"].collect()}[0]
    assert (hit.status, hit.requests, hit.from_cache, hit.stores[0].health) == ("ok_high", 0, True, "healthy")


def test_captures(built):
    rows = {r.capture_no: r for r in built.collect()}
    a, c, d = rows[1], rows[3], rows[4]
    assert (a.id, a.page_key, a.url_pattern, a.fingerprint) == ("QA-0001", "https://g.test/g/1", "/g/:id", "G-H1-NOG-NJ-IMG40-INFO-SPA")
    assert (a.category, a.novelty.score, rows[2].novelty.score) == ("spa-gallery", 100, 0)
    assert a.match.grade == "found" and a.stores.results == {"dlsite": "found"} and a.stores.match_scores == {"dlsite": 100}
    assert a.results["navigation"] == "PASS" and a.results["storeSearch"] == "PASS" and a.results["correctMatch"] == "NOT_TESTED"
    # structure 3 differs from 1 in navigation (2) and chapter marker (1)
    assert c.novelty.max_similarity == pytest.approx(0.8) and c.novelty.score == 20 and c.novelty.verdict == "duplicate"
    assert d.page_type == "article" and d.results["pageRecognition"] == "FAIL" and d.results["requestCount"] == "PASS"
    assert a.extract.artists == ["絵師"] and a.requests.by_store == {"dlsite": 1}


def test_novelty_against_plain_definition(spark):
    import random

    rng = random.Random(1)
    rows = [
        (i, (rng.choice(["gallery", "reader"]), *(rng.random() < 0.5 for _ in range(3)), "IMG0", rng.random() < 0.5, rng.random() < 0.5, True, rng.choice(["ja", "zh"]), "short"))
        for i in range(1, 41)
    ]
    f = "page_type:string,h1:boolean,og_title:boolean,json_ld:boolean,image_bucket:string,gallery_info:boolean,spa_navigation:boolean,chapter_marker:boolean,lang_family:string,title_bucket:string"
    df = spark.createDataFrame(rows, f"capture_no bigint, features struct<{f}>")
    got = {r.capture_no: r for r in P.novelty(df).collect()}
    weight = dict(zip([x.split(":")[0] for x in f.split(",")], [3, 1.5, 1, 2, 1.5, 2, 2, 1, 0.5, 0.5]))
    for i, t in rows:
        sims = [sum(w for w, a, b in zip(weight.values(), t, u) if a == b) / 15 for j, u in rows if j < i]
        assert got[i].novelty.max_similarity == round(max(sims, default=0), 3)
        assert got[i].novelty.score == int((1 - max(sims, default=0)) * 100 + 0.5)
        assert {s.similarity for s in got[i].novelty.similar_to} == {round(s, 3) for s in sims if s >= 0.85}


def test_merge_and_judge(spark, built):
    merged = {r.page_key: r for r in C.merge_captures(built).collect()}
    m = merged["https://g.test/g/1"]
    assert (m.id, m.visits, m.requests.analyses, m.novelty.score, m.results["cacheBehavior"]) == ("QA-0001", 2, 2, 100, "NOT_TESTED")
    assert [o.requests for o in m.requests.observations] == [1, 1]
    assert [r.id for r in C.newest_captures(built, Config(max_captures=2)).collect()] == ["QA-0004", "QA-0003"]
    j = spark.createDataFrame([("https://g.test/g/2", 1, "PASS", None, "old"), ("https://g.test/g/2", 2, None, None, "n" * 400), ("https://g.test/g/1", 3, None, True, None)],
                              "page_key string, at int, verdict string, false_positive boolean, note string")
    judged = {r.capture_no: r for r in C.apply_judgements(built, j).collect()}
    assert judged[3].verdict == "PASS" and len(judged[3].note) == 301
    assert judged[1].verdict == "FAIL" and judged[1].match.false_positive and judged[1].results["falsePositive"] == "FAIL"


def test_merge_keeps_evidence_and_first_judgement(spark, built):
    """A hit on the second of nine visits, and a verdict given on the first, are there at the end."""
    one = built.where("capture_no = 1").drop("capture_no", "verdict", "note")
    seen = F.transform("requests.observations", lambda o: o.withField("cache_hit", F.col("capture_no") == 2))
    log = spark.range(1, 10).withColumnRenamed("id", "capture_no").crossJoin(F.broadcast(one))
    log = log.withColumns({"requests": F.col("requests").withField("observations", seen), "verdict": F.when(F.col("capture_no") == 1, "PASS").otherwise("FAIL"), "note": F.concat(F.lit("n"), F.col("capture_no")),
                           "match": F.col("match").withField("false_positive", F.when(F.col("capture_no") == 1, True))})
    m = C.merge_captures(log).first()
    assert (m.visits, m.results["cacheBehavior"], m.verdict, m.note, m.match.false_positive) == (9, "PASS", "PASS", "n1", True)
    assert len(m.requests.observations) == 6 and not any(o.cache_hit for o in m.requests.observations)


def judged(spark, built):
    j = spark.createDataFrame([("https://g.test/g/1", 3, None, True, None)], "page_key string, at int, verdict string, false_positive boolean, note string")
    return C.apply_judgements(built, j)


def test_summary_and_failures(spark, built):
    done = judged(spark, built)
    s = Q.summary(done).first()
    assert (s.total, s.fail, s.not_tested, s.false_positive, s.match_precision, s.page_recognition_rate) == (4, 2, 2, 2, 0.0, 0.75)
    assert (s.requests, s.requests_per_capture, s.zero_request_captures, s.over_budget, s.new_structures) == (10, 2.5, 1, 0, 2)
    assert {r.store: r.requests for r in Q.requests_by_store(done).collect()}["dlsite"] == 5
    assert max(r["count"] for r in Q.structures(done).collect()) == 2 and Q.structures(done, Config(max_structures=1)).count() == 1
    assert {r.field: r.failures for r in Q.failure_breakdown(done).collect()} == {"(all)": 2, "(falsePositive)": 2, "falsePositive": 2}
    assert sorted(r.id for r in Q.compact_failures(done).collect()) == ["FAIL-001", "FAIL-002"]
    cases = C.create_cases(done.where(C.is_failure()), start=7)
    assert [(r.id, r.capture_id, r.expected.correct_match) for r in cases.orderBy("id").collect()] == [("RW-007", "QA-0001", False), ("RW-008", "QA-0002", False)]
    assert C.next_case_number(cases).first().next_case == 9
    assert Q.summary(done, cases).first().cases == 2


def test_redaction(spark, built):
    d = D.redaction_dictionary(D.values_of(built))
    labels = {r.value: r.label for r in d.collect()}
    assert labels["夜明けのノート 第3話"] == "<title-1>" and len(set(labels.values())) == len(labels)
    rows = {r.capture_no: r for r in D.redact(built, d).collect()}
    text = json.dumps([r.asDict(True) for r in rows.values()], ensure_ascii=False, default=str)
    assert "夜明け" not in text and "g.test/g" not in text and "絵師" not in text
    assert rows[1].match.product_title == rows[1].extract.cleaned_title == labels["夜明けのノート"]
    u = D.redaction_dictionary(spark.createDataFrame([("https://a.b/g/1/averylongsegment", 5), ("nope", 1)], "value string, seen bigint"), "url")
    assert {r.value: (r.label, r.host, r.path) for r in u.collect()} == {"https://a.b/g/1/averylongsegment": ("<url-2>", "a.b", "/g/:id/:slug"), "nope": ("<url-1>", "", "")}


def test_number_rows(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5003 as k").distinct()
    got = number_rows(df, "k", "n", bucket_rows=50).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(1, len(got) + 1))


def test_reports_round_trip(spark, built, tmp_path):
    done = judged(spark, built)
    cases = stage(C.create_cases(done))
    R.write_summary(done, cases, str(tmp_path / "s"))
    R.write_failures(done, str(tmp_path / "f"))
    R.write_case_pack(done, cases, str(tmp_path / "p"), include_real=True)
    written = "".join(f.read_text() for f in (tmp_path / "s").rglob("*.json")) + "".join(f.read_text() for f in (tmp_path / "f").rglob("*.json"))
    assert "夜明け" not in written and len("".join(f.read_text() for f in (tmp_path / "s" / "summary").rglob("*.json"))) < 8000
    real = R.case_pack(done, cases, include_real=True)
    public, private, sites = R.import_case_pack(real)
    assert {r.id: r.dir for r in public.collect()} == {"RW-001": "navigation", "RW-002": "navigation", "RW-003": "extraction", "RW-004": "negative"}
    assert private.count() == 4 and sites.count() == 4
    assert R.import_case_pack(R.case_pack(done, cases))[2].count() == 0
    R.write_imported(real, str(tmp_path / "public"), str(tmp_path / "private"))
    assert (tmp_path / "public" / "dir=navigation").exists()


def test_case_files_and_exports(spark, tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))

    put("c/cleaning/a.json", {"id": "RW-002", "category": "x"})
    put("c/zz/b.json", {"id": "RW-002", "category": "y"})
    put("c/extraction/c.json", {"id": "RW-001", "features": {"h1": True}})
    put("c/extraction/d.json", {"id": "OTHER"})
    got = R.load_cases(spark, str(tmp_path / "c")).collect()
    assert [(r.id, r.dir) for r in got] == [("RW-001", "extraction"), ("RW-002", "cleaning")] and got[0].features.h1
    fail = lambda i, g, **k: {"id": i, "failed_fields": ["a"], "grade": g, "requests": 2, **k}
    put("e/s1.json", {"kind": "qa-summary", "generated_at": "2026-01-01", "failures": [fail("F1", "old"), fail("F3", "only-index")], "cases": [{"id": "RW-1", "category": "listed"}]})
    put("e/s2.json", {"kind": "qa-summary", "generated_at": "2026-01-02", "summary": {"total": "9"}, "cases": [{"id": "RW-2", "category": "listed"}]})
    put("e/f1.json", {"kind": "qa-failures", "generated_at": "2026-01-01", "failures": [fail("F1", "v1")]})
    put("e/f2.json", {"kind": "qa-failures", "generated_at": "2026-01-03", "failures": [fail("F1", "v2", health={"dlsite": "blocked", "fanza": "healthy"}, fingerprint="G-X", false_positive=True)]})
    put("e/t.json", {"kind": "qa-tests", "generated_at": "2026-01-01", "cases": [{"id": "RW-9", "category": "packed", "source": {"verdict": "PASS"}}]})
    put("e/x.json", {"kind": "else"})
    put("e/bad.json", "{nope")
    exports = R.load_exports(spark, str(tmp_path / "e"))
    assert sorted((r.file.rsplit("/", 1)[1], r.route) for r in exports.collect()) == [
        ("bad.json", "unknown"), ("f1.json", "failures"), ("f2.json", "failures"), ("s1.json", "summary"), ("s2.json", "summary"), ("t.json", "tests"), ("x.json", "unknown")]
    summary, cases, failures = R.merge_exports(exports)
    assert summary.first().summary == {"total": "9"}
    assert {r.id: r.category for r in cases.collect()} == {"RW-2": "listed", "RW-9": "packed"}
    f = {r.id: r for r in failures.collect()}
    assert f["F1"].reason == "fields=a · grade=v2 · falsePositive · G-X · requests=2 · dlsite:blocked" and not f["F3"].has_bundle and set(f) == {"F1", "F3"}


def test_replay(spark, pages, states):
    feats = P.page_features(pages).select("page_id", "features", "fingerprint")
    withf = states["plain"].join(feats, "page_id")
    blank = {"page_recognition": None, "store_search": None, "correct_match": None, "false_positive": None, "grade": "", "cleaned_title": "", "max_requests": None, "limitation": False}

    def e(**given):
        return tuple((blank | given).values())

    g = ("gallery", True, False, False, True, True, True)
    rows = [
        ("RW-001", "extraction", g, e(page_recognition=True, grade="found", cleaned_title="夜明けのノート", max_requests=1), 0),
        ("RW-002", "matching", g, e(grade="none"), 1),
        ("RW-003", "extraction", g[:6] + (False,), e(correct_match=True), 2),
        ("RW-004", "negative", ("article", True, False, False, False, False, False), e(page_recognition=False, correct_match=False), 3),
        ("RW-005", "extraction", g, e(), 99),
        ("RW-006", "matching", g, e(grade="none", limitation=True), 0),
        ("RW-007", "matching", ("reader",) + g[1:], e(grade="found"), 0),
    ]
    cases = spark.createDataFrame(rows, f"id string, dir string, features {R.FEATURES}, expected {R.EXPECTED}, page_id bigint")
    out = RP.replay(cases, withf)
    got = {r.id: r for r in out.collect()}
    assert {k: v.verdict for k, v in got.items()} == {
        "RW-001": "PASS", "RW-002": "FAIL", "RW-003": "FAIL", "RW-004": "PASS", "RW-005": "NOT_TESTED", "RW-006": "EXPECTED_LIMITATION", "RW-007": "FAIL"}
    assert got["RW-002"].failed_fields == ["correctMatch", "falsePositive"] and got["RW-002"].failure_id == "FAIL-002"
    assert got["RW-003"].failed_fields == ["correctMatch", "falseNegative", "cacheBehavior"] and got["RW-007"].mismatches == ["page_type"]
    s = {r.dir: r for r in RP.replay_summary(out).collect()}
    assert (s["(all)"].total, s["(all)"]["pass"], s["(all)"].fail, s["(all)"].cache_missed, s["matching"].total) == (7, 2, 3, 1, 3)


def test_scan(spark):
    text = "id RJ12345678 and RJ00000001\n/g/12345/ ?product_id=99999\n%E3%81%82%E3%81%84 %41%42 %FF%FE\nRJ99999999 anonymity-lint: allow Secret Name\nx RJ12345678"
    docs = spark.createDataFrame([(1, text), (2, "漢字かな と b 漢字かな 一")], "doc_id bigint, text string")
    deny = spark.createDataFrame([("secret name",), ("zz",)], "entry string")
    got = sorted((r.line, r.column, r.kind, r.match) for r in I.scan(docs, ["99999"], deny).collect())
    assert got == [(1, 4, "product-id", "RJ12345678"), (2, 1, "gallery-id", "/g/12345/"[:-1]), (3, 1, "encoded-text", "%E3%81%82%E3%81%84"),
                   (4, 34, "denylisted", "secret name"), (5, 3, "product-id", "RJ12345678")]
    assert sorted(r.run for r in I.cjk_runs(docs).where("doc_id = 2").collect()) == ["漢字かな"]
    # a long list gives the same findings, no list of either length is written into the plan
    long = deny.unionAll(spark.range(20_000).selectExpr("concat('entry ', id, ' nobody wrote') as entry"))
    found = [I.scan(docs, ["99999"], d).where("kind = 'denylisted'") for d in (deny, long)]
    assert [sorted((r.line, r.column) for r in f.collect()) for f in found] == [[(4, 34)]] * 2
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in found]
    assert all("INSET" not in x and " IN (" not in x for x in plans)


def test_small_scalars(column, spark):
    assert column(lambda c: estimate_cny(c, "0.044"), [None, 0, 1, 1000, 1234], "int") == [None, 0, 1, 44, 54]
    rates = [None, "", " 0.05 ", "abc", 5, 0.0437000000001, -1]
    assert [resolve_rate(Config(cny_per_jpy=r)) for r in rates] == [0.044, 0.044, 0.05, 0.044, 0.044, 0.0437, 0.044]
    assert Config().with_overrides({"high": 90, "unknown": 1}, {"possible": None}).high == 90
    df = spark.createDataFrame([(200, "ok", 3), (403, "", 0), (200, "not-found", 0), (200, "", 0), (404, "", 0), (0, "network-error", 0), (200, "ok", 0)], "http_status int, reason string, item_count int")
    assert [r.h for r in df.select(F.expr(H.step_health()).alias("h")).collect()] == ["healthy", "blocked", "no-result", "parser-broken", "search-failed", "search-failed", "no-result"]


def test_cache_lookup(spark):
    e = spark.createDataFrame([("a", 100, 3), ("b", 100, 0)], "cache_key string, s bigint, n_items int").withColumn("at", F.expr("timestamp_seconds(s)"))
    q = spark.createDataFrame([("a", 1900), ("a", 1901), ("b", 400), ("b", 401), ("c", 1)], "cache_key string, s2 bigint").withColumn("ts", F.expr("timestamp_seconds(s2)"))
    got = {(r.cache_key, r.s2): (r.entry_found, r.cache_hit) for r in lookup(q, e).collect()}
    assert got == {("a", 1900): (True, True), ("a", 1901): (False, False), ("b", 400): (True, False), ("b", 401): (False, False), ("c", 1): (False, False)}
    assert [r.cache_key for r in within_capacity(e, Config(cache_entries=1)).collect()] == ["a"]


def test_identifier_scan_returns_encoded_text(spark, tmp_path):
    """Against plain decoding of every run of escapes."""
    rng = random.Random(8)
    pieces = ["%E3%81%82", "%e4%bd%a0", "%C3%A9", "%52%4A", "%C3", "%FF%FE", "%ED%A0%80", "%F0%9F%98%80", "%", "/g/", " ", "a", "\n", "anonymity-lint: allow"]
    texts = ["".join(rng.choices(pieces, weights=[4] * 8 + [2] * 5 + [1], k=rng.randrange(12))) for _ in range(400)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for k, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n"), 1):
            for run in re.findall(r"(?:%[0-9A-Fa-f]{2}){2,}", "" if "anonymity-lint: allow" in line else line):
                try:
                    if not bytes.fromhex(run.replace("%", "")).decode().isascii():
                        want.append((k, n, run))
                except UnicodeDecodeError:
                    pass
    got = queries.identifier_scan(spark, str(tmp_path)).where("kind = 'encoded-text'").collect()
    assert len(want) > 50 and sorted((r.doc_id, r.line, r.match) for r in got) == sorted(want)
