"""Each stage of the pipeline against brute force on its own input."""

import random
from fractions import Fraction

import corpus_pipeline as P
import pytest

from shelflink.llm import quality_pu

from .test_exact_dedup import plain as plain_copies
from .test_mixing import plain as plain_mix
from .test_ngram_jaccard import brute


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubdkst") for _ in range(rng.randrange(2, 7)))
    rows, labels = [], []
    for k in range(260):
        kind, base = rng.randrange(8), rows and rng.choice(rows)[1] or "first text of all"
        text = " ".join(word() for _ in range(rng.randrange(30, 90)))
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            text = base.replace(" ", "\n", 1)
        elif kind == 2:
            own = base.split()
            own[rng.randrange(len(own))] = word()
            text = " ".join(own)
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(text)))
        if rng.random() < 0.7:
            labels.append((k, int(not text.isupper()), 0))
    rows += [(900, None, None, None, 0), (901, "", "en", "s1", 0)]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        kept.append((name, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]))
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return dict(kept), docs, folder


def test_the_stages_are_the_dealt_ones(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "sentencepiece"] and P.ORACLE_SQL is None


def test_quality_drops_what_the_model_rejects(spark, stages):
    inputs, _, folder = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_pu.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality_pu.score_documents(docs, model).where("predicted = 1").collect()}
    assert {r[0] for r in inputs["exact_dedup"]} == good
    loud = {d for d, t, _ in inputs["quality"] if t and t.isupper()}
    prose = {d for d, t, _ in inputs["quality"] if t and not t.isupper()}
    assert len(good & loud) <= 0.1 * len(loud) and len(good & prose) >= 0.97 * len(prose)


def test_duplicates_go(stages):
    inputs, *_ = stages
    rows = [r[:2] for r in inputs["exact_dedup"]]
    assert {r[0] for r in inputs["near_dedup"]} == {x[0] for x in plain_copies(rows) if x[3]}
    rows = [r[:2] for r in inputs["near_dedup"]]
    assert {r[0] for r in inputs["mix"]} == {d for d, _, c in brute(rows, 5, Fraction(4, 5)) if d == c}


def test_mix_repeats_as_planned(stages):
    inputs, *_ = stages
    _, taken = plain_mix(inputs["mix"])
    size = {d: len((t or "").split()) for d, t, _ in inputs["mix"]}
    found = {d: 0 for d in size}
    for d, *_ in inputs["sentencepiece"]:
        found[d] += size[d]
    assert found == taken


def test_every_text_is_encoded(stages):
    inputs, encoded, _ = stages
    rows = encoded.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in inputs["sentencepiece"]) and all(r.round_trip for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    _, encoded, folder = stages
    assert sorted((r.doc_id, tuple(r.ids)) for r in P.run(spark, folder).collect()) == sorted((r.doc_id, tuple(r.ids)) for r in encoded.collect())


def test_empty_tables_pass_all_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
