"""Quality classifier and language identification: held-out accuracy, edge cases, the risk itself."""

import random

import numpy as np
import pytest

from shelflink.llm import language as L
from shelflink.llm import quality_pu as Q

SYLLABLES = {"en": "the ing tion er and", "de": "ung sch ich ver ß", "fr": "eau é tion ou que", "es": "ción ñ ll rr los"}


def prose(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(900):
        lang = rng.choice(list(SYLLABLES))
        text, good = prose(rng, lang, rng.randrange(20, 80)), rng.random() < 0.8
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if k % 2 else " ".join([text.split()[0]] * 60)
        rows.append((k, text, lang if k % 7 else None, "s", good))
        if rng.random() < 0.6:
            labels.append((k, int(good), 0))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, score string")
    return docs, spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"), rows


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels, rows = corpus
    model = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.score_documents(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 100 and np.mean([got[r[0]].predicted == int(r[4]) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and 0.7 < model.prior < 0.9
    again = Q.train(docs, labels)
    assert np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 300_000), (2, "")], "doc_id bigint, text string")
    assert len({(r.doc_id, r.score) for r in Q.score_documents(odd, model).collect()}) == 3
    assert Q.score_documents(odd.limit(0), model).collect() == []
    assert Q.keep_good(docs, model).columns == docs.columns
    with pytest.raises(ValueError):
        Q.train(docs, labels.where("quality = 0"))


def test_non_negative_risk_recovers_the_mixture():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 2)), rng.normal(-1.5, 1, (4000, 2))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (2800, 2)), rng.normal(-1.5, 1, (1200, 2))])
    model = Q.fit_nn_pu(good[:2000], unlabelled, prior=0.7)
    assert np.mean(model.scores(good[2000:]) > 0.5) > 0.95 and np.mean(model.scores(bad) < 0.5) > 0.95


def test_language_on_held_out_rows(spark, corpus):
    docs, _, rows = corpus
    model = L.train(docs)
    got = {r.doc_id: r for r in L.predict_languages(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held if r[2]]) > 0.97
    assert model.languages == sorted(SYLLABLES) and np.mean(model.weights == 0) > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 345 !"), (4, "x" * 200_000)], "doc_id bigint, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in L.predict_languages(odd, model).collect()}
    assert [found[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and found[4][0] in SYLLABLES
    assert L.predict_languages(docs.limit(0), model).collect() == []
    nothing = L.train(docs.where("lang is null"))
    assert {r.lang_pred for r in L.predict_languages(odd, nothing).collect()} == {"und"}


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 1, (5000, 3))
    p = L.softmax(logits)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert L.fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


def test_quality_without_a_positive_scores_the_prior(spark, corpus):
    docs, labels, _ = corpus
    for known in (labels.where("quality = 0"), labels.limit(0)):
        model = Q.train_or_prior(docs, known)
        assert all(r.score == pytest.approx(model.prior) for r in Q.score_documents(docs, model).collect())
    assert Q.score_documents(docs.limit(0), Q.train_or_prior(docs.limit(0), labels.limit(0))).collect() == []


def test_only_letters_of_category_l_have_a_language():
    import numpy as np

    from shelflink.llm.language import DIMENSIONS, LanguageModel

    model = LanguageModel(["de", "en"], np.ones(DIMENSIONS), np.zeros((2, DIMENSIONS)), np.zeros(2), 1.0)
    assert [model.predict(t)[0] for t in ("½", "² ①", "123 _", "", None, "ⅷ")] == ["und"] * 6
    assert "und" not in [model.predict(t)[0] for t in ("a", "漢", "ª")]
