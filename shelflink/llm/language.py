"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into ``DIMENSIONS`` columns.  Document frequencies
are counted over all documents of the learning folds.  Weights are trained on a bounded sample
(at most ``per_language`` documents a language, chosen by a hash of the id) by
follow-the-regularised-leader: per-coordinate rates, an L1 part that keeps weights at zero and an
L2 part that keeps them small.  A fifth of the sample is set aside to fit one temperature, which
makes the scores calibrated probabilities.  Prediction is one pass over all whole texts.

Edge cases: null text and text without a letter give ``und`` with score 0; rows with null lang
are never learned from; repeated rows get equal answers; extra columns are ignored; an empty table
gives an empty result; without any learning row the model knows no language and answers ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

DIMENSIONS = 1 << 15
#: Slices of each language from which its sample is merged.
SAMPLE_SLICES = 64
_LETTER = regex.compile(r"\p{L}")
_U = np.uint64


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs; runs of blanks count as one space at either end too."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    code = np.zeros(len(c), dtype=np.uint64)
    for size in (1, 2, 3):
        code = (code[: len(c) - size + 1] + c[size - 1 :] + _U(1)) * _U(0x9E3779B97F4A7C15)
        total += np.bincount((code >> _U(40)).astype(np.int64) & (DIMENSIONS - 1), minlength=DIMENSIONS)
        code = code ^ (code >> _U(29))
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and TF-IDF values (length 1) of a text."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    return at, values / max(np.sqrt(np.sum(values**2)), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return "und", 0.0
        at, x = vector(text, self.idf)
        p = softmax((self.weights[:, at] @ x + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list, labels: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
    """Weights (classes x dimensions) and biases by FTRL-proximal with an elastic net."""
    z, n = np.zeros((classes, DIMENSIONS + 1)), np.zeros((classes, DIMENSIONS + 1))

    def leader(at: np.ndarray) -> np.ndarray:
        za = z[:, at]
        return np.where(np.abs(za) > l1, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], DIMENSIONS), np.append(rows[k][1], 1.0)
            w = leader(at)
            p = softmax(w @ x)
            p[labels[k]] -= 1.0
            g = p[:, None] * x
            old = n[:, at]
            z[:, at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n[:, at] = old + g * g
    w = leader(np.arange(DIMENSIONS + 1))
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.mean(np.log(p[np.arange(len(labels)), labels] + 1e-12))

    lo, hi, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each n-gram occurs, over all of them: one partial count a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[:-1] += gram_counts(text.as_py()) > 0
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "docs"])

    found = docs.where("text is not null").select("text").mapInArrow(count, "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs")).collect()
    total = np.zeros(DIMENSIONS + 1)
    for r in found:  # at most one row a dimension
        total[r.gram] = r.docs
    return total[:-1], int(total[-1])


def train(docs: DataFrame, per_language: int = 1500) -> LanguageModel:
    """Learn from the text and non-null lang of documents that are not held out."""
    learn = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out())
    df, n = document_frequencies(learn)
    idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    # ids and langs only; slices of a language are limited first, so a frequent one is no single task
    slices = learn.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SLICES)).alias("slice"))
    for key in (["lang", "slice"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*key).orderBy(order, "doc_id"))
        slices = slices.withColumn("place", first).where(F.col("place") <= per_language)
    ids = slices.select("doc_id", "lang").distinct()
    sample = learn.join(F.broadcast(ids), ["doc_id", "lang"])

    @F.pandas_udf("struct<at: binary, x: binary>")  # packed, so that the sample is small on the driver
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [vector(t, idf) for t in texts]
        return pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a, _ in found], "x": [v.astype(np.float32).tobytes() for _, v in found]})

    rows = sorted(sample.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", cut("text").alias("v")).collect(), key=lambda r: (r.doc_id, r.lang, r.v.at))
    languages = sorted({r.lang for r in rows})
    labels = np.array([languages.index(r.lang) for r in rows], dtype=np.int64)
    data = [(np.frombuffer(r.v.at, dtype=np.int32), np.frombuffer(r.v.x, dtype=np.float32)) for r in rows]
    aside = np.arange(len(rows)) % 5 == 4
    weights, bias = fit_ftrl([d for d, a in zip(data, aside) if not a], labels[~aside], len(languages)) if len(rows) else (np.zeros((0, DIMENSIONS)), np.zeros(0))
    logits = np.array([weights[:, at] @ x + bias for (at, x), a in zip(data, aside) if a]).reshape(int(aside.sum()), len(languages))
    return LanguageModel(languages, idf, weights, bias, fit_temperature(logits, labels[aside]))


def predict_column(model: LanguageModel, text: str = "text") -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    return docs.select("doc_id", held_out().alias("held_out"), predict_column(model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
