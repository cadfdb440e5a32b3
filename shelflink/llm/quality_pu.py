"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked good; everything else that is read is unlabelled web
text, a mixture of good and bad.  A linear model on shape and byte-pair features minimises the
non-negative unbiased risk  prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))  with the
logistic loss, so its output is a probability; when the second part falls below zero, its
gradient is followed upwards instead, which keeps the model from fitting the positives by heart.
The class prior is estimated as the share of positives among the rows that carry a label.

Training takes a bounded sample of rows (``positives`` and ``unlabelled``, chosen by a hash of
the id), whose features come to the driver; scoring is one pass over all documents.

Edge cases: null text counts as empty; an empty text has all features zero and gets the score
the model gives that; null labels are no labels; rows that repeat a label count once; without any
positive no model can be learned: ``train`` raises, ``train_or_prior`` scores every text with the
prior; repeated rows get equal scores; extra columns are ignored; an empty table to score gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .shingles import mix, word_hashes

THRESHOLD = 0.3
PAIR_BUCKETS = 128
_SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@/"
#: Byte classes: 0 other, 1 capital, 2 small letter, 3 digit, 4 blank, 5 symbol, 6 sentence mark, 7 other ASCII mark, 8 outside ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[33:127] = 7
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(_SYMBOLS)] = 5
_CLASS[list(b".,;:!?")] = 6
FEATURES = 9 + 12 + PAIR_BUCKETS


def features(text: str | None) -> np.ndarray:
    """What a text looks like: shares of byte classes, repetition of words, pairs and lines,
    word and line lengths, and a histogram of byte pairs."""
    out = np.zeros(FEATURES, dtype=np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return out
    out[:9] = np.bincount(_CLASS[raw], minlength=9) / len(raw)
    words = word_hashes(raw)
    n = len(words)
    if n:
        _, count = np.unique(words, return_counts=True)
        out[9] = len(count) / n
        out[10] = count.max() / n
        if n > 1:
            out[11] = np.mean(words[1:] == words[:-1])
            pairs = mix(words[1:] + mix(words[:-1]))
            out[12] = len(np.unique(pairs)) / len(pairs)
        out[13] = np.log1p(n) / 10
        out[14] = min(len(raw) / n / 20, 2)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if lines:
        out[15] = len(set(lines)) / len(lines)
        out[16] = np.log1p(len(raw) / len(lines)) / 10
    capital = out[1] / max(out[1] + out[2], 1e-9)
    out[17] = capital
    out[18] = capital > 0.5
    out[19] = np.sqrt(out[5])
    out[20] = np.mean(raw == 33)
    hashed = (raw[:-1].astype(np.int64) * 251 + raw[1:]) * 40503 >> 5 & (PAIR_BUCKETS - 1)
    if len(hashed):
        out[21:] = np.sqrt(np.bincount(hashed, minlength=PAIR_BUCKETS) / len(hashed))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> QualityModel:
    """Minimise the non-negative risk by Adam on the whole sample."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = ((np.clip((x - mean) / scale, -8, 8)).astype(np.float64) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        # logistic loss: l(z) for good, l(-z) for bad; slopes of each mean loss
        good, bad_p, bad_u = sigmoid(zp) - 1, sigmoid(zp), sigmoid(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        down = np.append(u.T @ bad_u / len(u) - prior * (p.T @ bad_p) / len(p), bad_u.mean() - prior * bad_p.mean())
        up = prior * np.append(p.T @ good / len(p), good.mean())
        slope = up + down if negative >= 0 else -down
        slope[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return QualityModel(mean.astype(np.float64), scale.astype(np.float64), w, float(b), prior)


@F.pandas_udf(T.BinaryType())
def _features_of(texts: pd.Series) -> pd.Series:
    """Packed, so that the sample is small on the driver."""
    return texts.map(lambda t: features(t).tobytes())


class NoPositives(ValueError):
    """There is nothing to learn from."""


def estimate_prior(labels: DataFrame) -> float:
    """Share of positives among labelled rows (with one row of each kind added)."""
    found = labels.agg(F.sum(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.count("quality").alias("n")).first()
    return ((found.good or 0) + 1.0) / ((found.n or 0) + 2.0)


def train(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 16000, prior: float | None = None) -> QualityModel:
    """Learn from rows that are not held out: ``labels`` (doc_id, quality) and texts of ``docs``."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = estimate_prior(known) if prior is None else prior
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    ids = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct()
    trusted = known.where("quality = 1").join(ids, "doc_id").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(True).alias("trusted"))
    web = ids.orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("trusted"))
    chosen = F.broadcast(trusted.unionByName(web))  # bounded by the two parameters
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "trusted", _features_of("text").alias("x")).collect()
    # in a fixed order, so that every run sums alike
    sample.sort(key=lambda r: (r.doc_id, r.trusted, r.x))
    x = np.frombuffer(b"".join(r.x for r in sample), dtype=np.float32).reshape(len(sample), FEATURES)
    mark = np.array([r.trusted for r in sample], dtype=bool)
    if not mark.any():
        raise NoPositives("no trusted positive document to learn from", prior)
    return fit_nn_pu(x[mark], x[~mark] if (~mark).any() else x, prior)


def train_or_prior(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """As ``train``, but without a positive a constant model: every score is the prior."""
    try:
        return train(docs, labels)
    except NoPositives as error:
        prior = error.args[1]
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(prior / (1 - prior))), prior)


def score_column(model: QualityModel, text: str = "text") -> Column:
    """The probability that a text is good."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.stack([features(t) for t in texts])))

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", F.expr(f"if(score >= {threshold}D, 1, 0)"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the model does not reject, all columns as they came."""
    return docs.where(score_column(model) >= threshold)
