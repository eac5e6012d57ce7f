"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

Each pair is a document labelled 1 preferred over one labelled 0; the logistic loss on the difference of their features
gives the weights. The latent score is linear in the features. The cut-off is the quantile of the latent scores of the
training rows at the share of rejected labels; the reported score is a logistic curve that passes through
``cut_score`` there. The fit uses about ``max_rows`` labelled rows (those whose id has a hash below the share wanted) and
``pairs`` pairs drawn from them.

Features are shape (lengths, repeats, symbols, case) and words: shares of the words whose hash falls into each of
``WORD_BUCKETS`` buckets, penalised more, so that few labels fit the shape only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of the symbol feature (a fixed value).
SYMBOLS = b"#*$%&|<>"
N_SHAPE, WORD_BUCKETS = 12, 64
N_FEATURES = N_SHAPE + WORD_BUCKETS
#: How much heavier the penalty on a word bucket is.
WORD_PENALTY = 30.0


def features(text: str | None) -> list[float]:
    """Features of one whole text, shape and words; all are 0 for an empty one but the flag of emptiness."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (N_SHAPE - 1) + [1.0] + [0.0] * WORD_BUCKETS
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    upper = sum(w.isupper() for w in words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = size - len(raw.translate(None, b"0123456789"))
    punctuation = size - len(raw.translate(None, b"!?,.;:'\"()-_"))
    rate = lambda x, of: np.log1p(100.0 * x / of)
    tally = Counter(raw.lower().split())
    buckets = [0] * WORD_BUCKETS
    for word, count in tally.items():
        buckets[crc32(word) % WORD_BUCKETS] += count
    return [
        np.log(n),
        rate(upper, n),
        rate(symbols, size),
        rate(len(lines) - len(set(lines)), len(lines)),
        rate(again, n),
        len(set(words)) / n,
        rate(digits, size),
        rate(raw.count(b"!"), n),
        size / n,
        rate(raw.count(b"|"), n),
        rate(punctuation, size),
        0.0,
        *np.sqrt(np.array(buckets) / n).tolist(),
    ]


@dataclass
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    cut_score: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(self.latent(x) - self.cut + odds, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, cut_score: float = 0.3, pairs: int = 40_000, l2: float = 1e-3, rounds: int = 30, seed: int = 7) -> QualityModel:
    """Newton steps on the mean logistic loss of feature differences over ``pairs`` drawn pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):  # nothing to compare: every text gets the same score
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5 if not len(x) else (0.9 if len(good) else 0.1))
    center, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - center) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, penalty = np.zeros(z.shape[1]), l2 * np.where(np.arange(z.shape[1]) < N_SHAPE, 1.0, WORD_PENALTY)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-d @ w))
        gradient = -(d.T @ (1 - p)) / pairs + penalty * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    ranked = np.sort(z @ w)
    k = len(bad)  # the quantile at the share of label 0, halfway to the next score
    return QualityModel(center, scale, w, float((ranked[k - 1] + ranked[min(k, len(ranked) - 1)]) / 2), cut_score)


def feature_column(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return run(F.col(text))


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows of ``docs`` for which ``learn`` (an expression of doc_id) is true.

    Null ids and labels other than 0 and 1 are left out. An id counts once for each of its labels, however often it is
    labelled or stands in ``docs`` (with the smallest features of its texts).
    """
    seen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label in (0, 1)").where(learn).distinct()
    # a hash below the share of rows wanted, so that no task has to sort or gather the labels
    share = min(1.0, max_rows / max(1, seen.count()))
    sample = seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31))))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # about max_rows rows
    found = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", feature_column("text").alias("x"))
    got = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas()
    x = np.array(got.x.tolist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, got.label.to_numpy(float)])  # the fit doesn't depend on the order of arrival
    return fit_pairs(x[order], got.label.to_numpy(float)[order])


def quality_score(model: QualityModel, text: str) -> Column:
    """The score in (0, 1) of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)
        return pd.Series(model.score(x))

    return run(F.col(text))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, cut_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 if score >= ``cut_score``).

    Null text counts as empty. Repeated and null ids are scored row by row. Other columns are not read; an empty table
    gives an empty result; without labels of both kinds every text gets one score.
    """
    model = learn_quality(docs, labels, learn, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", quality_score(model, "text").alias("score")).withColumn("predicted", (F.col("score") >= cut_score).cast("int"))
