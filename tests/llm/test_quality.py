import random
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwise.llm.quality import N_FEATURES, N_SHAPE, WORD_PENALTY, features, fit_pairs, learn_quality, quality_scores
from leakwise.llm.quality_rules import WINDOW, apply_rules, binomial_cdf, certified, counts, repeat_words

SHAPE = "doc_id long, text string, lang string, label long, score double"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(25, 90))]
        good = rng.random() < 0.8
        if not good:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, int(good), 0, "x"))
    return rows, labels


def test_classifier_on_held_out_and_odd_rows(spark):
    rows, labels = corpus(600)
    rows += [(900, None, "en"), (901, "", "en"), (None, "a " * 100_000, None), (902, "same", "en"), (902, "same", "en")]
    labels += [(None, 1, 0, "x"), (5, None, 0, "x"), (7777, 1, 0, "x")]
    frame = spark.createDataFrame([(*r, 3, 0.5) for r in rows], SHAPE)
    got = quality_scores(frame, spark.createDataFrame(labels, LABELS), F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    want = {i: q for i, q, *_ in labels[:600] if i % 5 == 0}
    assert np.mean([r.predicted == want[r.doc_id] for r in got if r.doc_id in want]) >= 0.97
    assert len({r.score for r in got if r.doc_id == 902}) == 1
    assert quality_scores(frame.limit(0), spark.createDataFrame(labels, LABELS), F.lit(True)).count() == 0
    alone = quality_scores(frame, spark.createDataFrame([], LABELS), F.lit(True)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5]


def test_pairs_are_fit_to_the_logistic_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, N_FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.logistic(size=400) > -1).astype(float)
    model = fit_pairs(x, y)
    latent = model.latent(x)
    assert latent[y == 1].mean() > latent[y == 0].mean() and model.weights[0] > 0 > model.weights[3]
    assert abs((latent < model.cut).sum() - (y == 0).sum()) <= 1  # the quantile at the share of label 0
    assert all(len(features(t)) == N_FEATURES for t in (None, "", " ", "x\x00é", "#" * 9))


def test_the_fit_is_the_least_loss():
    """Against the loss written out pair by pair: no step from the fitted weights lowers it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, N_FEATURES))
    y = (x[:, 1] + x[:, N_SHAPE] + rng.logistic(size=60) > 0).astype(float)
    model, pairs, l2 = fit_pairs(x, y, pairs=300), 300, 1e-3
    z, draw = np.clip((x - x.mean(0)) / x.std(0), -8, 8), np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    first, second = draw.choice(good, pairs), draw.choice(bad, pairs)

    def loss(w):
        each = [np.log1p(np.exp(-float((z[i] - z[j]) @ w))) for i, j in zip(first, second, strict=True)]
        return sum(each) / pairs + l2 / 2 * sum((1 if k < N_SHAPE else WORD_PENALTY) * v * v for k, v in enumerate(w))

    least = loss(model.weights)
    for k in rng.choice(N_FEATURES, 12, replace=False):
        for step in (1e-3, -1e-3):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved) > least


def test_an_id_counts_once_for_each_label(spark):
    rows, labels = corpus(200)
    more = rows + rows[:50] * 3
    frames = [spark.createDataFrame([(*r, 3, 0.5) for r in x], SHAPE) for x in (rows, more)]
    tables = [spark.createDataFrame(x, LABELS) for x in (labels, labels * 3)]
    models = [learn_quality(f, t, F.lit(True)) for f, t in zip(frames, tables, strict=True)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].cut == models[1].cut


@settings(deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeat_words_follow_their_definition(words):
    words = [w.encode() for w in words]
    runs = Counter(tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1))
    inside = {i + k for i in range(len(words) - WINDOW + 1) if runs[tuple(words[i : i + WINDOW])] > 1 for k in range(WINDOW)}
    assert repeat_words(words) == len(inside)


def test_counts():
    assert counts("a# b\xe9\x0b$\n\na# b\xe9\x0b$\n \n") == (6, 10, 4, 1, 0, 2, 0)
    assert counts("") == (0, 0, 0, 0, 0, 0, 0) and counts("A! B!!")[6] == 3
    assert counts("x " * 100)[4] == 100


def test_exact_binomial_bound():
    for n, k, p in [(10, 2, 0.3), (50, 0, 0.05), (7, 7, 0.5), (400, 180, 0.4), (400, 2, 0.01), (300, 299, 0.9), (1, 0, 0.2), (900, 40, 0.01)]:
        assert binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert not certified(0, 0, 0.5, 0.5) and not certified(0, 10, 0.01, 0.001) and certified(0, 1000, 0.01, 0.001)


def test_rules_keep_false_rejection_low_per_stratum(spark):
    rows, labels = corpus(3000)
    rows += [(9000, None, None), (9001, "w " * 50, "en"), (None, "a b c " * 30_000, "de")]
    labels += [(None, 1, 0, "x"), (9000, None, 0, "x")]
    frame = spark.createDataFrame([(*r, 3, 0.5) for r in rows], SHAPE)
    got = {r.doc_id: r for r in apply_rules(frame, spark.createDataFrame(labels, LABELS)).collect()}
    lost, good = defaultdict(int), defaultdict(int)
    for (i, _, lang), (_, q, *_) in zip(rows[:3000], labels[:3000], strict=True):
        good[lang] += q
        lost[lang] += q and not got[i].base_failed and not got[i].kept
    assert all(lost[k] <= 0.05 * good[k] for k in good)
    marked = [got[i] for i, t, _ in rows[:3000] if "###" in t]
    assert marked and not any(r.kept for r in marked) and all("symbols" in r.rejected_by for r in marked)
    assert not any(got[i].kept for i, t, _ in rows[:3000] if "!!" in t)
    assert got[9000].base_failed and got[9001].base_failed and got[None].base_failed
    assert apply_rules(frame.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    bare = apply_rules(frame, spark.createDataFrame([], LABELS)).where("kept = base_failed").count()
    assert bare == 0


def test_a_labelled_id_counts_once(spark):
    """Repeats of labels or rows don't add up to a certificate."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en") for i in range(900)]
    bad = [(5000, "a### " * 10 + " ".join(f"b{k}" for k in range(20)), "en")]

    def rejected(rows, labels):
        frame = spark.createDataFrame([(*r, 3, 0.5) for r in rows], SHAPE)
        return {x.doc_id for x in apply_rules(frame, spark.createDataFrame(labels, LABELS)).where("size(rejected_by) > 0").collect()}

    every = [(i, 1, 0, "x") for i in range(900)]
    assert rejected(texts + bad, every) == {5000}
    assert rejected(texts[:300] + bad, every[:300] * 4) == rejected(texts[:300] * 4 + bad, every[:300]) == set()
