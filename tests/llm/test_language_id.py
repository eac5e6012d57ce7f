import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakwise.llm import language_id as lid

SHAPE = "doc_id long, text string, lang string, lang_pred string, score double"
WORDS = {"aa": ["tha", "ing", "ster", "on"], "bb": ["ñez", "los", "ción", "de"], "cc": ["ün", "sch", "keit", "der"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randrange(4, 200))), k) for i in range(n) for k in [rng.choice(list(WORDS))]]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    lid_f32, lid.F32 = lid.F32, np.float64
    try:
        model = lid.new_model(["a", "b", "c"], hidden=3)
        x, y, mask = np.where(rng.random((6, 4)) < 0.2, lid.PAD, rng.integers(0, 9, (6, 4))).astype(np.uint8), np.array([0, 1, 2, 1]), rng.random((6, 4)) < 0.8
        _, grads = model.gradients(x, y, mask)
        for part, grad in zip(model.parts, grads, strict=True):
            for _ in range(6):
                at = tuple(rng.integers(0, s) for s in part.shape)
                if part.shape[1] == 256:
                    at = (at[0], int(x[rng.integers(0, 6), rng.integers(0, 4)]))
                old, sides = part[at], []
                for step in (1e-5, -1e-5):
                    part[at] = old + step
                    sides.append(model.gradients(x, y, mask)[0])
                part[at] = old
                assert grad[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8)
    finally:
        lid.F32 = lid_f32


def slow_probabilities(text, model):
    """One window at a time, one unit at a time, as the network is defined."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def direction(gru, data):
        n, h, out = gru.size, np.zeros(gru.size), []
        for byte in data:
            inner, gate = gru.loop.astype(float) @ h, gru.table[:, byte].astype(float)
            z, r = sigmoid(gate[:n] + inner[:n]), sigmoid(gate[n : 2 * n] + inner[n : 2 * n])
            c = np.tanh(gate[2 * n :] + r * inner[2 * n :])
            h = (z * h + (1 - z) * c) * (byte != lid.PAD)
            out.append(h)
        return out

    total = np.zeros(len(model.languages))
    for at in range(0, len(text), lid.STRIDE):
        n = min(lid.STRIDE, len(text) - at)
        window = bytes(text[i] if 0 <= i < len(text) else lid.PAD for i in range(at - lid.MARGIN, at + lid.STRIDE + lid.MARGIN))
        a, b = direction(model.ahead, window), direction(model.back, window[::-1])[::-1]
        for t in range(lid.MARGIN, lid.MARGIN + n):
            e = np.exp(model.out[:, :-1] @ np.concatenate([a[t], b[t]]) + model.out[:, -1])
            total += e / e.sum()
    return total / max(1, len(text))


def test_batched_prediction_follows_the_definition():
    model = lid.new_model(["a", "b", "c"], seed=9)
    texts = [b"", b"x", bytes(random.Random(1).randrange(255) for _ in range(700)), b"abc " * 60]
    got = lid.predict(texts, model, width=3)
    want = np.array([slow_probabilities(t, model) for t in texts])
    assert np.allclose(got, want, atol=1e-4)
    assert len(lid.label_positions(texts[2], model)) == 700


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(400) + [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (None, "der keit sch " * 40_000, None), (1003, "der keit sch", None)]
    frame = spark.createDataFrame([(i, t, k, "x", 0.0) for i, t, k in rows], SHAPE)
    got = lid.predict_languages(frame, F.col("doc_id") % 4 != 2).collect()
    by = {r.doc_id: r for r in got}
    held = [(i, k) for i, _, k in rows[:400] if i % 4 == 2]
    assert len(got) == len(rows) and np.mean([by[i].lang_pred == k for i, k in held]) >= 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == by[1003].lang_pred == "cc" and all(0 <= r.score <= 1 for r in got)
    assert lid.predict_languages(frame.limit(0), F.lit(True)).count() == 0


def test_the_sample_is_bounded_and_does_not_depend_on_order(spark):
    """Repeated and null ids, and texts with U+0000."""
    rows = corpus(200, seed=3)
    rows += [(None, f"tha ing \0 ster {i}", "aa") for i in range(300)] + [(5, "los de", "bb")] * 500
    frame = spark.createDataFrame([(i, t, k, "x", 0.0) for i, t, k in rows], SHAPE)
    models = [lid.learn_languages(f, F.lit(True), max_per_language=50) for f in (frame, frame.repartition(5).orderBy("text"))]
    assert models[0].languages == models[1].languages == ["aa", "bb", "cc"]
    assert all(np.array_equal(a, b) for a, b in zip(models[0].parts, models[1].parts, strict=True))
    with_zero = lid.predict([b"tha ing ster on tha ing"], models[0]), lid.predict([b"tha ing\0ster on tha ing"], models[0])
    assert all(p[0].sum() == pytest.approx(1, abs=1e-4) and p[0].argmax() == 0 for p in with_zero)


def test_languages_of_a_few_rows_are_learned(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(WORDS[k], k=30)), k) for i in range(400) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000 + i, "жук и шар " * 8, "xx") for i in range(2)]
    frame = spark.createDataFrame([(i, t, k, "x", 0.0) for i, t, k in rows], SHAPE)
    model = lid.learn_languages(frame, F.lit(True))
    assert model.languages == ["aa", "bb", "xx"]
    p = lid.predict(["шар и жук".encode(), b"tha ing ster", "ción los".encode()], model)
    assert p.argmax(1).tolist() == [2, 0, 1]
    monkeypatch.setattr(lid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        lid.learn_languages(frame, F.lit(True))


def test_repeated_rows_get_the_same_prediction(spark):
    rows = corpus(60) + [(7, "los ción de", None)] * 3 + [(7, "tha ing on", None)]
    frame = spark.createDataFrame([(i, t, k, "x", 0.0) for i, t, k in rows], SHAPE)
    got = [r for r in lid.predict_languages(frame, F.col("doc_id") != 7).collect() if r.doc_id == 7]
    assert len(got) == 5 and len({(r.lang_pred, r.score) for r in got}) <= 3
