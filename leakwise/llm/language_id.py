"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of ``STRIDE`` bytes, each read with ``MARGIN`` bytes of context on either side (``PAD`` outside
the text, where the state is zero; UTF-8 never holds that byte), so memory is bounded for texts of any length and all windows of a batch advance together. One network reads
forwards, one backwards; from both hidden states every position gets a probability for each language. A document's
probabilities are the means over its positions.

Trained on about ``max_per_language`` documents of each language (those whose hash of id and text is below the share
wanted; rows that repeat both count once) and ``WINDOWS`` windows of ``TRAIN_LENGTH`` bytes of each, drawn from anywhere
in the text. Every non-null name is a language, however few rows carry it; with more than ``SAMPLE / max_per_language``
names each gets an equal part of ``SAMPLE`` rows. A table with more than ``MAX_LANGUAGES`` names is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import slices

HIDDEN = 8
PAD = 0xFF
STRIDE, MARGIN = 224, 16
TRAIN_LENGTH, WINDOWS = 64, 3
#: About as many rows are learned from at most; their windows, some 200 bytes a row, reach the driver.
SAMPLE = 1 << 17
#: A model has 17 numbers a language, and a prediction one probability a byte and language.
MAX_LANGUAGES = 4096
F32 = np.float32
_PAD = bytes([PAD])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= F32(0.5)
    np.tanh(x, out=x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


@dataclass
class Gru:
    """One direction. ``table`` [3H, 256]: input weights of each byte (update, reset, candidate); ``loop`` [3H, H]."""

    table: np.ndarray
    loop: np.ndarray

    @property
    def size(self) -> int:
        return self.loop.shape[1]

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [L, H, B] for bytes [L, B]; ``keep`` gets what backward needs."""
        n = self.size
        out = np.empty((len(x), n, x.shape[1]), F32)
        h = np.zeros((n, x.shape[1]), F32)
        for t in range(len(x)):
            gate = self.table.take(x[t], axis=1)
            inner = self.loop @ h
            gate[: 2 * n] += inner[: 2 * n]
            update_reset = _sigmoid(gate[: 2 * n])
            z, r = update_reset[:n], update_reset[n:]
            candidate = gate[2 * n :]
            candidate += r * inner[2 * n :]
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep.append((z.copy(), r.copy(), candidate.copy(), inner[2 * n :].copy(), h))
            h = candidate + z * (h - candidate)
            inside = x[t] != PAD
            if not inside.all():  # outside the text the state is zero, however long the padding is
                h *= inside
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (table, loop) through time."""
        n = self.size
        d_loop, d_gates = np.zeros_like(self.loop), np.empty((len(x), 3 * n, x.shape[1]), F32)
        d_h = np.zeros((n, x.shape[1]), F32)
        for t in range(len(x) - 1, -1, -1):
            z, r, c, q, before = kept[t]
            d_h = (d_h + d_out[t]) * (x[t] != PAD)
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (before - c) * z * (1 - z)
            d_r = d_c * q * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c])
            d_inner = np.concatenate([d_z, d_r, d_c * r])
            d_loop += d_inner @ before.T
            d_h = d_h * z + self.loop.T @ d_inner
        hot = np.zeros((x.size, 256), F32)
        hot[np.arange(x.size), x.ravel()] = 1
        return d_gates.transpose(1, 0, 2).reshape(3 * n, -1) @ hot, d_loop


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Gru
    back: Gru
    out: np.ndarray  # [K, 2H + 1]

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.loop, self.back.table, self.back.loop, self.out]

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """[..., K, B] from [..., 2H, B]."""
        return self.out[:, :-1] @ hidden + self.out[:, -1:]

    def probabilities(self, x: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
        """[K, B] for the positions lo to hi of bytes [L, B]."""
        a = self.ahead.forward(x[:hi])
        b = self.back.forward(x[lo:][::-1])
        for t in range(lo, hi):
            p = self.logits(np.concatenate([a[t], b[len(x) - 1 - t]]))
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            yield p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the masked positions [L, B] against languages [B], and the gradients of ``parts``."""
        kept_a, kept_b = [], []
        a, b = self.ahead.forward(x, kept_a), self.back.forward(x[::-1], kept_b)[::-1]
        hidden = np.concatenate([a, b], axis=1)
        p = self.logits(hidden)
        p -= p.max(1, keepdims=True)
        p = np.exp(p)
        p /= p.sum(1, keepdims=True)
        weight = (mask / max(1, mask.sum())).astype(F32)
        own = np.arange(len(y))
        loss = float(-(np.log(np.maximum(p[:, y, own], 1e-12)) * weight).sum())
        p[:, y, own] -= 1
        p *= weight[:, None, :]
        d_out = np.empty_like(self.out)
        d_out[:, :-1] = np.einsum("lkb,lhb->kh", p, hidden, optimize=True)
        d_out[:, -1] = p.sum((0, 2))
        d_hidden = self.out[:, :-1].T @ p
        n = self.ahead.size
        d_a = self.ahead.backward(x, kept_a, d_hidden[:, :n])
        d_b = self.back.backward(x[::-1], kept_b, d_hidden[::-1, n:])
        return loss, [*d_a, *d_b, d_out]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> LanguageModel:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(F32)
    gru = lambda: Gru(draw(0.3, 3 * hidden, 256), draw(hidden**-0.5, 3 * hidden, hidden))
    return LanguageModel(languages, gru(), gru(), draw(0.3, len(languages), 2 * hidden + 1))


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, languages: list[str], steps: int = 600, batch: int = 128, rate: float = 0.03, seed: int = 5) -> LanguageModel:
    """Adam on windows ``x`` [N, L] of language numbers ``y`` [N]; ``mask`` [N, L] says which bytes are text."""
    model = new_model(languages, seed=seed)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    members = [np.flatnonzero(y == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(m, -(-batch // len(members))) for m in members])
        _, grads = model.gradients(np.ascontiguousarray(x[rows].T), y[rows], np.ascontiguousarray(mask[rows].T))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for p, g, m, v in zip(model.parts, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += F32(0.1) * (g - m)
            v += F32(0.01) * (g * g - v)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(F32)
    return model


def training_windows(text: bytes, length: int = TRAIN_LENGTH, windows: int = WINDOWS) -> Iterator[bytes]:
    """Windows from anywhere in the text (drawn by its checksum), some over its ends, padded."""
    rng = np.random.default_rng(crc32(text))
    for _ in range(windows):
        at = int(rng.integers(-MARGIN, max(1 - MARGIN, len(text) - length + MARGIN)))
        part = text[max(0, at) : max(0, at + length)]
        yield (_PAD * max(0, -at) + part).ljust(length, _PAD)[:length]


def predict(texts: list[bytes], model: LanguageModel, width: int = 2048) -> np.ndarray:
    """Mean probabilities [N, K] of texts; rows of empty texts are 0."""
    total = np.zeros((len(texts), len(model.languages)))
    span = STRIDE + 2 * MARGIN
    pending: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        lengths = np.array([n for _, n, _ in pending])
        short = min(STRIDE, int(lengths.max()))  # a batch of short texts takes fewer steps
        x = np.frombuffer(b"".join(w for *_, w in pending), np.uint8).reshape(len(pending), span)[:, : short + 2 * MARGIN]
        x = np.ascontiguousarray(x.T)
        sums = np.zeros((len(model.languages), len(pending)), F32)
        for t, p in enumerate(model.probabilities(x, MARGIN, MARGIN + short)):
            sums += p * (t < lengths) if t >= lengths.min() else p
        np.add.at(total, np.array([i for i, *_ in pending]), sums.T)
        pending.clear()

    for i, text in enumerate(texts):
        padded = _PAD * MARGIN + text
        for at in range(0, len(text), STRIDE):
            pending.append((i, min(STRIDE, len(text) - at), padded[at : at + span].ljust(span, _PAD)))
            if len(pending) == width:
                flush()
    if pending:
        flush()
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def label_positions(text: bytes, model: LanguageModel) -> list[str]:
    """The likeliest language of every byte of one text."""
    out: list[str] = []
    for at in range(0, len(text), STRIDE):
        part = (_PAD * MARGIN + text)[at : at + STRIDE + 2 * MARGIN].ljust(STRIDE + 2 * MARGIN, _PAD)
        x = np.frombuffer(part, np.uint8)[:, None]
        out += [model.languages[int(p[:, 0].argmax())] for p in model.probabilities(x, MARGIN, MARGIN + min(STRIDE, len(text) - at))]
    return out


def learn_languages(docs: DataFrame, learn: Column, max_per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on rows with a language, a text and a true ``learn`` (an expression of doc_id)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(learn).where("lang is not null and text <> ''")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(held) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not held:
        return new_model([])
    max_per_language = min(max_per_language, SAMPLE // len(held))
    # about max_per_language rows of each language: those whose hash is below the language's share of the range
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    bounds = F.create_map(*[F.lit(x) for k, n in sorted(held.items()) for x in (k, int(min(1.0, max_per_language / n) * (1 << 31)))])
    picked = rows.withColumn("place", place).where(F.col("place") < F.try_element_at(bounds, F.col("lang"))).dropDuplicates(["lang", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in training_windows(t.encode("utf-8", "surrogatepass"))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.binary())], ["lang", "part"])

    windows = picked.select("lang", "text").mapInArrow(cut, "lang string, part binary")
    got = sorted((r["lang"], bytes(r["part"])) for r in windows.collect())  # about max_per_language * WINDOWS rows a language
    if not got:
        return new_model(sorted(held))
    x = np.frombuffer(b"".join(p for _, p in got), np.uint8).reshape(len(got), TRAIN_LENGTH)
    seen = sorted({k for k, _ in got})
    return fit(x, np.array([seen.index(k) for k, _ in got]), x != PAD, seen)


def predict_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the pooled probability of lang_pred).

    Null text and text without a letter give ``und`` with score 0, as does every text if no language was learned from.
    Repeated and null ids are predicted row by row; other columns are not read; an empty table gives an empty result.
    """
    model = learn_languages(docs, learn, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 20 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            texts = [t if t and model.languages and any(map(str.isalpha, t)) else "" for t in batch.column(1).to_pylist()]
            p = predict([t.encode("utf-8", "surrogatepass") for t in texts], model)
            best = p.argmax(1) if p.size else np.zeros(len(texts), int)
            names = [model.languages[k] if t else "und" for k, t in zip(best, texts, strict=True)]
            score = [float(min(1.0, p[i, k])) if texts[i] else 0.0 for i, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
