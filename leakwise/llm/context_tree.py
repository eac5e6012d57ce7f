"""Language-model scores by context-tree weighting over bytes.

A text is a sequence of bytes closed by one end symbol (0xFF, which UTF-8 never holds); before its start stand end
symbols. Each byte is eight binary decisions. For each of the 255 nodes of that decision tree there is a binary context
tree over the preceding bytes, up to ``DEPTH`` of them: a node has Krichevsky-Trofimov counts, and its weighted
probability is half its own estimate plus half the product of its children's. The tree holds every context of the
training texts, so it grows with them; it is a table of runs (``DEPTH`` bytes and the next one), never held in one place:

1. One pass over all texts counts their runs; those of texts that are not learned from have count 0 and are there to be
   looked up.
2. The runs meet by the last ``TOP + 1`` bytes of their contexts, below which a subtree is whole. Each subtree is weighted
   from its leaves up, and the sums at its root go to the driver, which weights the contexts of at most ``TOP`` bytes (at
   most 255 * 256**TOP sums, whatever the input).
3. With their weights broadcast, each subtree is walked down again, which gives log10 P(byte | context) of every run.
4. Runs with at least ``RUN_HEAD`` of all positions (at most its inverse many) are looked up in a broadcast table when
   texts are scored; the others meet their values in an ordinary join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import bytes_of, forget, slices, written

DEPTH = 5
#: Contexts of at most this many bytes are weighted on the driver.
TOP = 2
EDGE = b"\xff"
#: Words with at least this share of all tokens (at most its inverse many) are looked up in a broadcast table.
HEAD = 2.0**-20
#: The same for runs and positions.
RUN_HEAD = 2.0**-22


def blocks(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index of each part, start of each part, bytes, which are predicted); long texts come in several parts."""
    parts: list[tuple[int, bytes]] = []
    size = 0

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for _, p in parts])
        starts = np.cumsum(lengths) - lengths
        buf = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        predicted = np.ones(len(buf), bool)
        predicted[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
        return np.array([i for i, _ in parts]), starts, buf, predicted

    for i, text in enumerate(texts):
        whole = EDGE * DEPTH + text + EDGE
        for at in range(0, len(whole) - DEPTH, limit):
            parts.append((i, whole[at : at + limit + DEPTH]))
            size += len(parts[-1][1])
            if size >= limit:
                yield laid()
                parts, size = [], 0
    if parts:
        yield laid()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    half = 1.1447298858494002  # 2 * log gamma(1/2)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - half - _log_gamma(zeros + ones + 1.0)


def _runs(buf: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Of each predicted byte, the ``DEPTH`` bytes before it and itself as the lowest byte."""
    key = np.zeros(len(buf) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        key = (key << 8) | buf[i : len(buf) - DEPTH + i]
    return key[predicted[DEPTH:]]


def run_counts(groups: Iterator[tuple[list[bytes], bool]], limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Partial sums (run, occurrences in learned texts, in all) of groups of texts that are learned from or not."""
    import pandas as pd

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
        learned, every = (np.bincount(at, np.concatenate([t[i] for t in tables]), len(keys)).astype(np.int64) for i in (1, 2))
        return keys, learned, every

    for texts, learned in groups:
        for _, _, buf, predicted in blocks(texts):
            codes, keys = pd.factorize(_runs(buf, predicted))
            n = np.bincount(codes, minlength=len(keys))
            tables.append((keys, n * learned, n))
            if len(tables) > 1 and sum(len(t[0]) for t in tables[1:]) > max(1 << 20, len(tables[0][0])):
                tables = [merged()]
                if len(tables[0][0]) > limit:
                    yield tables.pop()
    if tables:
        yield merged()


@dataclass
class Level:
    """The decisions (context << 8 | node, sorted) of all contexts of one depth: their counts and weights."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_w: np.ndarray
    own: np.ndarray
    #: Of each decision one level deeper (at the deepest level: of each one given), its place in ``keys``.
    places: np.ndarray


def _parents(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct decisions of the contexts of ``depth`` bytes over ``keys``, and the place of each key's in them."""
    return np.unique((((keys >> 8) & ((1 << 8 * depth) - 1)) << 8) | (keys & 255), return_inverse=True)


def _upward(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, child: np.ndarray | None, depth: int, to: int) -> list[Level]:
    """Levels of depth ``to``, ..., ``depth`` from the decisions (repeats allowed) of ``depth``; ``child``: sums of their
    children's log weighted probabilities, None at the leaves."""
    levels: list[Level] = []
    for d in range(depth, to - 1, -1):
        keys, places = _parents(keys, d)
        zeros, ones = np.bincount(places, zeros, len(keys)), np.bincount(places, ones, len(keys))
        log_w = log_e = _kt_block(zeros, ones)
        own = np.ones(len(keys))
        if child is not None:
            log_w = np.logaddexp(log_e, np.bincount(places, child, len(keys))) - np.log(2)
            own = np.exp(log_e - np.log(2) - log_w)
        levels.append(Level(keys, zeros, ones, log_w, own, places))
        child = log_w
    return levels[::-1]


def _downward(levels: list[Level], one: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a 1 so far and weight left for deeper contexts at the deepest level, from the same at the parents of
    the first."""
    for d, level in enumerate(levels):
        if d:
            one, left = one[levels[d - 1].places], left[levels[d - 1].places]
        one, left = one + left * level.own * ((level.ones + 0.5) / (level.zeros + level.ones + 1)), left * (1 - level.own)
    return one, left


def _subtrees(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, list[Level]]]:
    """(runs, bits of their bytes [8, runs], levels TOP + 1 to DEPTH) of whole subtrees, from batches (part, key, n) in order of
    their part."""

    def built(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Level]]:
        byte, k = key & 255, np.arange(8)[:, None]
        bits = (byte >> (7 - k)) & 1
        decisions = ((key >> 8) << 8) | (1 << k) | (byte >> (8 - k))
        return key, bits, _upward(decisions.ravel(), (n * (1 - bits)).ravel(), (n * bits).ravel(), None, DEPTH, TOP + 1)

    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([np.asarray(c) for c in batch.columns]))
        if sum(h.shape[1] for h in held) >= limit:
            rows = np.concatenate(held, axis=1)
            end = np.searchsorted(rows[0], rows[0, -1])  # the last part may go on
            if end:
                yield built(rows[1, :end], rows[2, :end])
            held = [rows[:, end:]]
    if held and sum(h.shape[1] for h in held):
        rows = np.concatenate(held, axis=1)
        yield built(rows[1], rows[2])


def run_values(runs: DataFrame) -> DataFrame:
    """(key, value): log10 P(byte | context) of every run of ``runs`` (key, n; keys unique), by the tree over all contexts."""
    part = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1))
    parts = runs.select(part.alias("part"), "key", "n").repartition("part").sortWithinPartitions("part")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, levels in _subtrees(batches):
            keys, at = _parents(levels[0].keys, TOP)
            sums = [np.bincount(at, x, len(keys)) for x in (levels[0].zeros, levels[0].ones, levels[0].log_w)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["key", "zeros", "ones", "child"])

    sums = parts.mapInArrow(up, "key long, zeros double, ones double, child double").groupBy("key")
    # at most 255 * 256**TOP rows
    got = sums.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("child").alias("child")).toPandas()
    top = _upward(*(got[c].to_numpy() for c in ("key", "zeros", "ones", "child")), TOP, 0)
    size = len(top[0].keys)
    shared = runs.sparkSession.sparkContext.broadcast((top[-1].keys, *_downward(top, np.zeros(size), np.ones(size))))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, root_one, root_left = shared.value
        for key, bits, levels in _subtrees(batches):
            keys, at = _parents(levels[0].keys, TOP)
            at = np.searchsorted(roots, keys)[at]
            one, _ = _downward(levels, root_one[at], root_left[at])
            p = one[levels[-1].places].reshape(bits.shape)
            value = np.log10(np.maximum(np.where(bits == 1, p, 1 - p), 1e-300)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value.astype(np.float32))], ["key", "value"])

    return parts.mapInArrow(down, "key long, value float")


def run_scores(texts: list[bytes], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of each text, the summed values of its runs among ``keys`` (sorted), and its other runs."""
    import pandas as pd

    out, rare, many = np.zeros(len(texts)), [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for index, starts, buf, predicted in blocks(texts):
        codes, runs = pd.factorize(_runs(buf, predicted))
        at = np.minimum(np.searchsorted(keys, runs), max(len(keys) - 1, 0))
        found = keys[at] == runs if len(keys) else np.zeros(len(runs), bool)
        value = np.zeros(len(runs))
        value[found] = values[at[found]]
        whole = np.zeros(len(buf))
        where = np.flatnonzero(predicted)
        whole[where] = value[codes]
        np.add.at(out, index, np.add.reduceat(whole, starts))
        left = ~found[codes]
        rare.append(runs[codes[left]])
        many += np.bincount(index[np.searchsorted(starts, where[left], side="right") - 1], minlength=len(texts))
    return out, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(np.concatenate(rare)))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, n, every): all words of ``rows`` (text, learned), A-Z in lower case; how often in learned texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def table() -> pa.RecordBatch:
            words = list(learned | other)
            n = [learned[w] for w in words]
            every = [a + other[w] for w, a in zip(words, n, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(every, pa.int64())], ["word", "n", "every"])

        for batch in slices(batches, "text"):
            for text, flag in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (learned if flag else other).update(text.lower().split())
            if len(learned) + len(other) > 1 << 20:  # a partial count; the shuffle sums them
                yield table()
                learned.clear()
                other.clear()
        yield table()

    counted = rows.select("text", "learned").mapInArrow(run, "word binary, n long, every long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def whole_tree(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The frequent runs of ``rows`` (text, learned) with their values, and the others as a table (key, value)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[list[bytes], bool]]:
            for batch in slices(batches, "text"):
                texts, learned = bytes_of(batch.column(0)), batch.column(1).to_pylist()
                for flag in (True, False):
                    if some := [t for t, x in zip(texts, learned, strict=True) if x == flag]:
                        yield some, flag

        for table in run_counts(groups()):
            for at in range(0, len(table[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in table], ["key", "n", "every"])

    counted = rows.select("text", "learned").mapInArrow(count, "key long, n long, every long")
    runs = written(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "runs")
    values = written(run_values(runs.select("key", "n")).join(runs.select("key", "every"), "key"), "run-values")
    least = max(1, RUN_HEAD * (runs.agg(F.sum("every")).first()[0] or 0))
    head = values.where(F.col("every") >= least).select("key", "value").toPandas().sort_values("key")  # at most 1 / RUN_HEAD rows
    forget(runs)
    return (head.key.to_numpy(np.int64), head.value.to_numpy(np.float32)), values.where(F.col("every") < least).select("key", "value")


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``learn`` says which rows are learned from (null: not). Null text counts as empty: it has the end token only.
    With nothing to learn from, every byte has probability 1/256. Repeated and null ids are scored row by row; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text_col).alias("text"))
    model, runs = whole_tree(rows)
    words = written(vocabulary(rows), "vocabulary")
    sums = words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum("every")).first()
    ends = rows.where("learned").count()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    scale = total + distinct + 1
    least = max(1, HEAD * (sums[2] or 0))
    head = words.where(F.col("every") >= least).select("word", "n").toPandas()  # at most 1 / HEAD rows
    unknown = log10(1 / scale)
    # words that only other texts have count as unknown below; their 0 tells that they need no look-up
    known = {bytes(w): log10((n + 1) / scale) if n else 0.0 for w, n in zip(head.word, head.n, strict=True)}
    shared = spark.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "learned", "n_tokens", "n_head", "head_score", "score", "n_bytes", "tail", "runs"]
        for batch in slices(batches, "text"):
            texts = bytes_of(batch.column(2))
            scores, others = run_scores(texts, *model)
            n_tokens, n_head, base, tail = [], [], [], []
            for text in texts:
                words = text.lower().split()
                values = list(map(known.get, words))
                rest = [w for w, v in zip(words, values, strict=True) if v is None]
                n_tokens.append(len(words) + 1)
                n_head.append(sum(v < 0 for v in values if v is not None))
                base.append(sum(v for v in values if v is not None))
                tail.append(rest)
            ids = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            columns = [n_tokens, n_head, base, scores, [len(t) for t in texts]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(tail, pa.list_(pa.binary())), others], names
            )

    shape = "row long, doc_id long, learned boolean, n_tokens long, n_head long, head_score double, score double, n_bytes long, tail array<binary>, runs array<long>"
    scored = written(rows.mapInArrow(run, shape), "scores")
    # rarer words meet their counts in an ordinary join: each has under HEAD of all texts' words, so no key is hot
    rare = words.where((F.col("n") > 0) & (F.col("every") < least)).select("word", F.log10((F.col("n") + 1) / scale).alias("value"))
    met = scored.select("row", F.explode("tail").alias("word")).join(rare, "word").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum("value").alias("rare_score"))
    # the same for rarer runs
    more = scored.select("row", F.explode("runs").alias("key")).join(runs, "key").groupBy("row").agg(F.sum("value").alias("run_score"))
    scored = scored.join(more, "row", "left")
    score = F.col("score") + F.coalesce("run_score", F.lit(0.0))
    end = log10((ends + 1) / scale)
    n_rare = F.coalesce("n_rare", F.lit(0))
    return scored.drop("tail", "runs").join(met, "row", "left").select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("n_head") + n_rare + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("head_score")
            + F.coalesce("rare_score", F.lit(0.0))
            + F.lit(end)
            + (F.col("n_tokens") - 1 - F.col("n_head") - n_rare) * F.lit(unknown)
        ).alias("base_score"),
        score.alias("score"),
        (score * F.lit(-np.log2(10).item()) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
