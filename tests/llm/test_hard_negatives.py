import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwise.llm.hard_negatives import ListIndex, bounds, fit_centroids, hard_negatives, top, visits

SHAPE = "vec_id long, embedding array<double>, label int, key string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 7) for i, v, y in rows], SHAPE)


def brute(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = [(i, [int(np.floor(x * scale)) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, y in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j, z) for j, v, z in kept)
        for s, j, _ in [r for r in scored if r[2] == y and r[1] != i][:positives]:
            fits = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return out


@pytest.mark.parametrize("block", [7, 1024])
@pytest.mark.parametrize("kind", ["spread", "ties", "clusters"])
def test_rows_equal_brute_force(spark, kind, block):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        if kind == "ties":
            v = [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)]
        elif kind == "clusters":
            v = [x + rng.gauss(0, 0.02) for x in [(1, 0, 0), (0, 1, 0), (0.6, 0.6, 0.5)][i % 3]]
        else:
            v = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, v, rng.randrange(3)))
    rows += [rows[10], rows[10], (10, [0.1, 0.2, 0.3], 2), (400, [1.0], 1), (401, [], 1), (402, None, 1), (403, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(404, [float("nan"), 1.0, 1.0], 1), (405, [float("-inf"), 1.0, 1.0], 1), (406, [None, 1.0, 1.0], 1)]
    got = hard_negatives(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 10))


def test_hot_copies(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(150)] + [(i, [0.9, 0.9], 1) for i in range(150, 320)] + [(i, [0.2, -1.0], 2) for i in range(320, 350)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 25 == 0, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 25))


def test_small_and_empty_tables(spark):
    anchor = F.col("vec_id") % 2 == 0
    assert hard_negatives(table(spark, []), anchor).count() == 0
    assert hard_negatives(table(spark, [(2, None, 1)]), anchor).count() == 0
    assert hard_negatives(table(spark, [(2, [1.0], 1), (3, [1.0], 1)]), anchor).count() == 0
    empties = [(2, [], 1), (3, [], 1), (4, [], 2)]
    assert sorted(map(tuple, hard_negatives(table(spark, empties), anchor).collect())) == brute(empties, 2)
    with pytest.raises(Exception, match="beyond"):
        hard_negatives(table(spark, [(2, [1e30], 1)]), anchor).count()


def index_of(x, k):
    centroids = fit_centroids(x, k)
    gap = ((x[:, None] - centroids[None]) ** 2).sum(2)
    which = gap.argmin(1)
    used = np.unique(which)
    radius = np.array([np.sqrt(gap[which == c, c].max()) for c in used])
    return ListIndex(None, centroids, used, radius, x.shape[1]), [np.flatnonzero(which == c) for c in used]


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_bounds_hold_and_no_wanted_row_is_skipped(seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-30, 31, (80, 4)), rng.integers(-30, 31, (6, 4))
    index, members = index_of(x, 8)
    scores = q @ x.T
    under, over = bounds(index, q)
    for b, rows in enumerate(members):
        assert (scores[:, rows] >= under[:, b, None]).all() and (scores[:, rows] <= over[:, b, None]).all()
    low, high = np.full((6, 1), -200), np.full((6, 1), 600)
    found = [set() for _ in q]
    least = low.copy()
    for begin, end in ((0, 2), (2, 5), (5, 8)):
        for i, b in zip(*visits(index, q, low, least, high, begin, end), strict=True):
            found[i] |= {(-int(scores[i, r]), int(r)) for r in members[b] if low[i, 0] <= scores[i, r] <= high[i, 0]}
        for i, f in enumerate(found):
            if len(f) >= 3:
                least[i, 0] = -sorted(f)[2][0]
    for i, f in enumerate(found):
        every = sorted((-int(s), r) for r, s in enumerate(scores[i]) if low[i, 0] <= s <= high[i, 0])
        assert sorted(f)[:3] == every[:3]


def test_lists_outside_the_window_and_below_the_kth_are_skipped():
    x = np.array([[100, 0], [101, 1], [50, 0], [51, 1], [-90, 0], [-91, 1]])
    index, members = index_of(x, 3)
    q, at = np.array([[10, 0]]), lambda low, least, high: {tuple(members[b]) for b in visits(index, q, *(np.array([[v]]) for v in (low, least, high)), 0, 3)[1]}
    assert at(-5000, -5000, 5000) == {(0, 1), (2, 3), (4, 5)}
    assert at(400, 400, 700) == {(2, 3)}
    assert at(-5000, 600, 5000) == {(0, 1)}


def test_top_by_score_then_place():
    row, column = top(np.array([[5, 7, 7, 7, 1]]), np.array([[True, False, True, True, True]]), 2)
    assert sorted(column) == [2, 3] and set(row) == {0}
