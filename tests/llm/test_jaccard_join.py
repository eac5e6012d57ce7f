import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakwise.llm import jaccard_join
from leakwise.llm.jaccard_join import BoxTree, cell_keys, differing, jaccard_components, needed, point, shared_at_most, shingle_hashes, spanning, tree_join
from test_dedup import brute_components

SHAPE = "doc_id long, text string, node long, keys string, label string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SHAPE)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    near = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    root = brute_components(range(len(rows)), near)
    ids = {}
    for i, r in root.items():
        ids.setdefault(r, []).append(rows[i][0])
    smallest = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(rows[i][0], len(sets[i]), smallest[r]) for i, r in root.items()]


def same(got, rows, percent=90):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, percent), key=key)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=25):
    """Groups of copies with 0 to 8 edits, chains of them, and texts that share a passage."""
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 11, 14, 30, 60, 150, 300]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 12])):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 8]))))
            if rng.random() < 0.3:
                base = texts[-1].split(" ")
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [90, 80])
def test_components_equal_brute_force(spark, percent):
    rows = corpus(1)
    got = jaccard_components(table(spark, rows).repartition(5), percent=percent).collect()
    same(got, rows, percent)
    assert any(r.component_id != r.doc_id for r in got)


def test_long_cells_are_split_into_pages(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4])))) for i in range(160)]
    monkeypatch.setattr(jaccard_join, "PAGE", 16)
    same(jaccard_components(table(spark, rows)).collect(), rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(4, None), (2, ""), (9, " \t\n"), (7, "a b"), (6, "A  b"), (5, "a"), (8, "a"), (3, "x y z"), (3, "x y z"), (3, "other text here"), (None, "x y z"), (None, "only null"), (None, "Only null")]
    rows += [(20, long), (19, long + " tail"), (21, "w1 w2 w3"), (22, "a b c a b c a b c"), (10, "a b c d"), (11, "a b c d")]
    same(jaccard_components(table(spark, rows)).collect(), rows)
    assert jaccard_components(table(spark, [])).collect() == []
    assert jaccard_components(table(spark, [(1, None)])).collect() == [(1, 0, 1)]


@given(st.integers(1, 400), st.integers(0, 10_000), st.sampled_from([50, 80, 90, 95]))
@settings(max_examples=150, deadline=None)
def test_sets_within_the_threshold_meet_in_a_cell_and_pass_the_bounds(size, seed, percent):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(1, 1 << 62, 2 * size + 40).astype(np.uint64))
    rng.shuffle(pool)
    a = np.sort(pool[:size])
    dropped, added = rng.integers(0, size // 3 + 1), rng.integers(0, size // 3 + 2)
    b = np.sort(np.r_[a[rng.permutation(size)[dropped:]], pool[size : size + added]])
    shared = len(np.intersect1d(a, b))
    if 100 * shared < percent * (len(a) + len(b) - shared) or np.array_equal(a, b):
        return
    assert len(a) + len(b) - 2 * shared <= differing(len(a), len(b), percent) and shared >= needed(len(a), len(b), percent)
    assert len(np.intersect1d(cell_keys(a, percent), cell_keys(b, percent)))
    assert shared_at_most(point(a)[None], point(b)[None])[0, 0] >= shared


@given(st.integers(0, 10_000), st.integers(1, 70), st.integers(1, 70))
@settings(max_examples=40, deadline=None)
def test_tree_join_equals_all_pairs(seed, n, m):
    rng = np.random.default_rng(seed)
    x, y = (rng.poisson(rng.choice([1, 3], (k, 1)), (k, jaccard_join.GROUPS)).astype(np.uint16) for k in (n, m))
    y[: min(n, m) // 2] = x[: min(n, m) // 2]
    p, q = BoxTree(x, x.sum(1).astype(np.int64)), BoxTree(y, y.sum(1).astype(np.int64))
    every = {(i, j) for i in range(n) for j in range(m) if 190 * np.minimum(x[i], y[j]).sum(dtype=int) >= 90 * (x[i].sum(dtype=int) + y[j].sum(dtype=int))}
    i, j, _ = tree_join(p, q, 90, same=False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == every and len(i) == len(every)
    i, j, _ = tree_join(p, p, 90, same=True)
    assert len({frozenset(t) for t in zip(i.tolist(), j.tolist(), strict=True)}) == len(i) and not (i == j).any()


def test_boxes_that_cannot_share_enough_are_not_entered(monkeypatch):
    x = np.zeros((64, jaccard_join.GROUPS), np.uint16)
    for i in range(4):
        x[16 * i : 16 * i + 16, 20 * i : 20 * i + 20] = 3
    tree = BoxTree(x, x.sum(1).astype(np.int64))
    entered = []
    real = shared_at_most
    monkeypatch.setattr(jaccard_join, "shared_at_most", lambda a, b: entered.append(len(a)) or real(a, b))
    tree_join(tree, tree, 90, same=True)
    assert len(entered) == 1 + 4  # the boxes among each other, and each of the four leaves with itself


def test_forest_prefers_similar_pairs_and_known_labels():
    rows, others, similar = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([0.91, 0.99, 0.95, 0.92])
    assert sorted(spanning(rows, others, similar, np.array([0, 1, 2, 3]))) == [1, 2, 3]
    assert sorted(spanning(rows, others, similar, np.array([0, 0, 2, 3]))) == [1, 3]
    assert len(shingle_hashes(b"")) == 0 and len(shingle_hashes(b"a b")) == 1 and len(shingle_hashes(b"a b c a b c")) == 3
