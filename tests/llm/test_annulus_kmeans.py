import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakwise.llm.annulus_kmeans import NormIndex, annulus_kmeans

SHAPE = "vec_id long, embedding array<float>, label int, cluster int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SHAPE)


def brute(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    out = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], sum(inertia.values()), centroids[c]) for i, c, d in out]


@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 5), st.sampled_from([1, 3, 1000]))
@settings(max_examples=80, deadline=None)
def test_search_equals_comparing_with_all(seed, k, width, spread):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-spread, spread + 1, (k, width))
    x = rng.integers(-spread, spread + 1, (50, width))
    number, distance, compared = NormIndex(centroids).nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
    assert compared <= 50 * k


def test_a_tie_on_the_boundary_is_compared():
    # both lie at distance 5 on one line through the origin, so the norms are exactly ‖x‖ - 5 and ‖x‖ + 5
    for order in ([[0, 5], [0, 15]], [[0, 15], [0, 5]]):
        number, distance, _ = NormIndex(np.array(order)).nearest(np.array([[0, 10]]))
        assert number[0] == 0 and distance[0] == 25


def test_distant_norms_are_not_compared():
    centroids = np.zeros((64, 3), np.int64)
    centroids[:, 0] = np.arange(64) * 1000
    x = centroids[:, :] + 1
    assert NormIndex(centroids).nearest(x)[2] == 64


@pytest.mark.parametrize("k", [1, 3, 16])
def test_rows_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.5, 0.25, 1.0, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, [0.0] * 4), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0])]
    got = annulus_kmeans(table(spark, rows).repartition(5), k=k, width=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, k, 3, 4, 64), key=key)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.5, 0.5]) for i in range(9)]
    got = annulus_kmeans(table(spark, same), width=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 9
    assert annulus_kmeans(table(spark, [(1, None), (2, [1.0])]), width=2).count() == 0
    assert annulus_kmeans(table(spark, []), width=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_components_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        annulus_kmeans(table(spark, [(1, [1e30, 0.0])]), width=2)
