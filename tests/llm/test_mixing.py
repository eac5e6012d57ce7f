import random
from collections import defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from leakwise.llm.mixing import LEAF, Targets, leaf_budgets, mix, order_key

SHAPE = "doc_id long, dom string, lang string, src string, n long, tokens long, key long, bound long"


def brute_budgets(held, t):
    """Exact rising water at every node, capacities by recursion."""
    weight = lambda path: Fraction(t.weights[len(path) - 1].get(path[-1], t.other[len(path) - 1]))
    below = lambda path: sorted({k[: len(path) + 1] for k in held if k[: len(path)] == path})

    def capacity(path):
        if path and weight(path) <= 0:
            return Fraction(0)
        return Fraction(held[path] * t.max_epochs) if len(path) == len(LEAF) else sum(map(capacity, below(path)), Fraction(0))

    def down(path, budget):
        if len(path) == len(LEAF):
            return {path: floor(budget)}
        wants = {c: (weight(c), capacity(c)) for c in below(path)}
        budget = min(budget, sum(c for _, c in wants.values()))
        level, given = Fraction(0), lambda x: sum(min(c, x * max(w, 0)) for w, c in wants.values())
        for mark in sorted({c / w for w, c in wants.values() if w > 0}):
            if given(mark) >= budget:
                slope = (given(mark) - given(level)) / (mark - level) if mark > level else 1
                level += (budget - given(level)) / slope if slope else 0
                break
            level = mark
        return {k: v for c, (w, cap) in wants.items() for k, v in down(c, min(cap, level * max(w, 0))).items()}

    return down((), Fraction(t.budget_share) * sum(held.values()))


def budgets_of(spark, held, t):
    rows = spark.createDataFrame([(*k, n) for k, n in held.items()], "domain string, language string, source string, leaf_tokens long")
    return {tuple(r[k] for k in LEAF): r.budget for r in leaf_budgets(rows, t).collect()}


def test_shortages_go_to_siblings_first(spark):
    t = Targets(weights=({"a": 1, "b": 1}, {"x": 1, "y": 1}, {}), max_epochs=1, budget_share=0.5)
    held = {("a", "x", "s"): 10, ("a", "y", "s"): 500, ("b", "x", "s"): 290}
    assert budgets_of(spark, held, t) == {("a", "x", "s"): 10, ("a", "y", "s"): 190, ("b", "x", "s"): 200}
    t = Targets(weights=({"a": 1, "b": 3}, {}, {}), max_epochs=2, budget_share=1.0)
    assert budgets_of(spark, {("a", "x", "s"): 90, ("b", "x", "s"): 10}, t) == {("a", "x", "s"): 80, ("b", "x", "s"): 20}
    t = Targets(weights=({}, {"en": 1, "de": 0}, {}), max_epochs=1, budget_share=0.5)
    assert budgets_of(spark, {("a", "de", "s"): 1000, ("b", "en", "s"): 1000}, t) == {("a", "de", "s"): 0, ("b", "en", "s"): 1000}


def test_budgets_equal_brute_force_on_random_trees(spark):
    """Many trees side by side would be one tree, so each is its own frame; weights of 0 and empty leaves are common."""
    rng = random.Random(8)
    for _ in range(6):
        held = {(rng.choice("abcd"), rng.choice("xyz"), f"s{rng.randrange(6)}"): rng.choice([0, 1, 7, rng.randrange(1, 5000)]) for _ in range(40)}
        weights = tuple({n: rng.choice([0, 0, 0.5, 1, 4]) for n in names} for names in ("abc", "xy", ["s0", "s1", "s2"]))
        t = Targets(weights=weights, other=(1.0, 0.25, 2.0), max_epochs=rng.choice([1, 2, 3]), budget_share=rng.choice([0.25, 0.5, 1.0, 3.0]))
        got, want = budgets_of(spark, held, t), brute_budgets(held, t)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1 for k in want), (held, t)
        assert sum(got.values()) >= sum(want.values()) - len(want)


@pytest.mark.parametrize(("epochs", "share", "broadcast"), [(1, 0.6, 100), (3, 1.0, 0)])
def test_mix_takes_the_planned_prefixes(spark, epochs, share, broadcast):
    rng = random.Random(epochs)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "de"]), "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2"]), rng.randrange(0, 60)) for i in range(500)]
    rows += [(600, "a", None, None, None), (601, "zero", "en", "s", 0), (7, *rows[7][1:]), (None, "b", "de", "s1", 3)]
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SHAPE)
    t = Targets(weights=({"a": 0.8, "b": 0.2}, {"en": 1, "de": 2}, {"s2": 0}), max_epochs=epochs, budget_share=share, broadcast_leaves=broadcast)
    got = mix(frame, {"domain": F.col("dom"), "language": F.col("lang"), "source": F.col("src")}, F.col("n"), t).collect()
    leaves = defaultdict(list)
    for i, d, k, s, n in rows:
        leaves[d, k or "", s or ""].append((i, n or 0))
    budgets = brute_budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, t)
    keys = {}
    for e in range(epochs + 1):
        ids = spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "doc_id long")
        keys |= {(e, r.doc_id): r.key for r in ids.select("doc_id", order_key(t.seed, F.lit(e), "doc_id").alias("key")).collect()}
    taken = defaultdict(list)
    for r in got:
        taken[tuple(r[k] for k in LEAF)].append((r.epoch, r.doc_id))
    for leaf, docs in leaves.items():
        total = sum(n for _, n in docs)
        passes, rest = divmod(budgets[leaf], total) if total else (0, 0)
        want = [(e, i) for e in range(passes) for i, _ in docs]
        upto = 0
        for key in sorted({keys[passes, i] for i, _ in docs}) if rest else []:
            same = [(i, n) for i, n in docs if keys[passes, i] == key]
            upto += sum(n for _, n in same)
            if upto > rest:
                break
            want += [(passes, i) for i, _ in same]
        order = lambda x: (x[0], -1 if x[1] is None else x[1])
        assert sorted(taken[leaf], key=order) == sorted(want, key=order)
    assert mix(frame.limit(0), {"domain": F.col("dom"), "language": F.col("lang"), "source": F.col("src")}, F.col("n"), t).count() == 0
