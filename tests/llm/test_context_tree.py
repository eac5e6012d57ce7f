import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakwise.llm import context_tree as ct


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def brute_model(texts):
    """P(byte after a context) by the recursive definition, from plain dictionaries."""
    seen = Counter()
    for t in texts:
        whole = ct.EDGE * ct.DEPTH + t + ct.EDGE
        for i in range(ct.DEPTH, len(whole)):
            seen[whole[i - ct.DEPTH : i], whole[i]] += 1
    kept = {b""} | {c[-d:] for c, _ in seen for d in range(1, ct.DEPTH + 1)}
    bits = lambda byte: [(1 << k | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]
    own, rest = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (c, byte), n in seen.items():
        path = [c[ct.DEPTH - d :] for d in range(ct.DEPTH + 1)]
        path = [p for p in path if p in kept]
        for node, bit in bits(byte):
            for p in path:
                own[p, node][bit] += n
            rest[path[-1], node][bit] += n

    def log_w(c, node):
        if len(c) == ct.DEPTH:
            return kt(*own[c, node])
        return np.logaddexp(kt(*own[c, node]), children(c, node)) - math.log(2)

    def children(c, node):
        return kt(*rest[c, node]) + sum(log_w(k, node) for k in kept if len(k) == len(c) + 1 and k.endswith(c))

    def probability(before, byte):
        p = 1.0
        path = [before[len(before) - d :] for d in range(ct.DEPTH + 1)]
        path = [c for c in path if c in kept]
        for node, bit in bits(byte):
            q, left = 0.0, 1.0
            for c in path:
                a, b = own[c, node]
                w = 1.0 if len(c) == ct.DEPTH else math.exp(kt(a, b) - math.log(2) - log_w(c, node))
                q += left * w * (b + 0.5) / (a + b + 1)
                left *= 1 - w
            a, b = rest[path[-1], node]
            q += left * (b + 0.5) / (a + b + 1)
            p *= q if bit else 1 - q
        return p

    def score(t):
        whole = ct.EDGE * ct.DEPTH + t + ct.EDGE
        return sum(math.log10(probability(whole[i - ct.DEPTH : i], whole[i])) for i in range(ct.DEPTH, len(whole)))

    return score


@pytest.mark.parametrize("head", [2.0**-20, 0.2])
def test_scores_follow_the_definition(spark, monkeypatch, head):
    monkeypatch.setattr(ct, "HEAD", head)  # all words broadcast, or most of them joined
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "abc", "é", " ", "ba"]) for _ in range(rng.randrange(12))) for _ in range(14)] + [None, "", "only only only here", "x"]
    rows = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, tail string, score double").repartition(3)
    got = {r.doc_id: r for r in ct.lm_scores(rows, F.col("doc_id") % 4 != 0).collect()}
    learned = [(t or "") for i, t in enumerate(texts) if i % 4]
    score = brute_model([t.encode() for t in learned])
    counts = Counter(w for t in learned for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*(t or "").lower().split(), None]
        assert got[i].score == pytest.approx(score((t or "").encode()), rel=1e-5)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)


def test_blocks_do_not_change_counts_or_scores(monkeypatch):
    texts = [b"abcabc" * 50, b"", b"xyz"]
    tables = list(ct.run_counts(iter([(texts, True), (texts[:1], False)])))
    (keys, n, every), blocks = tables[0], ct.blocks
    assert n.sum() == sum(len(t) + 1 for t in texts) and every.sum() == n.sum() + len(texts[0]) + 1
    some = keys[::2]
    values = np.arange(len(some), dtype=np.float32)
    scores, rest = ct.run_scores(texts, some, values)
    monkeypatch.setattr(ct, "blocks", lambda t, limit=7: blocks(t, limit))
    again, rest2 = ct.run_scores(texts, some, values)
    assert np.allclose(scores, again) and rest.to_pylist() == rest2.to_pylist()
    for a, b in zip(tables[0], list(ct.run_counts(iter([(texts, True), (texts[:1], False)])))[0], strict=True):
        assert (a == b).all()


def test_empty_and_untrained(spark):
    shape = "doc_id long, text string"
    assert ct.lm_scores(spark.createDataFrame([], shape), F.lit(True)).count() == 0
    (r,) = ct.lm_scores(spark.createDataFrame([(None, "ab")], shape), F.lit(None).cast("boolean")).collect()
    assert r.score == pytest.approx(-3 * math.log10(256), rel=1e-5) and r.n_known == 0 and r.train_tokens == 0


def test_contexts_of_any_rarity_count(spark, monkeypatch):
    texts = ["a" * 70000, "xyzzy"]
    rows = spark.createDataFrame(list(enumerate([*texts, "xyzzy", "xyzza"])), "doc_id long, text string").repartition(2)
    want = brute_model([t.encode() for t in texts])
    for head in (2.0**-22, 0.5, 2.0):  # all runs broadcast, some, none
        monkeypatch.setattr(ct, "RUN_HEAD", head, raising=False)
        got = {r.doc_id: r.score for r in ct.lm_scores(rows, F.col("doc_id") < 2).collect()}
        assert got[2] == pytest.approx(want(b"xyzzy"), rel=1e-5) and got[3] == pytest.approx(want(b"xyzza"), rel=1e-5)
