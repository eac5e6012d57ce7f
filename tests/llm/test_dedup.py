import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leakwise.llm import simhash_dedup as simhash
from leakwise.llm.common import written
from leakwise.llm.components import connected_components
from leakwise.llm.exact_dedup import MIDDLE, exact_dedup, heavy_candidates, summarise
from leakwise.llm.simhash_dedup import LEAST, fingerprint, links, simhash_dedup, tallies

SHAPE = "doc_id long, text string, digest string, keep_id long, fp long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 7) for i, t in rows], SHAPE)


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_exact_dedup_cases(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (2, "x" * 200_000), (2, "x" * 200_000), (None, "n"), (1, "a b")]
    got = exact_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[5, sha("a b")].keep_id == 3 and not by[5, sha("a b")].kept and by[3, sha("a b")].kept
    assert by[9, sha("")].keep_id == 8 and by[9, sha("")].group_size == 2
    assert by[2, sha("x" * 200_000)].group_size == 2 and by[2, sha("x" * 200_000)].kept
    assert by[None, sha("n")].keep_id is None and by[None, sha("n")].kept
    assert by[1, sha("a b")].group_size == 1
    assert exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_heavy_and_light_agree(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + [f"t{rng.randrange(40)}"])) for i in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(table(spark, rows).repartition(7), counters=5).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (min(same), len(same), i == min(same))


def test_summaries_are_merged_in_two_levels(spark):
    digests = spark.range(1000).selectExpr("cast(cast(id % 3 as string) as binary) as digest").repartition(9)
    df = heavy_candidates(digests, 4)
    assert df.count() == 3
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    levels = re.findall(r"MapInArrow|Exchange \w+|Coalesce", plan)
    assert levels[:5] == ["MapInArrow", "Exchange SinglePartition", "MapInArrow", "Exchange hashpartitioning", "MapInArrow"]
    assert f", {MIDDLE})" in plan


def test_misra_gries_keeps_each_heavy_digest():
    rng = random.Random(2)
    keys = [b"a"] * 300 + [b"b"] * 200 + [str(rng.randrange(400)).encode() for _ in range(500)]
    rng.shuffle(keys)
    batch = pa.RecordBatch.from_pydict({"digest": pa.array(keys, pa.binary()), "weight": pa.array([1] * len(keys), pa.int64())})
    (out,) = summarise(iter([batch]), 8)
    assert out.num_rows <= 8 and {b"a", b"b"} <= set(out.column(0).to_pylist())


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(0, i) for i in range(1, 300)] + [(500, 501)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
    }[shape]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, edges[0], (None, 3)], "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges}
    want = brute_components({n for a, b in edges if a != b for n in (a, b)}, lambda a, b: frozenset((a, b)) in linked)
    assert got == want


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_follows_its_definition():
    for text in ["", "   ", "One", "one Two", "a b c", "É a b C\x0bd", "x y z " * 50_000]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_links_are_those_of_brute_force(spark, limit):
    """Long lists that are split (1), some of them (3), none (100)."""
    rng = random.Random(limit)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        f = s
        for _ in range(25):
            for _ in range(rng.choice([1, 2, 3])):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    for byte in range(8):  # two bits of one byte, and one bit each of neighbours
        fps |= {seeds[0] ^ 1 << 8 * byte + i ^ 1 << (8 * byte + j) % 64 for i in range(8) for j in (1, 5, 8, 15)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = links(frame, list_limit=limit)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)]
    got = {r.node: r.root for r in connected_components(found).collect()}
    assert {n: got.get(n, n) for n in signed} == brute_components(signed, near)


def test_the_count_filter_rejects_pairs_of_one_shared_list(spark):
    """One bit in each of three bytes: five positions are shared, so the pair meets once and is rejected before it is verified."""
    frame = spark.createDataFrame([(0,), (1 | 1 << 8 | 1 << 16,), (1 | 1 << 8,), (7 << 40,)], "fp long")
    found = {(r.a, r.b): r.lists for r in tallies(frame).collect()}
    assert found == {(0, 1 | 1 << 8): 6, (0, 1 | 1 << 8 | 1 << 16): 1, (1 | 1 << 8, 1 | 1 << 8 | 1 << 16): 21, (0, 7 << 40): 21, (1 | 1 << 8, 7 << 40): 1}
    assert LEAST == 6
    assert sorted((r.a, r.b) for r in links(frame).collect()) == [(0, 1 | 1 << 8), (1 | 1 << 8, 1 | 1 << 8 | 1 << 16)]


def test_postings_are_never_broadcast(spark, monkeypatch):
    """By the planner's estimate, that of the fingerprints, they are small enough here; 13 million would be as well."""
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(simhash, "written", seen)
    near = F.when(F.col("id") % 2 == 1, F.xxhash64(F.col("id") - 1).bitwiseXOR(F.lit(1))).otherwise(F.xxhash64("id"))
    pairs = tallies(spark.range(400).select(near.alias("fp")), 2)
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert pairs.where(F.col("lists") >= LEAST).count() == 200


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, "another text"), (2, text), (None, text), (None, text)]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_dedup(table(spark, rows)).collect())
    assert got == [(0, 2), (0, 2), (2, 2), (5, 2), (5, 2), (5, 5)]


def test_simhash_dedup_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base.upper()), (7, base + " tail"), (1, None), (3, ""), (6, "other words entirely here"), (None, base), (6, "x"), (8, "a " * 100_000 + "b" * 300_000)]
    got = simhash_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {i: slow_fingerprint(t) for i, t in rows if i not in (6, None)}
    for r in got:
        if r.doc_id in fps:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}"
    of = {r.doc_id: r.component_id for r in got if r.doc_id != 6}
    assert of[9] == of[4] == of[None] and of[1] == of[3] == 1
    assert (of[7] == of[9]) == (bin(fps[7] ^ fps[9]).count("1") <= 2)
    assert simhash_dedup(table(spark, [])).count() == 0
