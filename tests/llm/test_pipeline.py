import importlib.util
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    to = tmp_path_factory.mktemp("tables")
    base = [f"plain text number {i} " + " ".join(f"w{(i * 37 + k * k) % 911}" for k in range(120)) for i in range(60)]
    rows = [(i, t, ["en", "de"][i % 2], f"src{i % 5}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[3].replace(" ", "  "), "en", "src0", 9), (101, base[4] + " end", "en", "src0", 9), (102, " ".join(w.upper() + "!!" for w in base[5].split()), "en", "src1", 9)]
    rows += [(103, None, None, None, None), (104, "", "en", "src1", 0), (None, base[7], "en", "src2", 3)]
    rows += [(200 + i, " ".join(f"{w}###" for w in base[i].split()), "en", "src1", 9) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(200 + i, 0, 0) for i in range(18)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_stages_and_run(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not seen["quality"] & set(range(200, 220)) and set(range(60)) <= seen["quality"]
    assert 100 not in seen["dedup_exact"] and 3 in seen["dedup_exact"]
    assert seen["dedup_near"] <= seen["dedup_exact"] and set(range(60)) - {4, 101} <= seen["dedup_near"]
    assert seen["mix_sources"] <= seen["dedup_near"] and len(seen["mix_sources"]) > 0.7 * len(seen["dedup_near"])
    got = p.run(spark, folder).collect()
    assert {r.doc_id for r in got} == seen["mix_sources"]
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 1024


def test_each_stage_equals_brute_force(spark, folder):
    import corpus_pipeline as p
    from leakwise.llm.common import remainder
    from leakwise.llm.mixing import order_key
    from leakwise.llm.packing import cut
    from leakwise.llm.quality import features, learn_quality
    from test_dedup import brute_components, slow_fingerprint
    from test_mixing import brute_budgets
    from test_packing import best_fit_one_by_one, plain_encoder

    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    rows["input"] = [tuple(r) for r in docs.collect()]
    models = {"quality": learn_quality(docs, p.labels(spark, folder), remainder("doc_id", 5) != 0)}
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, folder), name)
        rows[name] = [tuple(r) for r in docs.collect()]
    high = lambda i: (i is None, i or 0)

    score = models["quality"].score(np.array([features(r[1]) for r in rows["input"]]))
    assert Counter(rows["quality"]) == Counter(r for r, s in zip(rows["input"], score, strict=True) if s >= p.CUT_SCORE)

    groups = defaultdict(list)
    for r in rows["quality"]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    assert {r[0] for r in rows["dedup_exact"]} == {min((r[0] for r in g), key=high) for g in groups.values()} and len(rows["dedup_exact"]) == len(groups)

    fps = {r: slow_fingerprint(r[1]) for r in rows["dedup_exact"]}
    roots = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(list)
    for r, f in fps.items():
        groups[roots[f]].append(r)
    assert {r[0] for r in rows["dedup_near"]} == {min((r[0] for r in g), key=high) for g in groups.values()} and len(rows["dedup_near"]) == len(groups)

    leaves = defaultdict(list)
    for i, text, lang, source, _ in rows["dedup_near"]:
        number = re.search("[0-9]{1,9}$", source or "")
        leaves[f"d{int(number[0]) % 4 if number else 0}", lang or "", source or ""].append((i, len((text or "").split())))
    budgets = brute_budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, p.MIX)
    want = Counter()
    for leaf, members in leaves.items():
        total = sum(n for _, n in members)
        passes, rest = divmod(budgets[leaf], total) if total else (0, 0)
        ids = spark.createDataFrame([(i, n) for i, n in members], "doc_id long, n long").withColumn("key", order_key(p.MIX.seed, F.lit(passes), "doc_id"))
        want += Counter({i: passes for i, _ in members if passes})
        upto, closed = 0, rest == 0
        for i, n, _ in sorted(map(tuple, ids.collect()), key=lambda x: x[2]):
            upto += n
            closed = closed or upto > rest
            want[i] += not closed
    assert Counter(r[0] for r in rows["mix_sources"]) == +want

    got, encode = p.packing(spark, docs, folder).collect(), plain_encoder()
    pieces = [(r[0], k, start, n) for r in rows["mix_sources"] for k, (start, n) in enumerate(cut(len(encode(r[1] or "")) + 1, 1024))]
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == Counter(pieces)
    assert len({r.sequence_id for r in got}) == best_fit_one_by_one([n for *_, n in pieces], 1024)
    assert docs.columns == columns


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("x") for c in ("digest", "score", "key", "tokens", "copies", "stays", "root", "capacity", "budget", "place", "id_of")})
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        after = stage(spark, docs, folder)
        kept = [r.asDict() for r in after.collect()]
        assert after.columns == docs.columns and kept and all(r[c] == "x" for r in kept for c in docs.columns[5:]), name
    assert p.packing(spark, docs.limit(0), folder).count() == 0 and p.packing(spark, docs, folder).count() > 0


def test_each_query_is_registered():
    spec = importlib.util.spec_from_file_location("entry_module", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    names = set(module.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(module.oracle_sql()) <= names


def test_mixing_reaches_its_weights(spark):
    import corpus_pipeline as p

    rows = [(i, "w " * 10, "en", f"src{i % 4}", 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.mix_sources(spark, docs, "").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == pytest.approx({"src0": 160, "src1": 120, "src2": 80, "src3": 40}, abs=1)


def test_dedup_decides_by_row(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{(i * i) % 97}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, d), (None, d), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {(1, a), (2, b), (3, c), (None, d), (None, "")}
    for stage in (p.dedup_exact, p.dedup_near):
        got = [tuple(r) for r in stage(spark, docs, "").collect()]
        assert len(got) == len(want) and set(got) == want


def test_near_dedup_broadcasts_no_postings(spark, folder, monkeypatch):
    """The texts have 56 postings each, which the planner estimates as one."""
    import corpus_pipeline as p
    from leakwise.llm import simhash_dedup as simhash

    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return p.written(df, label)

    monkeypatch.setattr(simhash, "written", seen)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    p.dedup_near(spark, docs, folder)
    assert "SortMergeJoin" in plans["postings"] and "Broadcast" not in plans["postings"]


def test_dedup_passes_no_rows_through_the_driver(spark, folder, monkeypatch):
    """All tables are below the broadcast threshold here; just below it, relations in the driver's heap are several times
    as large. Only lists of bounded length (exact dedup's heavy digests) may be broadcast."""
    import corpus_pipeline as p
    from leakwise.llm import common, components
    from leakwise.llm import simhash_dedup as simhash

    plans = defaultdict(list)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans[label].append(plan(df))
        return common.written(df, label)

    for module in (p, components, simhash):
        monkeypatch.setattr(module, "written", seen)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    repeated = docs.unionByName(docs.where("doc_id < 3"))
    for table in (docs, repeated):
        plans["result"].append(plan(p.dedup_near(spark, table, folder)))
    assert len(plans["components"]) >= 4 and {"links", "near", "staying"} <= set(plans)
    assert not [k for k, v in plans.items() if any("Broadcast" in x for x in v)]
    plans.clear()
    result = plan(p.dedup_exact(spark, repeated, folder))
    assert "SortMergeJoin" in plans["staying"][0] and "Broadcast" not in result
