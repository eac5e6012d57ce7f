import datetime
import hashlib
import re

import pytest
import rowforms
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwise.functions import paths
from leakwise.functions import text as tx
from leakwise.operators import exclusions as ex
from leakwise.operators import gate as g
from leakwise.operators import history, matches, overlap, policy, scoring, triage
from leakwise.operators.matching import Exclusions
from leakwise.operators.membership import Membership, memberships
from leakwise.operators.matches import PatternRule
from leakwise.rules.extensions import ExtensionTables, read_table
from leakwise.schema import EXCEPTION, confidence_name, confidence_number

SPANS = st.lists(st.tuples(st.integers(0, 24), st.integers(0, 5), st.integers(0, 4)), max_size=12)


def rows_of(spans):
    return [
        {"raw_start": s, "raw_end": s + n, "confidence": c, "start_line": s // 6, "end_line": (s + n) // 6, "start_char": s % 6, "end_char": (s + n) % 6, "provider_id": f"p{i}", "headline": "h", "source": None, "i": i}
        for i, (s, n, c) in enumerate(spans)
    ]


@settings(max_examples=400, deadline=None)
@given(SPANS)
def test_drop_contained_follows_its_definition(spans):
    rows = rows_of(spans)
    proper = lambda a, b: a["raw_start"] <= b["raw_start"] and b["raw_end"] <= a["raw_end"] and (a["raw_start"], a["raw_end"]) != (b["raw_start"], b["raw_end"])
    want = [r["i"] for r in rows if not any(proper(o, r) and o["confidence"] >= r["confidence"] for o in rows)]
    assert [r["i"] for r in overlap.drop_contained(rows)] == want


def test_window_form_equals_the_row_form(spark):
    import random

    rng, rows = random.Random(7), []
    for k in range(60):
        rows += [(f"f{k}", s, s + n, c) for s, n, c in ((rng.randrange(24), rng.randrange(6), rng.randrange(5)) for _ in range(rng.randrange(12)))]
    frame = spark.createDataFrame(rows, "location string, raw_start long, raw_end long, confidence int")
    got = sorted(tuple(r) for r in overlap.remove_overlapping(frame).collect())
    want = []
    for k in {r[0] for r in rows}:
        own = [dict(zip(frame.columns, r, strict=True)) for r in rows if r[0] == k]
        want += [tuple(r.values()) for r in overlap.drop_contained(own)]
    assert got == sorted(want)


@settings(max_examples=200, deadline=None)
@given(SPANS, st.randoms())
def test_subsumption_leaves_no_overlap_and_ignores_order(spans, rng):
    rows = rows_of(spans)
    kept = rowforms.subsume_rows(rows)
    assert all(not overlap.overlaps(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :])
    mixed = rows[:]
    rng.shuffle(mixed)
    assert rowforms.subsume_rows(mixed) == kept


@settings(max_examples=300, deadline=None)
@given(SPANS, st.lists(st.sampled_from(["", " ", "a", "abcdefgh", "xabcdefghy", "abcdefghi", "abcdefgh  ", "hgfedcba", "zz hgfedcba", "bc"]), min_size=12, max_size=12), st.randoms())
def test_components_change_nothing(spans, sources, rng):
    rows = rows_of(spans)
    for r, s in zip(rows, sources, strict=False):
        r["source"] = s or None
        if rng.random() < 0.3:
            r.update(start_line=rng.randrange(6), raw_end=0), r.update(end_line=r["start_line"] + rng.randrange(2))
    assert overlap.subsume_rows(rows) == rowforms.subsume_rows(rows)


def test_many_findings_of_one_file_are_settled_in_seconds():
    import time

    rows = [{"raw_start": 60 * i, "raw_end": 60 * i + 40, "confidence": i % 4, "start_line": 0, "end_line": 0, "start_char": 60 * i, "end_char": 60 * i + 40, "provider_id": "p", "headline": "h", "source": f'apiKey = "{hashlib.md5(str(i).encode()).hexdigest()}"'} for i in range(83_888)]
    began = time.time()
    assert len(overlap.subsume_rows(overlap.drop_contained(rows))) == len(rows)
    assert time.time() - began < 60


def test_adjacent_lines_overlap():
    a, b = rows_of([(0, 6, 3), (7, 2, 3)])
    a.update(start_line=2, end_line=3, raw_end=6), b.update(start_line=3, end_line=3, raw_start=7)
    assert overlap.overlaps(a, b) and rowforms.subsume_rows([b, a]) == [a]


def test_stored_subsumption_equals_the_row_form(spark):
    rows = rows_of([(0, 5, 3), (4, 5, 2), (12, 3, 1), (13, 1, 4), (30, 0, 0)])
    frame = spark.createDataFrame([("f", 0, *[r[c] for c in overlap._READ]) for r in rows] , "location string, repo_index int, raw_start long, raw_end long, start_line long, end_line long, start_char long, end_char long, confidence int, provider_id string, headline string, source string")
    assert sorted(r.provider_id for r in overlap.subsume(frame).collect()) == sorted(r["provider_id"] for r in rowforms.subsume_rows(rows))


# -- functions --------------------------------------------------------------------------------------------------------------


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_path_functions(spark):
    cases = [("a/b.java", ".java", "b", False), ("a.b/c", "", "c", False), ("x/.bashrc", ".bashrc", "", False), ("x/id_rsa.pub", ".pub", "id_rsa", False), ("p/myTeſt.go", ".go", "myTeſt", True), ("/TESTS/a", "", "a", True)]
    frame = spark.createDataFrame([(c[0],) for c in cases], "path string")
    got = frame.select(paths.extension(F.col("path")), paths.base_name(F.col("path")), paths.is_test_path(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
    assert one(spark, paths.git_to_https(F.col("a")), a=" git@h.x:o/r.git ") == "https://h.x/o/r.git"
    assert one(spark, paths.checkout_location(F.lit("/b/"), F.col("a")), a="https://h/o/r.git") == "/b/r"
    assert one(spark, paths.repository_of(F.col("a")), a="https://h/o/r.git/src/x") == "https://h/o/r.git"
    assert one(spark, paths.under_pruned_folder(F.col("a"), ["node_modules"]), a="x/node_modules/y.js") and not one(spark, paths.under_pruned_folder(F.col("a"), ["y.js"]), a="x/y.js")
    assert len(one(spark, paths.short_location(F.col("a")), a="p" * 80)) == 49 and one(spark, paths.short_location(F.col("a")), a="ab") == "ab"
    assert one(spark, paths.short_location(F.col("a")), a="a/b/" + "c/" * 40 + "d/e") == "a/b/.../d/e"
    assert triage.is_local("http://10.1.2.3:80/v1") and triage.is_local("http://localhost") and not triage.is_local("http://8.8.8.8") and not triage.is_local("::bad")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="\"'` \n\té x\\", max_size=9), min_size=20, max_size=60))
def test_trim_and_positions_as_columns(spark, texts):
    frame = spark.createDataFrame([(t, len(t.encode()) // 2) for t in texts], "t string, at long")
    got = frame.select(tx.trim_quotes(F.col("t")).alias("q"), tx.line_of(F.col("t"), F.col("at")).alias("l"), tx.character_of(F.col("t"), F.col("at")).alias("c")).collect()
    for t, r in zip(texts, got, strict=True):
        before = t.encode()[: len(t.encode()) // 2]
        assert r.q == rowforms.trim_quotes(t)[0]
        assert (r.l, r.c) == (before.count(b"\n"), len(before) - (before.rfind(b"\n") + 1))


def test_value_functions(spark):
    assert one(spark, tx.redacted(F.col("v")), v="short") == "***REDACTED***"
    shown = one(spark, tx.redacted(F.col("v")), v="abcdefghijklmnop")
    assert len(shown) == 16 and shown.count("*") == 9 and shown.startswith("abc") and shown.endswith("p")
    ident = one(spark, tx.finding_id(F.lit("r"), F.lit("p"), F.lit(0), F.lit(4), F.lit(None).cast("string")))
    assert ident == hashlib.sha256(b"r::p:1:5:").hexdigest()
    assert one(spark, tx.secret_type(F.lit("transversal"))) == "crypto.rsa_private_key" and one(spark, tx.secret_type(F.lit("x"))) == "generic.high_entropy"
    assert one(spark, tx.decoded(F.lit("aGk="), F.lit(True))) == "hi" and one(spark, tx.decoded(F.lit("hi"), F.lit(False))) == "hi"
    assert [one(spark, confidence_number(F.lit(n))) for n in ("CRITICAL", "info", "odd")] == [4, 0, 3] and one(spark, confidence_name(F.lit(2))) == "Medium"
    assert one(spark, tx.dash_if_blank(F.lit(" "))) == "-" and one(spark, tx.dash_if_blank(F.lit("a"))) == "a"
    assert one(spark, tx.contains_range(F.lit(0), F.lit(9), F.lit(0), F.lit(9))) and not one(spark, tx.position_le(F.lit(1), F.lit(5), F.lit(2), F.lit(3)))


# -- gate ----------------------------------------------------------------------------------------------------------------------


def test_gate_order_and_sniffing(spark, tmp_path):
    text = b"plain words\n" * 60
    rows = [("r/a.java", 10, text), ("r/tests/a.java", 10, text), ("r/x/.git/a.java", 10, text), ("r/a.xyz", 10, text), ("r/a.log", 20_000_000, text), ("r/a.java", 20_000_000, text), ("r/run", 10, text), ("r/run", 10, b"short"), ("r/run", 10, b"\x00" * 600), ("r/run", 10, b"<!DOCTYPE html>" + text), ("r/k.pem", 10, text)]
    files = spark.createDataFrame([(0, *r) for r in rows], "repo_index int, path string, size long, content binary")
    gated = g.gate(files, Exclusions(paths=("/[.]git/", "(")), exclude_tests=True)
    assert [r.gate_status for r in gated.collect()] == [g.SCAN, g.TEST, g.EXCLUDED, g.EXTENSION, g.SIZE, g.SCAN, g.SCAN, g.BINARY, g.BINARY, g.BINARY, g.EXTENSION]
    ignored = {r.location: r.excluded for r in g.ignored_rows(gated).collect()}
    assert ignored["r/a.xyz"] is False and ignored["r/a.log"] is True and "r/run" not in ignored
    (tmp_path / "financial.csv").write_text(".x,One\n.x,Two\nnot a row\n.y,Three\n")
    assert read_table(tmp_path / "financial.csv") == {".x": "One or Two", ".y": "Three"}
    tables = ExtensionTables().with_files(tmp_path)
    why = spark.createDataFrame([("readme.x",), ("b.x",), ("id_rsa.pub",), ("a.PEM",), ("a.pem",)], "path string").select(g.confidential_why(F.col("path"), tables).alias("w"))
    assert [r.w is not None for r in why.collect()] == [False, True, True, False, True]


@pytest.mark.parametrize("kinds,level", [([], 3), (["RSA PRIVATE KEY"], 4), (["PUBLIC KEY"], 0), (["PUBLIC KEY", "CERTIFICATE"], 0), (["CERTIFICATE"], 3), (["PUBLIC KEY", "EC PRIVATE KEY", "PUBLIC KEY"], 4)])
def test_certificates(spark, kinds, level):
    body = "".join(f"-----BEGIN {k}-----\nabc\n" for k in kinds).encode()
    files = spark.createDataFrame([(0, "a/x.pem", 10, body), (0, "a/x.p12", 10, body), (0, "a/id_rsa.pub", 10, body)], "repo_index int, path string, size long, content binary")
    got = {r.location: r for r in g.confidential_findings(g.gate(files)).collect()}
    assert got["a/x.pem"].confidence == level and got["a/x.p12"].confidence == 4 and got["a/id_rsa.pub"].confidence == 0
    assert got["a/x.pem"].sha256 == hashlib.sha256(body).hexdigest() and got["a/x.pem"].tags == ["confidential"]


# -- exclusions and exceptions ---------------------------------------------------------------------------------------------------


def test_exclusions(spark):
    e = Exclusions(values=("v",), value_patterns=("^x", "("), hashes=("h",), paths=("/skip/",), path_values={"src/a": ("pv",)}, path_hashes={"src/a": ("ph",)}, path_pattern_values={"[.]rb$": ("^r",)}, repositories=("/repo/",))
    rows = [("/repo/src/a", "v", ""), ("b", "xy", ""), ("b", "ok", "h"), ("/skip/b", "ok", ""), ("/repo/src/a", "pv", ""), ("src/b", "pv", ""), ("/repo/src/a", "ok", "ph"), ("z.rb", "rr", ""), ("z.py", "rr", ""), ("b", None, None)]
    got = ex.apply_exclusions(spark.createDataFrame(rows, "location string, value string, sha256 string"), e)
    assert sorted((r.location, r.value or "") for r in got.collect()) == [("b", ""), ("src/b", "pv"), ("z.py", "rr")]
    merged = ex.merge_exclusions(Exclusions(values=("a", "b"), hashes=("h",)), Exclusions(values=("b", "c"), path_values={"p": ("1",)}), Exclusions(path_values={"p": ("1", "2")}), keep_hashes=False)
    assert merged.values == ("a", "b", "c") and merged.hashes == () and merged.path_values == {"p": ("1", "2")}
    assert ex.prunable_folder(r".*/[.]git/.*") == ".git" and ex.prunable_folder(".*/node_modules/.*") == "node_modules" and ex.prunable_folder(".*[.]md") is None


SCOPES = [
    ("globalHash", {"secret_checksum": "h1"}, True), ("globalHash", {"secret_checksum": "h2"}, False), ("globalString", {"string_match": "ecr"}, True), ("globalString", {"string_match": ""}, False),
    ("globalRegex", {"regex_match": "^sec"}, True), ("globalRegex", {"regex_match": "("}, False), ("pathRegex", {"path": "src/.*go"}, True), ("pathRegex", {"path": "["}, False),
    ("pathString", {"path": "/app.go", "string_match": "secret"}, True), ("pathString", {"path": "app.go", "string_match": "secret"}, False), ("pathHash", {"path": "/src/app.go", "secret_checksum": "h1"}, True),
    ("pathRegexRegex", {"path": "go$", "regex_match": "ret"}, True), ("pathRegexRegex", {"path": "go$", "regex_match": "zzz"}, False), ("global", {}, True), ("project", {}, True), ("directory", {"path": "/r/src"}, True),
    ("directory", {"path": "/x"}, False), ("file", {"path": "/r/src/app.go"}, True), ("file", {"path": "/pp.go"}, False), ("line", {"path": "/src/app.go", "line_start": 5, "line_end": 5}, True),
    ("line", {"path": "/src/app.go", "line_start": 6, "line_end": 9}, False), ("odd", {}, False), ("global", {"status": "revoked"}, False), ("global", {"expires_at": datetime.datetime(2020, 1, 1)}, False), ("global", {"rule_id": "other"}, False), ("global", {"rule_id": "rule"}, True),
]


def exception(i, kind, **values):
    base = dict.fromkeys([c.split()[0] for c in EXCEPTION.split(", ")])
    return tuple((base | {"id": f"e{i}", "ord": i, "type": kind, "status": "active", "rule_id": "*"} | values).values())


def findings_frame(spark):
    return spark.createDataFrame([("f1", "rule", "/r/src/app.go", "h1", "secret", 4), ("f2", "rule", "", None, None, 0)], "finding_id string, headline string, location string, sha256 string, source string, start_line long")


def test_exception_scopes(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    found = findings_frame(spark).where("finding_id = 'f1'")
    # one job: each scope gets a finding of its own by its rule
    many, rules = None, []
    for i, (kind, values, _) in enumerate(SCOPES):
        own = found.withColumns({"finding_id": F.lit(f"f{i}"), "headline": F.lit(f"rule{i}")})
        many = own if many is None else many.unionByName(own)
        rule = {"*": f"rule{i}", "rule": f"rule{i}"}.get(values.get("rule_id", "*"), "none")
        rules.append(exception(i, kind, **(values | {"rule_id": rule})))
    for literals in (64, 0):  # one expression, and literal arrays
        got = {r.finding_id: r.suppressed for r in ex.match_exceptions(many, spark.createDataFrame(rules, EXCEPTION), now, max_literals=literals).collect()}
        assert [got[f"f{i}"] for i in range(len(SCOPES))] == [w for *_, w in SCOPES]


def test_both_forms_of_exceptions_judge_each_row(spark):
    """Rows that repeat a key or have none, under 63, 64 and 65 exceptions."""
    now = F.lit(datetime.datetime(2024, 1, 1))
    rows = [("k", "rule", "/r/a.go", "h1", "secret A", 1), ("k", "rule", "/r/b.go", "h2", "secret B", 2), (None, "rule", "/r/a.go", None, "secret A", 1), ("k", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "finding_id string, headline string, location string, sha256 string, source string, start_line long")
    want = [("/r/a.go", None, "e900"), ("/r/a.go", "h1", "e900"), ("/r/b.go", "h2", "e901"), (None, None, None)]
    for n in (63, 64, 65):
        idle = [exception(i, "globalString", string_match=f"absent {i}") for i in range(n - 2)]
        table = spark.createDataFrame([*idle, exception(900, "globalString", string_match="A"), exception(901, "globalHash", secret_checksum="h2")], EXCEPTION)
        got = [(r.location, r.sha256, r.exception_id) for r in ex.match_exceptions(frame, table, now).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), n


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1é\n 2", max_size=30), min_size=1, max_size=12))
def test_pattern_findings_follow_re(spark, texts):
    """Offsets and places of all matches, with blocks of 3 and of 128 matches."""
    rules = (PatternRule("digits", "[0-9]+", 1), PatternRule("lines", "a\n", 2, "a"))
    want = []
    for i, text in enumerate(texts):
        for r in rules:
            for m in re.finditer(r.pattern, text):
                before = text[: m.start()].encode()
                want.append((i, r.id, r.confidence, m[0], len(before), len(before) + len(m[0].encode()), before.count(b"\n"), len(before) - (before.rfind(b"\n") + 1)))
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, text string")
    for block in (3, 128):
        old, matches.BLOCK = matches.BLOCK, block
        try:
            assert sorted(map(tuple, matches.pattern_findings(frame, rules, ("i",)).collect())) == sorted(want)
        finally:
            matches.BLOCK = old


def test_first_exception_wins_and_reconcile_is_one_way(spark):
    now = F.lit(datetime.datetime(2024, 1, 1))
    table = spark.createDataFrame([exception(9, "global"), exception(2, "globalHash", secret_checksum="h1"), exception(5, "globalString", string_match="secret")], EXCEPTION)
    for literals in (64, 0):
        got = {r.finding_id: r.exception_id for r in ex.match_exceptions(findings_frame(spark), table, now, max_literals=literals).collect()}
        assert got == {"f1": "e2", "f2": "e9"}
    before = findings_frame(spark).withColumns({"suppressed": F.col("finding_id") == "f2", "exception_id": F.when(F.col("finding_id") == "f2", "old")})
    only = spark.createDataFrame([exception(2, "globalHash", secret_checksum="h1")], EXCEPTION)
    assert {r.finding_id: (r.suppressed, r.exception_id) for r in ex.reconcile(before, only, now).collect()} == {"f1": (True, "e2"), "f2": (True, "old")}


def test_exceptions_met_by_keys_equal_the_row_form(spark):
    rng = __import__("random").Random(4)
    paths_ = ["/a/b.java", "/b.java", "b.java", "/a", "/a/", "/x/a/b.java", "", None, "/a/c.java", "c.java"]
    kinds = [*ex.KEYED, "globalString", "globalRegex", "pathRegex", "pathRegexRegex", "project", "odd"]
    rules = [(f"e{i:02d}", rng.randrange(20), rng.choice(["*", "", None, "h1"]), rng.choice(["active"] * 4 + ["revoked"]), None, rng.choice(kinds), rng.choice([*paths_, "("]), rng.choice([1, 2, None]), rng.choice([2, 3]), rng.choice(["s1", "s2", "", None]), rng.choice(["key", "zz", "", None]), rng.choice([None, "k.y", "(", ""])) for i in range(150)]
    rows = [(rng.choice(["h1", "h2", None]), rng.choice(paths_), rng.choice(["s1", "s2", "s3", "", None]), rng.choice(["a key", "none", "", None]), rng.choice([0, 1, 2, None]), i) for i in range(200)]
    frame = spark.createDataFrame([*rows, rows[0]], "headline string, location string, sha256 string, source string, start_line long, n int")
    got = []
    for n in (60, 150):
        table = spark.createDataFrame(rules[:n], EXCEPTION)
        for held in (10_000, 3):
            got.append(sorted((r.n, r.exception_id or "", r.suppressed) for r in ex.match_exceptions(frame, table, F.lit(datetime.datetime(2024, 1, 1)), max_held=held).collect()))
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]
    assert len(got[0]) == 201 and 20 < sum(x[2] for x in got[0])
    plan = ex.match_exceptions(frame, table, F.lit(datetime.datetime(2024, 1, 1)), max_held=3)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*_key#\d+ = _key#\d+", plan) and "Cross" not in plan


@pytest.mark.parametrize("size", [1, 4, 100])
def test_pages_by_cursor_equal_pages_by_offset(spark, size):
    rng = __import__("random").Random(6)
    rows = [(rng.choice([None, "a", "b", "B"]), rng.choice([None, 1, 2, 3]), i) for i in range(23)]
    frame = spark.createDataFrame(rows, "name string, n int, id long").repartition(3)
    order = [F.lower("name"), F.col("n"), F.col("id")]
    after, got = None, []
    for _ in range(-(-23 // size) if size > 1 else 3):
        page = history.seek_page(frame, order, after, size)
        got.append([r.id for r in page.collect()])
        after = history.cursor(page, order)
    want = [[r.id for r in history.page(frame, order, k, size).collect()] for k in range(len(got))]
    assert got == want and history.cursor(frame.limit(0), order) is None


def test_memberships_equal_the_tree_by_pairs(spark):
    rng = __import__("random").Random(8)
    entry = lambda i: (f"n{i}", {k: [rng.choice(["x", "y", "z", "n1", "n2"]) for _ in range(rng.randrange(3))] for k in ("a", "b") if rng.random() < 0.8})
    users, groups = [entry(i) for i in range(12)], [entry(i) for i in range(6)]
    inner = Membership((("b", "b"), ("DN", "a")), all_of=False)
    trees = [Membership((("a", "a"),)), Membership((("a", "dn"), ("b", "b")), all_of=False), Membership((("a", "a"),), rules=(inner,)), Membership(all_of=False), Membership((("dn", "dn"),), all_of=False, rules=(Membership((("a", "b"),), rules=(inner,)),))]
    shape = "dn string, attributes map<string,array<string>>"

    def holds(t, u, g):
        of = lambda e, k: {e[0]} if k.lower() == "dn" else set(e[1].get(k, []))
        return (all if t.all_of else any)([*[bool(of(u, x) & of(g, y)) for x, y in t.constraints], *[holds(r, u, g) for r in t.rules]])

    for tree in trees:
        got = memberships(spark.createDataFrame(users, shape), spark.createDataFrame(groups, shape), tree).collect()
        assert sorted(map(tuple, got)) == sorted((u[0], g[0]) for u in users for g in groups if holds(tree, u, g))
    with pytest.raises(ValueError):
        memberships(spark.createDataFrame(users, shape), spark.createDataFrame(groups, shape), Membership())


def test_policy_and_exception_log(spark):
    p = Exclusions(repositories=("/r/",))
    p = policy.update_policy(p, policy.HERE, "/r/a", "v")
    p = policy.update_policy(policy.update_policy(p, policy.HASH_HERE, "/r/a", checksum="h"), policy.EVERYWHERE, "x", "w")
    p = policy.update_policy(policy.update_policy(p, policy.HASH_EVERYWHERE, "x", checksum="g"), policy.FILE, "/r/a.b")
    assert p.path_values == {"a": ("v",)} and p.path_hashes == {"a": ("h",)} and p.values == ("w",) and p.hashes == ("g",) and p.paths == (r".*a\.b",)
    assert policy.update_policy(p, "odd", "x") == p and policy.policy_from_json(policy.policy_to_json(p)) == p
    log = spark.createDataFrame([("a", 1, "create", "active", datetime.datetime(2020, 1, 1)), ("b", 1, "create", "active", None), ("b", 2, "delete", "active", None), ("c", 1, "create", "active", None), ("c", 2, "update", "revoked", None)], "id string, version int, action string, status string, expires_at timestamp")
    now = F.lit(datetime.datetime(2024, 1, 1))
    assert {r.id: r.status for r in policy.current_exceptions(log, now).collect()} == {"a": "expired", "c": "revoked"}
    assert {r.id for r in policy.current_exceptions(log, now, soft=True).collect()} == {"a", "b", "c"}
    bad = policy.invalid_exceptions(spark.createDataFrame([exception(1, "globalHash"), exception(2, "global"), exception(3, "huh"), exception(4, "file", path="x")], EXCEPTION))
    assert {r.id for r in bad.collect()} == {"e1", "e3"}
    built = ex.exclusions_from_exceptions([{"type": "globalHash", "secret_checksum": "h"}, {"type": "pathString", "path": "p", "string_match": "s"}, {"type": "odd"}])
    assert built.hashes == ("h",) and built.path_values == {"p": ("s",)}


# -- scores ------------------------------------------------------------------------------------------------------------------------

F_SHAPE = "scan int, location string, raw_start long, confidence int, sha256 string, tags array<string>"


def scores(spark, scans, strict=True):
    rows = [(k, f"f{i}", i, c, s, t) for k, found in scans.items() for i, (c, s, t) in enumerate(found)]
    frame = spark.createDataFrame(rows, F_SHAPE)
    files = spark.createDataFrame([(k, 10) for k in scans], "scan int, file_count long")
    done = scoring.score(scoring.model(frame, files, ["scan"], [F.col("location"), F.col("raw_start")], strict), strict)
    return {r.scan: r for r in done.collect()}


def test_scores(spark):
    got = scores(spark, {
        1: [(1, "a", [])],
        2: [(1, "a", []), (1, "b", [])],
        3: [(2, "a", []), (2, "b", [])],
        4: [(3, "a", []), (3, "b", [])],
        5: [(4, "a", []), (4, "b", [])],
        6: [(2, "a", ["test"]), (2, "a", []), (3, "b", [])],
        7: [(4, "a", ["confidential"]), (0, "b", [])],
    })
    assert got[1].metric != got[1].metric and got[1].grade == "F"  # one secret: 0 / 0
    assert got[2].metric > got[3].metric > got[4].metric > got[5].metric and got[5].metric <= 40
    assert got[6].medium_shared == got[6].critical_shared > 0 and got[6].reused_secrets == 1 and got[6].reuse_total == 2
    assert got[7].critical_file_count == 1 and got[7].metric <= 40 and abs(got[2].average_per_file - 0.2) < 1e-6
    loose = scores(spark, {1: [(1, "a", [])], 6: [(2, "a", ["test"]), (2, "a", []), (3, "b", [])]}, strict=False)
    assert loose[1].metric == 98.0 and loose[6].medium_shared == 1 and loose[6].critical_shared == 0


def test_worse_findings_never_raise_the_score(spark):
    base = [(1, "a", []), (2, "b", []), (1, "c", ["test"])]
    scans = {0: base}
    for i, extra in enumerate([(2, "d", []), (3, "d", []), (4, "d", []), (3, "d", ["confidential"])], 1):
        scans[i] = [*base, extra]
    got = scores(spark, scans)
    assert got[1].metric >= got[2].metric >= got[3].metric and got[2].metric >= got[4].metric


# -- history -----------------------------------------------------------------------------------------------------------------------


def test_history(spark):
    commits = spark.createDataFrame([("r", "m", "h1", 1, False), ("r", "m", "h2", 2, True), ("r", "d", "x", 1, True), ("r", "m", "h0", 0, False)], "repository string, branch string, hash string, time int, is_head boolean")
    scanned = spark.createDataFrame([("r", "m", "h2", 2)], "repository string, branch string, hash string, time int")
    assert history.commits_to_scan(commits, scanned).count() == 0
    assert [r.hash for r in history.commits_to_scan(commits, scanned, older=True).collect()] == ["h1"]
    assert {r.hash for r in history.commits_since(commits, scanned).collect()} == {"x"}
    rows = spark.createDataFrame([(i, i % 3, ["test"] if i % 2 else []) for i in range(30)], "i int, confidence int, tags array<string>")
    assert [r.i for r in history.page(rows, [F.col("i")], 1, 500, first=1).collect()] == list(range(30))
    assert [r.i for r in history.legacy_page(rows, [F.col("i")], 1, 3, [0], ["prod"]).collect()] == [6, 12, 18]
    stored = spark.createDataFrame([("a", 1)], "finding_id string, scan_id int")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "finding_id string, scan_id int")
    assert history.insert_new(stored, new).count() == 1 and history.insert_new(None, new).count() == 2
    entries = spark.createDataFrame([("u1", {"g": ["a", "b"], "o": ["x"]}), ("u2", {"g": ["c"]}), ("u3", {})], "dn string, attributes map<string,array<string>>")
    assert {r.dn for r in history.members(entries, {"g": ["b", "c"]}).collect()} == {"u1", "u2"}
    assert {r.dn for r in history.members(entries, {"g": ["b", "c"], "o": ["x"]}, any_of=False).collect()} == {"u1"}


def test_triage_and_transformers(spark):
    rows = spark.createDataFrame([("f1", "abcdefghijklmnop"), ("f2", "bad")], "finding_id string, value string")
    shown = {r.finding_id: r for r in triage.triage_input(rows, "http://localhost:1", allow_raw=True).collect()}
    assert shown["f1"].shown == "abcdefghijklmnop" and triage.triage_input(rows, "https://far.example", allow_raw=True).first().prompt_mode == "REDACTED"

    def ask(row):
        if row["value"] == "bad":
            raise OSError("no answer")
        return {"promptTokens": 3}

    notes = rows.join(triage.triage(rows, ask, ["value"]), "finding_id")
    assert {r.finding_id: r.ai_annotation for r in notes.collect()} == {"f1": '{"promptTokens": 3}', "f2": None}
    assert scoring.token_usage(notes, []).first().tokens == 3 and triage.unannotated(notes).count() == 1
    assert triage.transform_report(rows, lambda f: f[f["value"] == "bad"]).count() == 1
    assert triage.transform_report(rows, lambda f: 1 / 0).count() == 2


def test_shared_counts_of_a_secret_over_many_parts(spark):
    import random

    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice(["hot"] * 6 + ["x", "y", "z", None]), rng.choice([0, 1, 2, 3, 4, None]), ["test"] if rng.random() < q else [], i)
        for q in (0.0, 0.02, 0.5)
        for i in rng.sample(range(5000), 400)
    ]
    rows = list({(r[0], r[1], r[4]): r for r in rows}.values())
    frame = spark.createDataFrame(rows, "scan string, sha256 string, confidence int, tags array<string>, at int")
    want = {}
    for key in {(r[0], r[1]) for r in rows if r[1]}:
        test = production = False
        counts = dict.fromkeys(scoring.NAMES, 0)
        for _, _, level, tags, _ in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: -r[4]):
            test, production = test or bool(tags), production or not tags
            for k in counts:
                counts[k] += not tags and level == (scoring.MEDIUM if k == scoring.CRITICAL else k)
            if test and production:
                total = want.setdefault(key[0], dict.fromkeys(scoring.NAMES.values(), 0))
                for k, n in scoring.NAMES.items():
                    total[n] += counts[k]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = scoring.shared_counts(frame.repartition(3), ["scan"], [F.col("at").desc()]).collect()
    finally:
        spark.conf.unset(coalesce)
    assert {r.scan: {n: r[f"{n}_shared"] for n in scoring.NAMES.values()} for r in got} == want
