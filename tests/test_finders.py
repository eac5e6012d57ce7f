import random
import re

import pytest
import rowforms
from hypothesis import given, settings
from hypothesis import strategies as st

from leakwise.operators import overlap, prefilter
from leakwise.operators.finders import COLUMNS, Exclusions, Finder, FinderOptions, Text, class_of, find_secrets
from leakwise.rules import patterns as p
from leakwise.schema import CRITICAL, HIGH, INFO, MEDIUM
from rowforms import classify, connection_name, trim_quotes

GH = "ghp_" + "Ab1" * 12
HEX = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
#: (path, text) -> expected (provider, headline confidence, source part); our own values.
CASES = {
    ("a/Main.kt", 'val apiKey: String = "QWxhZGRpbjpvcGVuIHNlc2FtZQ9x"\n'): [("SecretAssignment", HIGH)],
    ("a/x.hpp", f'static const char* my_salt = "{HEX}";\n'): [("CPPSecretAssignment", HIGH)],
    ("a/x.cpp", f'#define API_KEY "{HEX}"\n'): [("DefineSecretAssignment", HIGH)],
    ("a/s.yaml", "app:\n  client_secret: 'pypi-AbCdEfGhIjKlMnOpQrStUvWxYz'\n"): [("YAMLSecretAssignment", HIGH)],
    ("a/p.json", '{\n "authKey": "Xy12345678zz~Q",\n "n": 1\n}\n'): [],
    ("a/d.conf", 'secret "abcdef12abcdefgh"\n'): [("ConfSecretAssignment", MEDIUM)],
    ("a/u.conf", "url mysql://bob:pa55@db.example:3306/x\n"): [(p.CONNECTION, HIGH)],
    ("a/r.rb", f'T = {{ :k => "{HEX}" }}\n'): [("SuspiciousOrCommonSecretString", HIGH)],
    ("a/G.java", f'String x = "{GH}";\n'): [("SuspiciousOrCommonSecretString", CRITICAL)],
    ("a/q.xml", f'<c><p secretKey="Zx9aQ1wE2r"/><token>{HEX}</token></c>\n'): [("AttributeSecretAssignment", HIGH), ("ElementSecretAssignment", HIGH)],
    ("a/n.java", 'String name = "hello";\n'): [],
    ("a/w.java", 'String key = "two words";\n'): [],
    # the name pattern swallows line breaks up to the last assignment, so the variable has white space and is dropped
    ("a/swallow.java", 'String authA = "Abc123xyz";\nString b = "plain";\n'): [],
}


def scan(path, text, **options):
    return rowforms.scan(text, class_of(re.search(r"(\.[^./]*)?$", path)[0]), **options)


@pytest.mark.parametrize("path,text", CASES)
def test_finders_by_class(path, text):
    got = [(r["provider_id"], r["confidence"]) for r in scan(path, text)]
    if path == "a/p.json":
        assert got == [("JSONSecretAssignment", HIGH)] or got == [("YAMLSecretAssignment", HIGH)]
    else:
        assert got == CASES[path, text]


def test_offsets_are_utf8_bytes():
    text = 'é\nString päss = 1;\nString apiToken = "Zx9aQ1wE2rT5";\n'
    (r,) = scan("a/A.java", text)
    raw = text.encode()
    assert raw[r["raw_start"] : r["raw_end"]].decode() == 'apiToken = "Zx9aQ1wE2rT5"'
    assert (r["start_line"], r["start_char"]) == (2, 7) and r["value"] == "Zx9aQ1wE2rT5"
    assert r["source"] == ' apiToken = "Zx9aQ1wE2rT5"' and r["highlight_end_char"] - r["highlight_start_char"] == len(r["value"])


@settings(deadline=None)
@given(st.text(alphabet="a\né中😀b", max_size=60), st.data())
def test_positions_against_a_linear_scan(text, data):
    raw = text.encode()
    at = data.draw(st.integers(0, len(raw)))
    before = raw[:at]
    assert Text(text).position(at) == (before.count(b"\n"), at - (before.rfind(b"\n") + 1))


PIECES = ["secret", "key", ' = "', '"', "token: ", "\n", "pass", "word", GH, "glpat-" + "a1B-" * 6, HEX, "://", "postgres://u:p@h", " => ", "'", "<a k='", "/>", "x", " ", "AUTH", "ſecret", "Kelvin", "1234567"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25), st.sampled_from(sorted(p.CLASSES)))
def test_the_prefilter_changes_nothing(parts, kind):
    text = "".join(parts)
    scans = [list(Finder(FinderOptions(prefilter=on)).matches(text, kind)) for on in (True, False)]
    assert scans[0] == scans[1]


@pytest.mark.parametrize(
    "pattern,want",
    [("abcd", {"abcd"}), ("(?:abcd|efgh)x", {"abcdx", "efghx"}), ("(?:abcd)?y", set()), ("(?:abcd)*", set()), ("(?:abcd)+z", {"abcd"}), ("[ab]cdx", {"acdx", "bcdx"}), ("ab.cd", set()), ("ABCd", {"abcd"}), ("x|abcd", set())],
)
def test_required_literals(pattern, want):
    assert prefilter.required_literals(pattern) == want


@given(st.lists(st.sampled_from([*PIECES, "abcd", "efgh"]), max_size=12).map("".join))
def test_one_pass_equals_seed_by_seed(text):
    patterns = ["abcd", "(?:abcd|efgh)x", "x*", *(r.pattern for r in p.vendor_rules())]
    filters = [prefilter.RuleFilter(patterns), prefilter.RuleFilter(patterns)]
    filters[1].automaton = None
    low = prefilter.folded(text)
    want = [i for i, x in enumerate(patterns) if prefilter.may_match(x, low)]
    assert filters[0].candidates(low) == filters[1].candidates(low) == want


def test_most_rules_can_be_filtered():
    rules = p.vendor_rules()
    assert sum(bool(prefilter.required_literals(r.pattern)) for r in rules) >= 0.75 * len(rules)


def test_rule_files(tmp_path):
    (tmp_path / "r.toml").write_text(
        '[[rules]]\nid="a"\ndescription="One"\nregex=\'\'\'(?i)zz-([[:alnum:]]{4})\'\'\'\n[[rules]]\nid="b"\ndescription="One"\nregex=\'\'\'zz-([a-z]{5})\'\'\'\n[[rules]]\nid="c"\ndescription="Bad"\nregex=\'\'\'(\'\'\'\n[[rules]]\nid="d"\ndescription="None"\n'
    )
    found = p.load_rule_file(tmp_path / "r.toml")
    assert found == {"One": "zz-([a-z]{5})"}
    rules = p.vendor_rules(found | {p.GITHUB: "never"})
    assert [r.id for r in rules] == sorted(r.id for r in rules) and next(r for r in rules if r.id == p.GITHUB).pattern == p.VENDOR[p.GITHUB]
    assert [r["provider_id"] for r in scan("x.txt", "zz-abcde", rules=rules)] == ["One"]
    assert not next(r for r in rules if r.id == p.STRIPE).emits


def test_classification_order():
    rules = p.vendor_rules()
    assert classify(GH, rules) == (p.GITHUB, CRITICAL)
    assert classify("postgresql://a:b@c", rules) == ("Postgres Database Connection URI Secret", HIGH)
    assert classify("xxPassword1xx", rules) == (p.COMMON_CREDENTIAL, MEDIUM)
    assert classify("aB3aB3aB3", rules) == (p.HIGH_ENTROPY, MEDIUM)
    assert classify(HEX, rules) == (p.ENCODED, HIGH)
    assert classify("rabbit2rabbit2", rules) == (p.SUSPICIOUS, INFO)
    assert classify("two words", rules) == classify("12345", rules) == classify("", rules) == (p.NOT_SECRET, HIGH)
    assert connection_name("postgres://") == "Postgres Database Connection URI Secret"


def test_passphrase_and_exclusions():
    text = 'String passphraseKey = "hello";\n'
    assert [r["confidence"] for r in scan("a.java", text)] == [HIGH]
    keyed = f'String apiKey = "{HEX}";\n'
    assert scan("a.java", keyed, exclusions=Exclusions(value_patterns=("apiKey", "("))) != scan("a.java", keyed)
    assert all(r["excluded"] for r in scan("a.java", keyed, exclusions=Exclusions(values=(HEX,))))
    (r,) = scan("a.java", keyed)
    assert scan("a.java", keyed, exclusions=Exclusions(hashes=(r["sha256"],))) == []


def test_long_runs_stay_fast():
    import time

    began = time.time()
    scan("a.java", "A" * 50_000 + "key" + "b" * 50_000)
    scan("a.json", '{"blob": "' + "Zx9" * 20_000 + '"}')
    assert time.time() - began < 20


@pytest.mark.parametrize("text,want", [('  "a" ', ("a", 1)), ("`'\"x\"'`", ("x", 3)), ('"""x"""', ("x", 3)), ('"', ('"', 0)), ("", ("", 0)), ("'a\"", ("'a\"", 0))])
def test_trim_quotes(text, want):
    assert trim_quotes(text) == want


def test_find_secrets_frame_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i % 2, path, text) for i, (path, text) in enumerate(CASES)] + [(0, "n.java", None), (0, "e.java", "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "repo_index int, path string, text string")
    scans = [sorted(map(str, find_secrets(frame.repartition(n)).collect())) for n in (1, 5)]
    assert scans[0] == scans[1] and len(scans[0]) >= 11


SLOW = re.compile(f"{p.QUOTE}{p.NOT_QUOTE}(?i:{p.INDICATORS}){p.NOT_QUOTE}{p.QUOTE}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', "'", "`", "a", "1bcdefghi", "=", "admin", HEX, "Zx9+/", " ", "12345678"]), max_size=20).map("".join))
def test_linear_forms_equal_the_patterns(text):
    assert list(p.quoted_indicators(text)) == [m.span() for m in SLOW.finditer(text)]
    assert p.has_base64(text) == bool(re.search(p.BASE64, text))


def text_files():
    """Texts of each class: the cases, random pieces, other scripts, excluded and hashed values."""
    rng = random.Random(11)
    kinds = sorted(p.CLASSES)
    extra = ["é", "中", "😀", "Zx9aQ1wE2rT5", "password1", "passphrase = 'x y'", "'" * 3, '"' * 6, "12345678", " ", "QWxhZGRpbjpvcGVuIHNlc2FtZQ9x==", '<b k="', "</a>", "live_" + "x9" * 12]
    texts = [("default", t) for _, t in CASES] + [(class_of(re.search(r"(\.[^./]*)?$", a)[0]), t) for a, t in CASES]
    return texts + [(rng.choice(kinds), "".join(rng.choice([*PIECES, *extra]) for _ in range(rng.randrange(1, 30)))) for _ in range(400)]


@pytest.mark.parametrize("options", [{}, {"fused": False, "show_source": False}, {"checksum": False, "exclusions": Exclusions(values=("admin", HEX), value_patterns=("glpat", "("))}])
def test_columns_equal_the_row_forms(spark, options):
    texts = text_files()
    frame = spark.createDataFrame([(i % 3, f"/f{i}", k, t) for i, (k, t) in enumerate(texts)], "repo_index int, path string, kind string, text string").repartition(4)
    got = {}
    for r in find_secrets(frame, FinderOptions(**options), file_class="kind").collect():
        got.setdefault(r.location, []).append(r.asDict(recursive=True))
    order = lambda r: (rowforms.order_in_file(r), str(r))
    assert sum(map(len, got.values())) > 300
    for i, (kind, text) in enumerate(texts):
        want = rowforms.scan(text, kind, **options)
        mine = [{k: r[k] for k in want[0]} for r in got.get(f"/f{i}", [])] if want else got.get(f"/f{i}", [])
        assert sorted(mine, key=order) == sorted(want, key=order), (kind, text)


def test_operators_give_what_the_scan_gives(spark):
    texts = text_files()
    frame = spark.createDataFrame([(i % 3, f"/f{i}", k, t) for i, (k, t) in enumerate(texts)], "repo_index int, path string, kind string, text string")
    file = ["repo_index", "location"]
    apart = find_secrets(frame.repartition(3), FinderOptions(fused=False), file_class="kind")
    by_operators = overlap.subsume(overlap.remove_overlapping(apart, file), file).select(*COLUMNS)
    assert sorted(map(str, by_operators.collect())) == sorted(map(str, find_secrets(frame, file_class="kind").collect()))


def test_extra_columns_go_along(spark):
    frame = spark.createDataFrame([(0, "a.java", f'String apiKey = "{HEX}";', 7, "x"), (0, "b.java", None, 8, "y")], "repo_index int, path string, text string, piece long, note string")
    assert [(r.piece, r.note) for r in find_secrets(frame, keep=("piece", "note")).collect()] == [(7, "x")]


def test_the_fixed_corpus(spark):
    """The expected rows as they stand, for the files as they stand."""
    from pyspark.sql import functions as F

    from leakwise import corpus
    from leakwise.plans.scan import scan_files

    rows = spark.createDataFrame(list(corpus.FILES), "repo_index int, path string, text string")
    found = scan_files(rows.withColumns({"content": F.encode("text", "utf-8"), "size": F.octet_length("text").cast("long")}))
    names = ("repo_index", "location", "provider_id", "headline", "confidence", "value", "start_line", "start_char", "raw_start", "raw_end")
    got = [(*(r[n] for n in names), " ".join(r.tags)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(corpus.FINDINGS, key=str)
