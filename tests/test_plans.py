import hashlib
import json
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakwise.functions.text import redacted
from leakwise.operators.finders import Exclusions
from leakwise.plans import scan as plan
from leakwise.schema import EXCEPTION, FINDING
from leakwise.sinks import reports
from leakwise.sources import files as sf
from leakwise.sources import tables
from leakwise.streaming import scan as stream

HEX = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"


@pytest.fixture(scope="module")
def corpus():
    import tempfile

    root = Path(tempfile.mkdtemp(prefix="corpus-", dir="/tmp"))  # its path must not hold the word that marks test files
    texts = {
        "one/src/A.java": f'class A {{\n String apiKey = "{HEX}";\n}}\n',
        "one/tests/B.java": f'class B {{\n String apiKey = "{HEX}";\n}}\n',
        "one/node_modules/c.js": f'var apiKey = "{HEX}"\n',
        "one/certs/k.pem": "-----BEGIN EC PRIVATE KEY-----\nabc\n",
        "one/x.xyz": f'secret = "{HEX}"\n',
        "one/run": f'TOKEN="{HEX}"\n',
        "two/values.yaml": f"secret: {HEX}\n",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    yield root
    import shutil

    shutil.rmtree(root)


def roots(corpus):
    return [f"{corpus}/one", f"{corpus}/two", f"{corpus}/one"]


def test_scan_of_roots(spark, corpus):
    got = plan.scan_paths(spark, roots(corpus), order=True).collect()
    assert [(r.location.removeprefix(str(corpus)), r.repo_index, r.provider_id, r.tags) for r in got] == [
        ("/one/certs/k.pem", 0, "ConfidentialFiles", ["confidential"]),
        ("/one/node_modules/c.js", 0, "SecretAssignment", []),
        ("/one/src/A.java", 0, "SecretAssignment", []),
        ("/one/tests/B.java", 0, "SecretAssignment", ["test"]),
        ("/two/values.yaml", 1, "YAMLSecretAssignment", []),
    ]
    assert all(r.finding_id and r.secret_type for r in got)
    options = plan.ScanOptions(exclude_tests=True, prune=("node_modules",), exclusions=Exclusions(paths=("two/",)), report_ignored=True)
    found = plan.scan_paths(spark, roots(corpus), options).collect()
    assert {r.location.removeprefix(str(corpus)) for r in found if r.provider_id != "PathBasedSecretsFinder"} == {"/one/certs/k.pem", "/one/src/A.java"}
    ignored = {r.location.removeprefix(str(corpus)): r.headline for r in found if r.provider_id == "PathBasedSecretsFinder"}
    assert ignored["/one/x.xyz"] == "Skipped: File extension .xyz is ignored" and "/one/run" not in ignored and "/two/values.yaml" in ignored
    only = plan.scan_paths(spark, roots(corpus), plan.ScanOptions(confidential_only=True)).collect()
    assert [r.provider_id for r in only] == ["ConfidentialFiles"]


def test_no_content_is_shuffled(spark, corpus):
    def nodes(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"(?m)^[\s:+*()\d-]*(\w+)", text)  # the operators from the top, not the words of their tables

    of_table = nodes(plan.scan_files(spark.createDataFrame([(0, "a.java", 1, "x")], "repo_index int, path string, size long, text string")))
    assert "Exchange" not in " ".join(of_table) and of_table.count("MapInArrow") == 2  # matches, and what settles them
    of_paths = nodes(plan.scan_paths(spark, roots(corpus)))
    texts = of_paths[: of_paths.index("Exchange")]  # down to where paths are dealt to the tasks that fetch
    assert texts.count("MapInArrow") == 3 and "FileScan" not in texts


def test_locations_and_tags_of_repositories(spark, corpus):
    found = plan.scan_paths(spark, roots(corpus))
    table = spark.createDataFrame([(0, f"{corpus}/one", "https://h/o/one.git", "main", {"team": "x"})], "repo_index int, checkout string, repo_url string, branch string, attributes map<string,string>")
    got = plan.with_roots(found, table).collect()
    assert any(r.location == "https://h/o/one.git/src/A.java" and r.tags == ["branch=main", "team=x"] for r in got)
    assert any(r.location.endswith("two/values.yaml") and r.tags == [] for r in got)


def test_strings_and_repositories(spark):
    rows = spark.createDataFrame([("c2VjcmV0OiAi" , ".yaml", True), (f'apiKey = "{HEX}"', ".java", False), ("%%%", ".java", True)], "source string, source_type string, base64 boolean")
    got = plan.scan_strings(tables.string_requests(rows)).collect()
    assert [(r.provider_id, r.sha256) for r in got] == [("SecretAssignment", None)]
    registry = spark.createDataFrame([("git@h:o/a.git", 0), ("https://h/o/b.git", 1), (" git@h:o/a.git", 2)], "address string, position int")
    assert [(r.repo_index, r.checkout) for r in tables.repositories(registry, "/w").orderBy("repo_index").collect()] == [(0, "/w/a"), (1, "/w/b")]


def test_bytes_that_are_no_text(spark, tmp_path_factory):
    import tempfile

    with tempfile.TemporaryDirectory(prefix="bytes-", dir="/tmp") as root:
        Path(f"{root}/a.java").write_bytes(b'\xff\xfe String apiKey = "' + HEX.encode() + b'";\n')
        (r,) = plan.scan_paths(spark, [root]).collect()
        assert r.value == HEX and r.provider_id == "SecretAssignment"
    rows = spark.createDataFrame([("/////w==", ".java", True)], "source string, source_type string, base64 boolean")
    assert plan.scan_strings(tables.string_requests(rows)).count() == 0


def test_paged_source(spark):
    def fetch(cursor):
        at = int(cursor or 0)
        return [(f"n{at}", f"git@h:o/n{at}.git")], str(at + 1) if at < 2 else None

    assert [r.name for r in tables.paged_source(spark, fetch).collect()] == ["n0", "n1", "n2"]


def test_result_files(spark, corpus, tmp_path):
    found = plan.scan_paths(spark, roots(corpus)).drop("finding_id", "secret_type")
    reports.write_results(found, f"{tmp_path}/lines")
    body = "".join(p.read_text() for p in Path(f"{tmp_path}/lines").glob("part-*"))
    assert HEX not in body
    Path(f"{tmp_path}/cut.json").write_text(body + '{"location": "trunc')
    Path(f"{tmp_path}/array.json").write_text("[" + ",".join(body.splitlines()) + "]")
    shape = FINDING.replace("value string, ", "")
    for name in ("cut.json", "array.json"):
        got = tables.read_results(spark, f"{tmp_path}/{name}", shape).collect()
        assert [r.location for r in got] == sorted(r.location for r in found.collect())
    Path(f"{tmp_path}/empty.json").write_text("")
    assert tables.read_results(spark, f"{tmp_path}/empty.json").count() == 0


def test_reports(spark, corpus, tmp_path):
    found = plan.scan_paths(spark, roots(corpus)).withColumn("tags", F.concat("tags", F.array(F.lit("team=x"))))
    twice = found.unionByName(found)
    reports.write_sarif(twice, f"{tmp_path}/sarif")
    reports.join_parts(spark, f"{tmp_path}/sarif", f"{tmp_path}/all.sarif")
    doc = json.loads(Path(f"{tmp_path}/all.sarif").read_text())
    assert Path(f"{tmp_path}/all.sarif").read_text() == "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/sarif").glob("part-*")))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == twice.count()
    assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
    assert all(x["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for x in run["results"])
    reports.write_sarif(found.limit(0), f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted(Path(f"{tmp_path}/none").glob("part-*"))))["runs"][0]["results"] == []
    reports.write_csv(found, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert tuple(back.columns) == (*reports.CSV_COLUMNS, "team") and back.count() == found.count() and {r.team for r in back.collect()} == {"x"}
    assert reports.report_rows(found).first().severity == "Critical"
    assert {r.severity for r in reports.editor_diagnostics(found).collect()} == {1, 4}
    assert found.where("value is not null").select(redacted(F.col("value")).alias("v")).where(F.col("v").contains(HEX)).count() == 0


def test_webhook():
    waits, tries = [], []

    def post(body, headers):
        tries.append(headers["X-Signature-256"])
        if len(tries) < 3:
            raise OSError("down")
        return 204

    assert reports.deliver(b"{}", "k", post, sleep=waits.append) == 3 and waits == [2.0, 4.0] and len(set(tries)) == 1
    assert reports.deliver(b"{}", "k", lambda *_: 500, sleep=lambda _: None) == -5


def test_streaming_equals_batch_and_replays_add_nothing(spark, corpus, tmp_path):
    files = sf.with_text(sf.stream_roots(spark, f"{corpus}/one", per_trigger=2))
    out = f"{tmp_path}/findings"
    for run in ("a", "b"):  # a second run with a new checkpoint sees all files again
        q = stream.write_findings(stream.scan_stream(files, "s1"), out, f"{tmp_path}/cp-{run}", interval=None)
        q.awaitTermination(120)
        assert q.exception() is None
    got = stream.read_findings(spark, out)
    batch = plan.scan_paths(spark, [f"{corpus}/one"])
    assert sorted(r.finding_id for r in got.collect()) == sorted(r.finding_id for r in batch.collect())


def test_streams_of_clean_files_and_restarts(spark, tmp_path):
    import tempfile

    with tempfile.TemporaryDirectory(prefix="stream-", dir="/tmp") as root:
        out, checkpoint = f"{tmp_path}/findings", f"{tmp_path}/cp"

        def run(**more):
            files = sf.with_text(sf.stream_roots(spark, root, per_trigger=1))
            q = stream.write_findings(stream.scan_stream(files, "s1"), out, checkpoint, interval=None, **more)
            q.awaitTermination(120)
            assert q.exception() is None

        for i in range(2):  # the first micro-batches have no findings
            Path(f"{root}/clean{i}.java").write_text("class A {}\n")
        run()
        Path(f"{root}/a.java").write_text(f'String apiKey = "{HEX}";\n')
        run()  # a restart from the same checkpoint
        shape = "finding_id string, scan_id string, value string, suppressed boolean"
        assert [r.value for r in spark.read.schema(shape).parquet(out).collect()] == [HEX]
        Path(f"{root}/b.java").write_text(f'String apiKey = "{HEX}";\n')
        exceptions = [("x", 1, "*", "active", None, "globalHash", None, None, None, hashlib.sha256(HEX.encode()).hexdigest(), None, None)]
        run(exceptions=lambda: spark.createDataFrame(exceptions, EXCEPTION))
        assert sorted(r.suppressed or False for r in spark.read.schema(shape).parquet(out).collect()) == [False, True]


def test_only_small_tables_are_spread(spark, monkeypatch):
    one = spark.range(1000).coalesce(1)
    assert sf.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sf, "SPREAD_BYTES", 10)
    assert sf.spread(one).rdd.getNumPartitions() == 1


def test_progress_and_rates(spark):
    rows = [("s", i * 100, min(i, 5), 4, f"f{i}") for i in range(8)]
    events = spark.createDataFrame(rows, "scan_id string, ms long, position int, total int, current_file string").withColumn("at", F.timestamp_millis("ms"))
    got = stream.progress(events).orderBy("since").collect()
    assert [r.position for r in got] == [2, 4, 4] and all(r.position <= r.total for r in got) and got[-1].current_file == "f7"


def test_each_query_has_stable_columns(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from leakwise import queries as q

    assert set(q.oracle_sql()) <= set(q.queries()) and len(q.queries()) >= 45
