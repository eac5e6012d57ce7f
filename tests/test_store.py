import datetime

import pytest
from pyspark.sql import functions as F

from leakwise.operators import store
from leakwise.schema import EXCEPTION

T = datetime.datetime
SHAPE = "finding_id string, headline string, location string, sha256 string, source string, start_line long, confidence int, tags array<string>, suppressed boolean, exception_id string"


def findings(spark):
    rows = [("f1", "a", "/x/a", "h1", "s", 0, 4, [], False, None), ("f2", "b", "/x/b", "h2", "s", 0, 1, ["test"], False, None)]
    return spark.createDataFrame(rows, SHAPE)


def test_upsert_and_cascade(spark):
    table = spark.createDataFrame([("p1", 1), ("p2", 2)], "project_id string, n int")
    new = spark.createDataFrame([("p2", 5), ("p3", 6), ("p3", 6)], "project_id string, n int")
    assert sorted(tuple(r) for r in store.upsert(table, new, ["project_id"]).collect()) == [("p1", 1), ("p2", 5), ("p3", 6)]
    left = store.delete_projects({"projects": table, "other": spark.range(2)}, new)
    assert [r.project_id for r in left["projects"].collect()] == ["p1"] and left["other"].count() == 2
    a, b = store.delete_scans(table, table, "p1")
    assert a.count() == b.count() == 1


def test_summaries_and_lists(spark):
    projects = spark.createDataFrame([("p1", "w", "b"), ("p2", "w", "a"), ("p3", "v", "c")], "project_id string, workspace string, name string")
    rows = [("s1", "p1", "completed", T(2024, 1, 1), T(2024, 1, 2), 1.0), ("s2", "p1", "failed", T(2024, 2, 1), None, None), ("s3", "p2", "completed", T(2024, 1, 3), T(2024, 1, 4), 2.0)]
    scans = spark.createDataFrame(rows, "scan_id string, project_id string, status string, started_at timestamp, completed_at timestamp, score double")
    assert [(r.name, r.scan_id) for r in store.project_summaries(projects, scans).collect()] == [("c", None), ("a", "s3"), ("b", "s1")]
    assert [r.name for r in store.project_summaries(projects, scans, legacy=True).collect()] == ["a", "b", "c"]
    assert [r.scan_id for r in store.list_scans(scans, "p1").collect()] == ["s2", "s1"] and store.list_scans(scans, "p1", 1, 1).first().scan_id == "s1"


def test_scan_life(spark, tmp_path):
    def save(rows):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/f")
        return spark.read.parquet(f"{tmp_path}/f")

    base = dict.fromkeys([c.split()[0] for c in EXCEPTION.split(", ")])
    late = spark.createDataFrame([tuple((base | {"id": "e", "ord": 1, "type": "globalHash", "status": "active", "rule_id": "*", "secret_checksum": "h1"}).values())], EXCEPTION)
    final, record = store.run_scan("s", "p", lambda: findings(spark), save, lambda: late, F.lit(T(2024, 1, 1)))
    assert {r.finding_id: r.suppressed for r in final.collect()} == {"f1": True, "f2": False}
    assert record["status"] == store.COMPLETED and record["finding_count"] == 2 and record["severity"]["Critical"] == 1 and record["score"] == pytest.approx(5.5)
    none, record = store.run_scan("s", "p", lambda: 1 / 0, save, lambda: late, F.lit(T(2024, 1, 1)))
    assert none is None and record["status"] == store.FAILED and "zero" in record["error"]
    empty, record = store.run_scan("s", "p", lambda: findings(spark).limit(0), save, lambda: late, F.lit(T(2024, 1, 1)))
    assert empty.count() == 0 and record["finding_count"] == 0


def test_rows_notes_and_times(spark):
    rows = findings(spark).withColumns({"scan_id": F.lit("s1"), "ai_annotation": F.lit(None).cast("string")})
    both = rows.unionByName(rows.withColumn("scan_id", F.lit("s2")))
    assert store.finding_row(both, "f1").first().scan_id == "s2" and store.finding_row(both, "f1").first().severity == "Critical"
    notes = spark.createDataFrame([("f2", "n")], "finding_id string, ai_annotation string")
    assert {r.finding_id: r.ai_annotation for r in store.annotate(rows, notes).collect()} == {"f1": None, "f2": "n"}
    at = spark.createDataFrame([(T(2024, 3, 5, 6, 7, 8),)], "t timestamp").select(store.http_time(F.col("t")).alias("h"), store.iso_time(F.col("t")).alias("i")).first()
    assert at.h == "Tue, 05 Mar 2024 06:07:08 UTC" and at.i == "2024-03-05T06:07:08Z"
    meet = spark.range(1).select(store.intersection(F.lit(1), F.lit(5), F.lit(3), F.lit(9)).alias("a"), store.intersection(F.lit(1), F.lit(2), F.lit(3), F.lit(9)).alias("b")).first()
    assert (meet.a.start, meet.a.end, meet.b) == (3, 5, None)
