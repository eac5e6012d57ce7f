"""Stored projects, scans and findings: latest-version views over append-only tables, and the life of a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.operators import scoring
from leakwise.operators.exclusions import reconcile
from leakwise.operators.history import latest_by
from leakwise.schema import confidence_name

PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
SCAN = "scan_id string, project_id string, status string, started_at timestamp, completed_at timestamp, finding_count long, critical long, high long, medium long, low long, info long, score double, error string"


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` replace those of equal key; a key given twice keeps one of its rows."""
    fresh = rows.dropDuplicates(key)
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the projects in ``gone`` (project_id): a cascading delete."""
    ids = gone.select("project_id").distinct()
    return {name: t.join(ids, "project_id", "left_anti") if "project_id" in t.columns else t for name, t in tables.items()}


def delete_scans(scans: DataFrame, findings: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Scans and findings without those of a project."""
    keep = F.col("project_id") != project_id
    return scans.where(keep), findings.where(keep)


def project_summaries(projects: DataFrame, scans: DataFrame, legacy: bool = False) -> DataFrame:
    """Projects with their last completed scan, by workspace and name, or by last scan, newest first (``legacy``)."""
    done = scans.where(F.col("status") == COMPLETED)
    last = latest_by(done, ["project_id"], [F.col("completed_at").desc(), F.col("scan_id").desc()])
    joined = projects.join(last.select("project_id", "scan_id", F.col("completed_at").alias("last_scan"), "score"), "project_id", "left")
    return joined.orderBy(F.col("last_scan").desc_nulls_last(), "name") if legacy else joined.orderBy("workspace", "name")


def list_scans(scans: DataFrame, project_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A project's scans, newest first."""
    return scans.where(F.col("project_id") == project_id).orderBy(F.col("started_at").desc(), "scan_id").offset(offset).limit(limit)


def scan_metrics(findings: DataFrame) -> DataFrame:
    """Counts, severity map and score per scan."""
    counts = scoring.severity_counts(findings, ["scan_id"])
    cells = [F.lit(x) if isinstance(x, str) else x for n in ("critical", "high", "medium", "low", "info") for x in (n.capitalize(), F.col(f"{n}_count"))]
    score = scoring.store_score(F.col("critical_count"), F.col("high_count"), F.col("medium_count"), F.col("low_count"), F.col("issues"))
    return counts.select("scan_id", F.col("issues").alias("finding_count"), F.create_map(*cells).alias("severity"), score.alias("score"))


def finding_row(findings: DataFrame, finding_id: str) -> DataFrame:
    """One finding with the name of its severity: its latest scan's row."""
    own = findings.where(F.col("finding_id") == finding_id)
    return latest_by(own, ["finding_id"], [F.col("scan_id").desc()]).withColumn("severity", confidence_name("confidence"))


def annotate(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings with the annotations in ``notes`` (finding_id, ai_annotation) in place of their own."""
    new = notes.dropDuplicates(["finding_id"]).select("finding_id", F.col("ai_annotation").alias("_new"))
    return findings.join(new, "finding_id", "left").withColumn("ai_annotation", F.coalesce("_new", "ai_annotation")).drop("_new")


def run_scan(scan_id: str, project_id: str, find: Callable[[], DataFrame], save: Callable[[DataFrame], DataFrame], exceptions: Callable[[], DataFrame], now: Column) -> tuple[DataFrame | None, dict]:
    """The life of a scan: find, save, read back, reconcile with the exceptions of now, score.

    Returns the reconciled findings and the scan's record; a failure gives a failed record with its message. ``save``
    writes the findings and returns them as they are stored, so the later steps don't scan again.
    """
    try:
        stored = save(find().withColumns({"scan_id": F.lit(scan_id), "project_id": F.lit(project_id)}))
        final = reconcile(stored, exceptions(), now)
        row = scan_metrics(final).first()
        counted = row.asDict() if row else {"finding_count": 0, "severity": {}, "score": 0.0}
        return final, {"scan_id": scan_id, "project_id": project_id, "status": COMPLETED, "error": None} | {k: counted[k] for k in ("finding_count", "severity", "score")}
    except Exception as e:  # whatever stops a scan is recorded with it
        return None, {"scan_id": scan_id, "project_id": project_id, "status": FAILED, "error": str(e)[:1000], "finding_count": 0, "severity": {}, "score": 0.0}


def intersection(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The common part of two ranges as a struct; null if they don't meet."""
    lo, hi = F.greatest(start, other_start), F.least(end, other_end)
    return F.when(lo <= hi, F.struct(lo.alias("start"), hi.alias("end")))


def http_time(at: Column) -> Column:
    """A UTC timestamp as RFC 1123 text."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'UTC'")


def iso_time(at: Column) -> Column:
    """A UTC timestamp as RFC 3339 text."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
