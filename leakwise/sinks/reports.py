"""Reports as frames, and their writers."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakwise.functions import paths
from leakwise.functions.text import DASH, dash_if_blank, redacted
from leakwise.operators.overlap import canonical_order
from leakwise.schema import HIGH, INFO, LOW, MEDIUM, confidence_name

# The columns of the CSV report.
CSV_COLUMNS = ("Code", "Severity", "Description", "File", "File Location", "SHA256", "Tags", "Detector ID", "Repository")


def extra_headers(findings: DataFrame) -> list[str]:
    """Keys of ``key=value`` tags, sorted: the extra columns of a report (a header line, so few)."""
    keys = findings.select(F.explode("tags").alias("t")).where(F.col("t").contains("=")).select(F.substring_index("t", "=", 1).alias("k"))
    return [r["k"] for r in keys.distinct().orderBy("k").collect()]


def csv_rows(findings: DataFrame, headers: list[str], raw_source: bool = False) -> DataFrame:
    """The CSV columns; blanks become dashes; sources are redacted unless ``raw_source``."""
    location = F.coalesce("location", F.lit(DASH))
    source = F.col("source") if raw_source else redacted(F.col("source"))
    place = F.format_string("Line: %d Column: %d", F.col("start_line") + 1, F.col("start_char") + 1)
    tags = F.array_join("tags", " ")
    fixed = [source, confidence_name("confidence"), F.col("headline"), location, place, F.col("sha256"), tags, F.col("provider_id"), paths.repository_of(location)]

    def tagged(key: str) -> Column:
        own = F.filter("tags", lambda t: t.startswith(f"{key}="))
        return F.try_element_at(F.split(F.try_element_at(own, F.lit(-1)), "="), F.lit(2))

    return findings.select(*[dash_if_blank(c).alias(n) for c, n in zip(fixed, CSV_COLUMNS, strict=True)], *[dash_if_blank(tagged(h)).alias(h) for h in headers])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings.orderBy(*canonical_order()), extra_headers(findings)).write.mode("overwrite").csv(path, header=True)


def sarif_level() -> Column:
    return F.when(F.col("confidence") >= HIGH, "error").when(F.col("confidence") <= INFO, "note").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules in the order of their first finding, with its level."""
    key = F.struct(F.coalesce("location", F.lit("")).alias("location"), "repo_index", "raw_start", "raw_end", "provider_id")
    first = findings.groupBy(F.col("headline").alias("rule_id")).agg(F.min(F.struct(key.alias("key"), sarif_level().alias("level"))).alias("first"))
    return first.select("rule_id", F.col("first.level").alias("level"), F.col("first.key").alias("key")).orderBy("key")


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results of a SARIF run, one per finding; lines and columns count from 1."""
    return findings.select(
        F.col("headline").alias("rule_id"), sarif_level().alias("level"), F.col("headline").alias("message"), F.col("location").alias("uri"),
        (F.col("start_line") + 1).alias("start_line"), (F.col("start_char") + 1).alias("start_column"), (F.col("end_line") + 1).alias("end_line"),
        (F.col("end_char") + 1).alias("end_column"), F.col("sha256").alias("fingerprint"),
    )


def sarif_lines(findings: DataFrame, tool: str = "leakwise") -> DataFrame:
    """The SARIF 2.1.0 file as ordered lines: a head with the rules, a line per result, a tail. It is one file, but its
    results are never gathered in one row."""
    rules = sarif_rules(findings).select("rule_id", "level").collect()  # as many as there are kinds of findings
    driver = {"name": tool, "rules": [{"id": r["rule_id"], "name": r["rule_id"], "defaultConfiguration": {"level": r["level"]}} for r in rules]}
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":' + json.dumps(driver) + '},"results":['
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    prints = F.create_map(F.lit("findingHash/v1"), F.coalesce("fingerprint", F.lit("")))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints")))
    body = sarif_results(findings).select(F.lit(1).alias("part"), F.coalesce("uri", F.lit("")).alias("uri"), F.col("start_line").alias("line"), result.alias("text"))
    # the first result goes without a comma, together with any that equal it
    low = body.agg(F.min(F.struct("uri", "line", "text")).alias("low")).first()["low"]
    same = F.col("text") == F.lit(low["text"]) if low else F.lit(False)
    lead = ",".join([low["text"]] * body.where(same).count()) if low else ""
    ends = findings.sparkSession.createDataFrame([(0, "", 0, head + lead), (2, "", 0, "]}]}")], "part int, uri string, line long, text string")
    return ends.unionByName(body.where(~same).withColumn("text", F.concat(F.lit(","), "text"))).orderBy("part", "uri", "line", "text")


def write_sarif(findings: DataFrame, path: str) -> None:
    """The file in parts below ``path``, sorted and written in parallel: joined in the order of their names they are the
    file, which :func:`join_parts` writes."""
    sarif_lines(findings).select("text").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One file out of the parts of a folder, streamed through the file system's own copy."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(target)
    system = source.getFileSystem(conf)
    parts = sorted((s.getPath().getName(), s) for s in system.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = to.getFileSystem(conf).create(to)
    try:
        for _, status in parts:
            piece = system.open(status.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
            finally:
                piece.close()
    finally:
        out.close()


def write_results(findings: DataFrame, path: str) -> None:
    """Lines of JSON without raw values: the source is redacted and the value left out."""
    findings.withColumn("source", redacted(F.col("source"))).drop("value").write.mode("append").json(path)


def editor_diagnostics(findings: DataFrame) -> DataFrame:
    """Positions from 0 with the editor's severity: High 1, Medium 2, Low 3, all others 4."""
    level = F.when(F.col("confidence") == HIGH, 1).when(F.col("confidence") == MEDIUM, 2).when(F.col("confidence") == LOW, 3).otherwise(4)
    return findings.select("location", "start_line", "start_char", "end_line", "end_char", level.alias("severity"), F.col("headline").alias("message"), F.col("provider_id").alias("source"))


def project_rows(projects: DataFrame, latest_scores: DataFrame) -> DataFrame:
    """A row per project for the workspace report: the whole part of the metric and the counts, dashes where it was
    never scanned; repositories are joined."""
    joined = projects.join(latest_scores, "project_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(DASH))
    metric = F.when(~F.isnan("metric"), F.floor("metric")).cast("string")
    counts = [text(f"{n}_count").alias(n) for n in ("production", "critical", "high", "medium", "low", "info")]
    where = F.array_join("repositories", "; ") if "repositories" in projects.columns else F.lit("")
    return joined.select("name", text("grade").alias("grade"), F.coalesce(metric, F.lit(DASH)).alias("metric"), *counts, "workspace", where.alias("repositories"), "project_id")


ALL_WORKSPACES = "__cm_all"


def workspace_issues(projects: DataFrame, scans: DataFrame, findings: DataFrame, workspace: str = ALL_WORKSPACES) -> DataFrame:
    """Findings of the last scan of each project of a workspace."""
    wanted = projects if workspace == ALL_WORKSPACES else projects.where(F.col("workspace") == workspace)
    last = scans.groupBy("project_id").agg(F.max_by("scan_id", "position").alias("scan_id"))
    return findings.join(wanted.select("project_id", "name", "workspace").join(last, "project_id"), ["project_id", "scan_id"])


def report_rows(findings: DataFrame) -> DataFrame:
    """What a printed report shows: most severe first, locations shortened, values redacted."""
    return findings.select(
        confidence_name("confidence").alias("severity"), "headline", paths.short_location(F.col("location")).alias("location"), redacted(F.col("value")).alias("value"), "confidence", "start_line"
    ).orderBy(F.col("confidence").desc(), "location", "start_line")


def severity_chart(findings: DataFrame) -> DataFrame:
    return findings.groupBy(confidence_name("confidence").alias("severity")).agg(F.count("*").alias("n"), F.first("confidence").alias("level")).orderBy(F.col("level").desc()).drop("level")


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def deliver(body: bytes, secret: str, post: Callable[[bytes, dict[str, str]], int], attempts: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Send a signed body until it is accepted: at most ``attempts`` times, the wait doubling; returns the tries."""
    headers = {"Content-Type": "application/json", "X-Signature-256": signature(secret, body)}
    for n in range(1, attempts + 1):
        try:
            if 200 <= post(body, headers) < 300:
                return n
        except OSError:
            pass
        if n < attempts:
            sleep(wait * 2 ** (n - 1))
    return -attempts


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with their place in their file, for reports that number them."""
    return findings.withColumn("number", F.row_number().over(Window.partitionBy("location").orderBy("raw_start", "raw_end", "provider_id")))


