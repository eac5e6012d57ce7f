"""Latest-of-group, paging, carry-forward, remediation, and commits to be scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwise.functions.text import has_tag
from leakwise.schema import confidence_name


def latest_by(rows: DataFrame, by: list[str], newest: list[Column]) -> DataFrame:
    """The first row of each group in the order ``newest``; Spark cuts each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def carry_forward(new: DataFrame, old: DataFrame, columns: tuple[str, ...] = ("ai_annotation", "verification_status")) -> DataFrame:
    """New findings with the triage of the latest earlier row of the same project and finding that has any."""
    triaged = old.where("ai_annotation is not null or coalesce(verification_status, 'NOT_CHECKED') <> 'NOT_CHECKED'")
    last = latest_by(triaged, ["project_id", "finding_id"], [F.col("row_id").desc()])
    kept = last.select("project_id", "finding_id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = new.drop(*columns).join(kept, ["project_id", "finding_id"], "left")
    defaults = {"verification_status": F.lit("NOT_CHECKED")}
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), defaults.get(c, F.lit(None))).cast("string") for c in columns}).drop(*[f"_{c}" for c in columns])


def remediate(findings: DataFrame, checksum: str, exception_id: str) -> DataFrame:
    """All findings of a secret, in every project, marked as suppressed by an exception."""
    hit = F.col("sha256") == checksum
    return findings.withColumns({"suppressed": F.col("suppressed") | F.coalesce(hit, F.lit(False)), "exception_id": F.when(hit, exception_id).otherwise(F.col("exception_id"))})


def insert_new(stored: DataFrame | None, rows: DataFrame, key: tuple[str, ...] = ("finding_id", "scan_id")) -> DataFrame:
    """Rows whose key is neither stored nor repeated: insert-or-ignore."""
    fresh = rows.dropDuplicates(list(key))
    return fresh if stored is None else fresh.join(stored.select(*key), list(key), "left_anti")


def issue_filter(findings: DataFrame, confidences: list[int] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Any of the confidences and any of the tags; an empty list is no filter; ``prod`` means not tagged as test."""
    out = findings
    if confidences:
        out = out.where(F.col("confidence").isin(*confidences))
    if tags:
        wanted = F.lit(False)
        for t in tags:
            wanted = wanted | has_tag(F.col("tags"), t)
        out = out.where(wanted)
    return out


def search_findings(findings: DataFrame, projects: list[str] | None = None, severities: list[str] | None = None, secret_types: list[str] | None = None, suppressed: bool | None = None, parity: bool = False) -> DataFrame:
    """Filters of a findings search; with ``parity`` only the projects count."""
    out = findings
    for column, wanted in (("project_id", projects), *(() if parity else (("severity", severities), ("secret_type", secret_types)))):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    return out if parity or suppressed is None else out.where(F.col("suppressed") == suppressed)


def store_order() -> list[Column]:
    """Severity as text, then path and line."""
    return [confidence_name("confidence"), F.col("location"), F.col("start_line")]


def page(rows: DataFrame, order: list[Column], number: int, size: int, first: int = 0) -> DataFrame:
    """Page ``number`` (counted from ``first``) of ``size`` rows; sizes outside 1 to 100 become 50 for pages from 1."""
    if first == 1 and not 1 <= size <= 100:
        size = 50
    return rows.orderBy(*order).offset(max(0, number - first) * size).limit(size)


def seek_page(rows: DataFrame, order: list[Column], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after a cursor, the values of ``order`` of the last row seen (None: from the start).

    Rows up to the cursor are left out by a filter and the rest is cut to ``size`` per task, so a late page costs no more
    than an early one, unlike an offset. ``order`` is ascending and tells rows apart; nulls come first.
    """
    if after is not None:
        kinds = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(order)]).schema
        seen = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, kinds, strict=True)])
        rows = rows.where(F.struct(*[c.alias(f.name) for c, f in zip(order, kinds, strict=True)]) > seen)
    return rows.orderBy(*order).limit(size)


def cursor(page: DataFrame, order: list[Column]) -> tuple | None:
    """The cursor behind a page: the values of ``order`` of its last row; None if it is empty."""
    last = page.select(*order).collect()
    return tuple(last[-1]) if last else None


def legacy_page(rows: DataFrame, order: list[Column], number: int, size: int, confidences: list[int] | None = None, tags: list[str] | None = None) -> DataFrame:
    """The offset counts unfiltered rows; from there on rows pass the filter until the page is full."""
    rest = rows.orderBy(*order).offset(number * size)
    return issue_filter(rest, confidences, tags).orderBy(*order).limit(size)


def commits_to_scan(commits: DataFrame, scanned: DataFrame, older: bool = False) -> DataFrame:
    """Per branch that has been scanned before: its unscanned head, else (``older``) its newest unscanned commit."""
    known = scanned.select("repository", "branch").distinct()
    fresh = commits.join(known, ["repository", "branch"], "left_semi").join(scanned.select("repository", "branch", "hash"), ["repository", "branch", "hash"], "left_anti")
    if not older:
        fresh = fresh.where("is_head")
    return latest_by(fresh, ["repository", "branch"], [F.col("is_head").desc(), F.col("time").desc(), F.col("hash")])


def commits_since(commits: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Commits newer than the last one known of their branch; all of a branch not known yet."""
    last = last_seen.groupBy("repository", "branch").agg(F.max("time").alias("_last"))
    return commits.join(last, ["repository", "branch"], "left").where("_last is null or time > _last").drop("_last")


def members(entries: DataFrame, groups: dict[str, list[str]], any_of: bool = True) -> DataFrame:
    """Directory entries (dn, attributes map of lists) whose attributes share a value with the wanted ones, for any or
    for all attributes."""
    tests = [F.coalesce(F.arrays_overlap(F.try_element_at("attributes", F.lit(k)), F.array(*map(F.lit, v))), F.lit(False)) for k, v in groups.items()]
    out = F.lit(not any_of)
    for t in tests:
        out = out | t if any_of else out & t
    return entries.where(out)
