"""The scan: files -> gate -> finders -> exclusions -> tags -> ids, one plan in which no content is shuffled."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwise.functions import paths
from leakwise.functions.text import finding_id, secret_type
from leakwise.operators import gate as g
from leakwise.operators.exclusions import apply_exclusions, match_exceptions
from leakwise.operators.finders import COLUMNS, Exclusions, FinderOptions, find_secrets
from leakwise.operators.overlap import canonical_order, remove_overlapping, subsume
from leakwise.rules import extensions as ext
from leakwise.rules.extensions import ExtensionTables
from leakwise.rules.patterns import VendorRule, vendor_rules
from leakwise.sources import content as c
from leakwise.sources.files import list_roots, with_text


@dataclass(frozen=True)
class ScanOptions:
    """What a scan does; parallelism is Spark's, so there is no number of workers."""

    show_source: bool = True
    exclusions: Exclusions = Exclusions()
    confidential_only: bool = False
    checksum: bool = True
    report_ignored: bool = False
    exclude_tests: bool = False
    prefilter: bool = True
    prune: tuple[str, ...] = ()
    rules: tuple[VendorRule, ...] = field(default_factory=vendor_rules)
    tables: ExtensionTables = field(default_factory=ExtensionTables)


def tagged(findings: DataFrame) -> DataFrame:
    """Findings in test paths get the tag ``test``."""
    test = F.when(paths.is_test_path(F.col("location")), F.array(F.lit("test"))).otherwise(F.array().cast("array<string>"))
    return findings.withColumn("tags", F.array_union(F.col("tags"), test))


def with_roots(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """Locations below a checkout become locations of its repository; tags get the branch and the attributes.

    ``roots``: (repo_index, checkout, repo_url, branch, attributes). It has a row per root, so it is a small table; its
    size decides how it is joined.
    """
    r = roots.select("repo_index", "checkout", "repo_url", "branch", "attributes")
    joined = findings.join(r, "repo_index", "left")
    inside = F.col("repo_url").isNotNull() & F.col("location").startswith(F.col("checkout"))
    moved = F.concat("repo_url", F.substring(F.col("location"), F.length("checkout") + 1, F.length("location")))
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("attributes", F.expr("cast(map() as map<string,string>)")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    branch = F.when(F.coalesce("branch", F.lit("")) != "", F.array(F.concat(F.lit("branch="), "branch"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumns({"location": F.when(inside, moved).otherwise(F.col("location")), "tags": F.concat("tags", branch, pairs)}).drop("checkout", "repo_url", "branch", "attributes")


def identified(findings: DataFrame) -> DataFrame:
    """With finding_id and secret_type."""
    return findings.withColumns(
        {"finding_id": finding_id(F.col("headline"), F.col("location"), F.col("start_line"), F.col("start_char"), F.col("sha256")), "secret_type": secret_type(F.col("headline"))}
    )


def scan_files(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Findings of ``files`` (repo_index, path, size, text and, for file contents, content)."""
    o = options or ScanOptions()
    binary = "content" in files.columns
    gated = g.gate(files, o.exclusions, o.tables, o.exclude_tests, content="content" if binary else None)
    parts = []
    if not o.confidential_only:
        finder = FinderOptions(o.rules, o.exclusions, o.checksum, o.show_source, o.prefilter)
        scanned = gated.where(F.col("gate_status") == g.SCAN).select("repo_index", "path", "text")
        parts.append(apply_exclusions(tagged(find_secrets(scanned, finder)), o.exclusions))
    if binary:
        parts.append(g.confidential_findings(gated, checksum=o.checksum))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None
    if found is None:
        raise ValueError("a scan for confidential files only needs their content")
    if o.report_ignored:
        found = found.unionByName(g.ignored_rows(gated), allowMissingColumns=True)
    return identified(found)


def scan_paths(spark: SparkSession, roots: list[str], options: ScanOptions | None = None, order: bool = False, piece: int = c.PIECE, opener: c.Open = c.open_uri) -> DataFrame:
    """Findings of all files below local or remote roots, in canonical order if asked for (which sorts).

    First the files are listed and gated by path and size; then those that are left are fetched, and no others are opened. A
    file without extension shows its first bytes before. Files longer than ``piece`` bytes are scanned in pieces that begin
    after line breaks; their findings meet once to be settled as those of one file. A match that goes on beyond a piece ends
    there (``content.cuts`` counts the pieces that had to begin inside a line). A file that is confidential and is scanned as
    well is fetched for each.
    """
    o = options or ScanOptions()
    gated = g.gate(list_roots(spark, roots, o.prune), o.exclusions, o.tables, o.exclude_tests, content=None)
    finder, parts = FinderOptions(o.rules, o.exclusions, o.checksum, o.show_source, o.prefilter), []
    if not o.confidential_only:
        scanned = gated.where(F.col("gate_status") == g.SCAN)
        whole, long = scanned.where(F.col("size") <= piece), scanned.where(F.col("size") > piece)
        tasks = c.tasks_for(whole)  # a job over the listing, as is the next one
        found = find_secrets(with_text(c.fetched(c.dealt(_texts(whole, tasks, opener), tasks), opener)), finder)
        if not long.isEmpty():
            found = found.unionByName(_scan_pieces(_texts(long, c.tasks_for(long), opener), finder, piece, c.tasks_for(long), opener))
        parts.append(apply_exclusions(tagged(found), o.exclusions))
    hidden = gated.where(F.col("why_confidential").isNotNull() & ~F.col("gate_status").isin(g.TEST, g.EXCLUDED))
    parts.append(g.confidential_findings(c.digested(c.dealt(hidden, c.tasks_for(hidden)), piece, opener), checksum=o.checksum, digest="digest"))
    found = reduce(DataFrame.unionByName, parts)
    if o.report_ignored:
        found = found.unionByName(g.ignored_rows(gated), allowMissingColumns=True)
    found = identified(found)
    return found.orderBy(*canonical_order()) if order else found


def _texts(files: DataFrame, tasks: int, opener: c.Open) -> DataFrame:
    """The files that are to be fetched: all with an extension, others if their first bytes look like text."""
    rows = files.select("repo_index", "path", "size", "uri", "extension")
    unknown = c.heads(c.dealt(rows.where("extension = ''"), tasks), ext.SNIFFED_BYTES, opener)
    return rows.where("extension <> ''").unionByName(unknown.where(g.text_like(F.col("head"))).drop("head")).drop("extension")


def _scan_pieces(files: DataFrame, finder: FinderOptions, piece: int, tasks: int, opener: c.Open) -> DataFrame:
    pieces = c.in_pieces(files, piece)
    placed = pieces.join(c.line_bases(c.dealt(pieces, tasks), piece, opener=opener), ["uri", "piece"])
    texts = with_text(c.piece_contents(c.dealt(placed, tasks), piece, opener=opener))
    found = c.rebased(find_secrets(texts, replace(finder, fused=False), keep=("start", "base_line", "line_start")))
    file = ["repo_index", "location"]
    return subsume(remove_overlapping(found, file), file).select(*COLUMNS)


def scan_strings(requests: DataFrame, options: FinderOptions | None = None) -> DataFrame:
    """Findings of (repo_index, path, text) strings: no gate and no checksum."""
    o = options or FinderOptions(checksum=False)
    return find_secrets(requests, o)


def project_scan(files: DataFrame, exceptions: DataFrame, now, options: ScanOptions | None = None) -> DataFrame:
    """A scan with the state of suppression of each finding; every finding is a row, also where files repeat."""
    return match_exceptions(scan_files(files, options), exceptions, now)
