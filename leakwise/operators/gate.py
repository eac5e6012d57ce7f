"""The path gate: which files are scanned, which are confidential, which are ignored and why.

All verdicts are columns of one projection, so a file's path is judged once and the ignored rows are a filter of the
same frame. Extension tables have a few thousand rows at most and become ``isin`` lists or map literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.functions import paths
from leakwise.operators.matching import Exclusions, any_match
from leakwise.rules import extensions as ext
from leakwise.rules import patterns as p
from leakwise.schema import CRITICAL, HIGH, INFO, MEDIUM

SCAN, TEST, EXCLUDED, EXTENSION, SIZE, BINARY = "scan", "test", "excluded", "extension", "size", "binary"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


def confidential_why(path: Column, tables: ext.ExtensionTables) -> Column:
    """Why a file is confidential by its name: base name, certificate or key store, dangerous, financial (but for readme
    and changelog); null if it isn't."""
    e, base = paths.extension(path), paths.base_name(path)
    financial = F.when(~F.lower(base).isin("readme", "changelog"), _lookup(e, tables.financial))
    return F.coalesce(_lookup(base, tables.names), _lookup(e, tables.certificates), _lookup(e, tables.dangerous), financial)


def text_like(content: Column) -> Column:
    """Whether the first bytes look like plain text: as many as are sniffed must be there, none a control byte, and no
    markup or document prefix."""
    head = F.decode(F.substring(content, 1, ext.SNIFFED_BYTES), "iso-8859-1")
    control = head.rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]")
    markup = F.ltrim(F.lower(head)).rlike(r"^(<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a[ >]|<style|<title|<b[ >]|<body|<br|<p[ >]|<!--|<\?xml|%pdf-)")
    return (F.length(content) >= ext.SNIFFED_BYTES) & ~control & ~markup


def gate(files: DataFrame, exclusions: Exclusions = Exclusions(), tables: ext.ExtensionTables | None = None, exclude_tests: bool = False, content: str | None = "content", size: str = "size") -> DataFrame:
    """``files`` (path, size, content) with extension, is_test, path_excluded, why_confidential and gate_status.

    The verdicts apply in the order test, path, extension, size, text sniff; the last is for files without extension.
    """
    t = tables or ext.ExtensionTables()
    path = F.col("path")
    framed = files.withColumns({
        "extension": paths.extension(path),
        "is_test": paths.is_test_path(path),
        "path_excluded": any_match(path, exclusions.paths),
        "why_confidential": confidential_why(path, t),
    })
    e = F.col("extension")
    sniffed = text_like(F.col(content)) if content else F.lit(True)
    status = (
        F.when(F.lit(exclude_tests) & F.col("is_test"), TEST)
        .when(F.col("path_excluded"), EXCLUDED)
        .when((e != "") & ~e.isin(*sorted(t.text)), EXTENSION)
        .when((F.col(size) > ext.SIZE_LIMIT) & ~e.isin(*ext.RECOGNISED), SIZE)
        .when((e == "") & ~sniffed, BINARY)
        .otherwise(SCAN)
    )
    return framed.withColumn("gate_status", status)


def ignored_rows(gated: DataFrame) -> DataFrame:
    """A row of High confidence for each file that isn't scanned for its test path, an exclusion, its size or its
    extension; only those without a known extension are not marked as excluded. A confidential file that is left out
    as a test or excluded has a second row, of the finder of confidential files. (A file that is no text is not
    reported.)"""
    path, status = F.col("path"), F.col("gate_status")
    why = (
        F.when(status == TEST, F.concat(F.lit("Skipped: Suspected test file "), path))
        .when(status == EXCLUDED, F.concat(F.lit("Skipped: An exclusion matches path "), path))
        .when(status == SIZE, F.concat(F.lit("Skipped: File "), path, F.lit(f" exceeds {ext.SIZE_LIMIT} bytes in size")))
        .otherwise(F.concat(F.lit("Skipped: File extension "), F.col("extension"), F.lit(" is ignored")))
    )
    both = F.col("why_confidential").isNotNull() & status.isin(TEST, EXCLUDED)
    providers = F.when(both, F.array(F.lit(ext.PATH_PROVIDER), F.lit(ext.CONFIDENTIAL_PROVIDER))).otherwise(F.array(F.lit(ext.PATH_PROVIDER)))
    tags = F.when(F.col("is_test"), F.array(F.lit("test"))).otherwise(F.array().cast("array<string>"))
    return gated.where(~status.isin(SCAN, BINARY)).select(
        "repo_index", path.alias("location"), F.explode(providers).alias("provider_id"), why.alias("headline"), F.lit(HIGH).alias("confidence"), (status != EXTENSION).alias("excluded"), tags.alias("tags")
    )


def certificate_evidence(text: Column, why: Column) -> tuple[Column, Column]:
    """(description, confidence) from the PEM headers: none gives High; the first private one decides and is Critical;
    a public one gives Info, which later headers of neither kind keep."""
    kinds = F.regexp_extract_all(text, F.lit(p.CERTIFICATE), F.lit(1))
    start = F.struct(why.alias("what"), F.lit(HIGH).alias("confidence"), F.lit(False).alias("done"))

    def step(acc: Column, kind: Column) -> Column:
        private, public = F.lower(kind).contains("private"), F.lower(kind).contains("public")
        seen = F.struct(
            F.concat(F.lit("Warning! You may be sharing confidential ("), kind, F.lit(") data with your code")).alias("what"),
            F.when(private, CRITICAL).when(public, INFO).otherwise(acc["confidence"]).alias("confidence"),
            private.alias("done"),
        )
        return F.when(acc["done"], acc).otherwise(seen)

    folded = F.aggregate(F.coalesce(kinds, F.array().cast("array<string>")), start, step)
    return folded["what"], folded["confidence"]


def confidential_findings(gated: DataFrame, content: str = "content", checksum: bool = True, digest: str | None = None) -> DataFrame:
    """One finding per confidential file that is neither excluded nor left out as a test. Its hash is that of the content,
    or the column ``digest``."""
    path = F.col("path")
    name, e = F.substring_index(path, "/", -1), F.col("extension")
    what, level = certificate_evidence(F.decode(F.col(content), "iso-8859-1"), F.col("why_confidential"))
    key_file = name.isin("id_dsa", "id_rsa") | e.isin(".crt", ".cer", ".pem", ".key")
    public = name.isin("id_dsa.pub", "id_rsa.pub")
    headline = F.when(key_file, what).when(public, "Warning! You may be sharing public SSH keys with your code").otherwise(F.col("why_confidential"))
    confidence = F.when(key_file, level).when(public, INFO).when(e.isin(".p12", ".pfx"), CRITICAL).otherwise(MEDIUM)
    zero = F.lit(0).cast("long")
    shown = gated.where(F.col("why_confidential").isNotNull() & ~F.col("gate_status").isin(TEST, EXCLUDED))
    return shown.withColumns({"_what": headline, "_level": confidence.cast("int")}).select(
        "repo_index", path.alias("location"), F.lit(ext.CONFIDENTIAL_PROVIDER).alias("provider_id"), F.col("_what").alias("headline"), F.col("_level").alias("confidence"),
        F.array(F.struct(F.col("_what").alias("description"), F.col("_level").alias("confidence"))).alias("reasons"),
        *[zero.alias(c) for c in ("start_line", "start_char", "end_line", "end_char", "highlight_start_line", "highlight_start_char", "highlight_end_line", "highlight_end_char", "raw_start", "raw_end")],
        F.lit("").alias("source"), F.lit(None).cast("string").alias("value"),
        ((F.col(digest) if digest else F.sha2(F.col(content), 256)) if checksum else F.lit(None).cast("string")).alias("sha256"),
        F.lit(False).alias("excluded"), F.array(F.lit("confidential")).alias("tags"),
    )
