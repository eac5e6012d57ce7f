"""Row shapes and the ordered confidence names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered: the place in this list is the number used inside frames.
CONFIDENCES = ("Info", "Low", "Medium", "High", "Critical")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)

EVIDENCE = "struct<description:string,confidence:int>"
POSITION = "struct<line:bigint,character:bigint>"
FINDING = (
    "repo_index int, location string, provider_id string, headline string, confidence int, "
    f"reasons array<{EVIDENCE}>, start_line long, start_char long, end_line long, end_char long, "
    "highlight_start_line long, highlight_start_char long, highlight_end_line long, highlight_end_char long, "
    "raw_start long, raw_end long, source string, value string, sha256 string, excluded boolean, tags array<string>"
)
EXCEPTION = (
    "id string, ord int, rule_id string, status string, expires_at timestamp, type string, path string, "
    "line_start int, line_end int, secret_checksum string, string_match string, regex_match string"
)


def confidence_name(col: str | Column) -> Column:
    """The name of a confidence number; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.element_at(F.array(*map(F.lit, CONFIDENCES)), c + 1)


def confidence_number(col: str | Column, unknown: int | None = HIGH) -> Column:
    """The number of a name in any case; other names give ``unknown`` (a store reads them as High; None is strict)."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    out = F.lit(unknown).cast("int")
    for i, name in enumerate(CONFIDENCES):
        out = F.when(c == name.lower(), i).otherwise(out)
    return out
