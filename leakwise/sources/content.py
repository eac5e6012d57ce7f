"""File contents, fetched once for the files that are wanted, in byte ranges.

A listing has the path and length of each file and opens none. What the gate leaves of it is fetched by tasks of about the same
number of bytes; files longer than a piece come as several rows, whose ranges start after line breaks. Offsets of a piece are
known from its range; lines need the line breaks before it, which one look at the longer files gives as prefix sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a piece, of a task, and how far a cut may move to come after a line break.
PIECE, TASK, CARRY = 32 << 20, 128 << 20, 1 << 20
#: Bytes that go to Spark at once.
AT_ONCE = 8 << 20


@cache
def _file_system(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0] if root else fs.LocalFileSystem()


def open_uri(uri: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for reading at any place."""
    local = re.sub("^file:/+", "/", uri)
    scheme = re.match(r"([a-z0-9+.-]+)://([^/]*)(/.*)", local)
    if scheme is None:
        return _file_system("").open_input_file(local)
    name, host, path = scheme.groups()
    inside = host + path if name in ("s3", "s3a", "gs", "gcs", "abfs", "abfss") else path
    return _file_system(f"{name.removesuffix('a') if name == 's3a' else name}://{host}/").open_input_file(inside)


def boundary(file: pa.NativeFile, at: int, size: int, carry: int) -> int:
    """Where the piece that begins at ``at`` really begins: after the first line break from the byte before on; without one
    within ``carry`` bytes at the first whole character."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    file.seek(at - 1)
    ahead = file.read(min(carry, size - at) + 1)
    end = ahead.find(b"\n")
    if end >= 0:
        return at + end
    skip = 1
    while skip < min(4, len(ahead)) and ahead[skip] & 0xC0 == 0x80:
        skip += 1
    return at + skip - 1


def piece_range(file: pa.NativeFile, piece: int, size: int, length: int, carry: int) -> tuple[int, int]:
    carry = min(carry, length)
    return boundary(file, piece * length, size, carry), boundary(file, (piece + 1) * length, size, carry)


Open = Callable[[str], pa.NativeFile]


def _mapped(rows: DataFrame, more: str, read: Callable[[dict], tuple | None]) -> DataFrame:
    """``rows`` with the columns ``more``, which ``read`` gives for each row; rows for which it gives None are left out."""
    shape = StructType([*rows.schema.fields, *StructType.fromDDL(more).fields])
    arrow = to_arrow_schema(shape)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                got = read(row)
                if got is None:
                    continue
                found.append((*row.values(), *got))
                held += sum(len(x) for x in got if isinstance(x, bytes))
                if held >= AT_ONCE or len(found) >= 4096:
                    yield batch_of(found)
                    found, held = [], 0
        if found:
            yield batch_of(found)

    return rows.mapInArrow(run, shape)


def tasks_for(files: DataFrame, task: int = TASK) -> int:
    """How many tasks of about ``task`` bytes ``files`` (size) make, and over all cores if there are few files."""
    total, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    return max(1, -(-total // task), min(files.sparkSession.sparkContext.defaultParallelism, n))


def dealt(files: DataFrame, tasks: int) -> DataFrame:
    """``files`` (uri, and piece if there is one) over so many tasks. Only paths move."""
    return files.repartition(tasks, "uri", *(["piece"] if "piece" in files.columns else []))


def heads(files: DataFrame, length: int, opener: Open = open_uri) -> DataFrame:
    """``files`` (uri, ...) with the first ``length`` bytes as ``head``."""

    def read(row: dict) -> tuple:
        with opener(row["uri"]) as f:
            return (f.read(length),)

    return _mapped(files, "head binary", read)


def fetched(files: DataFrame, opener: Open = open_uri) -> DataFrame:
    """``files`` (uri, ...) with their whole ``content``."""

    def read(row: dict) -> tuple:
        with opener(row["uri"]) as f:
            return (f.read(),)

    return _mapped(files, "content binary", read)


def digested(files: DataFrame, keep: int = PIECE, opener: Open = open_uri) -> DataFrame:
    """``files`` (uri, ...) with the first ``keep`` bytes as ``content`` and the SHA-256 of all, read in blocks."""

    def read(row: dict) -> tuple:
        digest, first = hashlib.sha256(), b""
        with opener(row["uri"]) as f:
            while block := f.read(AT_ONCE):
                digest.update(block)
                if len(first) < keep:
                    first += block[: keep - len(first)]
        return first, digest.hexdigest()

    return _mapped(files, "content binary, digest string", read)


def in_pieces(files: DataFrame, length: int = PIECE) -> DataFrame:
    """A row per piece of ``length`` bytes: ``files`` (uri, size, ...) with ``piece``, from 0 on."""
    last = F.greatest(F.ceil(F.col("size") / length) - 1, F.lit(0))
    return files.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))


def line_bases(pieces: DataFrame, length: int = PIECE, carry: int = CARRY, opener: Open = open_uri) -> DataFrame:
    """``pieces`` (uri, size, piece) -> uri, piece, start, base_line (line breaks before it) and line_start (where the line
    that it begins in starts). Only counts leave the tasks; a file's counts, a row a piece, are summed by a window."""

    def read(row: dict) -> tuple:
        with opener(row["uri"]) as f:
            start, end = piece_range(f, row["piece"], row["size"], length, carry)
            f.seek(start)
            breaks, last, at = 0, -1, start
            while at < end and (block := f.read(min(AT_ONCE, end - at))):
                breaks += block.count(b"\n")
                found = block.rfind(b"\n")
                last = at + found + 1 if found >= 0 else last
                at += len(block)
        return start, breaks, last

    counted = _mapped(pieces.select("uri", "size", "piece"), "start long, breaks long, last long", read)
    before = Window.partitionBy("uri").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "uri", "piece", "start", F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("base_line"), F.greatest(F.coalesce(F.max("last").over(before), F.lit(0)), F.lit(0)).alias("line_start")
    )


def piece_contents(pieces: DataFrame, length: int = PIECE, carry: int = CARRY, opener: Open = open_uri) -> DataFrame:
    """``pieces`` (uri, size, piece, ...) with the ``content`` of their ranges; empty pieces (a line goes on beyond them) are
    left out."""

    def read(row: dict) -> tuple | None:
        with opener(row["uri"]) as f:
            start, end = piece_range(f, row["piece"], row["size"], length, carry)
            f.seek(start)
            return (f.read(end - start),) if end > start else None

    return _mapped(pieces, "content binary", read)


def cuts(bases: DataFrame) -> DataFrame:
    """uri, pieces, and how many of them begin inside a line: where a match can have been cut."""
    inside = (F.col("line_start") < F.col("start")).cast("int")
    return bases.groupBy("uri").agg(F.count("*").alias("pieces"), F.sum(inside).alias("cuts"))


def rebased(findings: DataFrame) -> DataFrame:
    """Findings of pieces (with start, base_line and line_start) at their places in the whole file."""
    shift = F.col("start") - F.col("line_start")
    moved = {c: F.col(c) + F.col("start") for c in ("raw_start", "raw_end")}
    for side in ("start", "end", "highlight_start", "highlight_end"):
        first = F.col(f"{side}_line") == 0
        moved[f"{side}_char"] = F.col(f"{side}_char") + F.when(first, shift).otherwise(0)
        moved[f"{side}_line"] = F.col(f"{side}_line") + F.col("base_line")
    return findings.withColumns(moved).drop("start", "base_line", "line_start")
