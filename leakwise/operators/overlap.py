"""Overlapping findings of one file: removal of contained ones, then subsumption of weaker ones.

Both exist as plain functions over the rows of one file (used inside the scan, where a file's findings are together
already) and as DataFrame operators over stored findings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwise.schema import CRITICAL, INFO


def drop_contained(rows: list[dict]) -> list[dict]:
    """Without the rows that another one properly contains at equal or higher confidence (judged on all rows)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["raw_start"], -rows[i]["raw_end"]))
    gone, reach = set(), [-1] * (CRITICAL + 1)  # furthest end so far of rows of at least a confidence, from earlier starts
    for _, group in groupby(order, key=lambda i: rows[i]["raw_start"]):
        same = list(group)
        here = [max((rows[i]["raw_end"] for i in same if rows[i]["confidence"] >= c), default=-1) for c in range(CRITICAL + 1)]
        gone |= {i for i in same if reach[rows[i]["confidence"]] >= rows[i]["raw_end"] or here[rows[i]["confidence"]] > rows[i]["raw_end"]}
        reach = [max(a, b) for a, b in zip(reach, here, strict=True)]
    return [r for i, r in enumerate(rows) if i not in gone]


def span(r: dict) -> int:
    """How much a finding covers: bytes, else lines, else characters, else its source."""
    if r["raw_end"] > r["raw_start"]:
        return r["raw_end"] - r["raw_start"]
    if r["end_line"] > r["start_line"]:
        return 100 * (r["end_line"] - r["start_line"] + 1)
    if r["end_char"] > r["start_char"]:
        return r["end_char"] - r["start_char"]
    return len((r["source"] or "").encode("utf-8", "surrogatepass"))


def order_in_file(r: dict) -> tuple:
    return (r["raw_start"], -span(r), -r["confidence"], r["start_line"], r["start_char"], r["provider_id"] or "", r["headline"] or "", r["source"] or "")


def overlaps(a: dict, b: dict) -> bool:
    """Byte ranges that meet, line ranges that meet (on the same lines: character ranges), or one source in the other."""
    if a["raw_end"] > 0 < b["raw_end"] and max(a["raw_start"], b["raw_start"]) <= min(a["raw_end"], b["raw_end"]):
        return True
    if max(a["start_line"], b["start_line"]) <= min(a["end_line"], b["end_line"]):
        if (a["start_line"], a["end_line"]) != (b["start_line"], b["end_line"]):
            return True
        if max(a["start_char"], b["start_char"]) <= min(a["end_char"], b["end_char"]):
            return True
    if a["source"] and b["source"]:
        x, y = a["source"].strip(), b["source"].strip()
        return x in y or y in x
    return False


def _islands(rows: list[dict], union: Callable[[int, int], None]) -> None:
    """Joins rows whose ranges may meet: by bytes, and by (line, character), where a row of several lines covers its lines
    as a whole."""
    by_bytes = [(r["raw_start"], r["raw_end"], i) for i, r in enumerate(rows) if r["raw_end"] > 0]
    by_lines = []
    for i, r in enumerate(rows):
        one = r["start_line"] == r["end_line"]
        by_lines.append(((r["start_line"], r["start_char"] if one else _FIRST), (r["end_line"], r["end_char"] if one else _LAST), i))
    for ranges in (by_bytes, by_lines):
        reach = before = None
        for low, high, i in sorted(ranges):
            if before is not None and low <= reach:
                union(before, i)
            reach, before = high if reach is None else max(reach, high), i


_FIRST, _LAST = -(1 << 62), 1 << 62
#: Characters by which sources are looked up.
GRAM = 8


def _sources(rows: list[dict], union: Callable[[int, int], None]) -> None:
    """Joins rows of which one's source holds the other's: equal ones by a look-up, others by the rarest gram of the
    shorter one."""
    of: dict[str, int] = {}
    for i, r in enumerate(rows):
        if r["source"]:
            s = r["source"].strip()
            union(of.setdefault(s, i), i)
    long = [s for s in of if len(s) >= GRAM]
    holders: dict[str, list[str]] = {}
    if len(long) > 1:
        for s in long:
            for g in {s[k : k + GRAM] for k in range(len(s) - GRAM + 1)}:
                holders.setdefault(g, []).append(s)
        for s in long:
            for x in min((holders[s[k : k + GRAM]] for k in range(len(s) - GRAM + 1)), key=len):
                if len(x) > len(s) and s in x:
                    union(of[s], of[x])
    for s in of:
        if len(s) < GRAM:
            for x in of:
                if len(x) > len(s) and s in x:
                    union(of[s], of[x])


def components(rows: list[dict]) -> list[list[int]]:
    """Places of rows in groups that don't overlap with one another."""
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(i: int, j: int) -> None:
        x, y = top(i), top(j)
        root[max(x, y)] = min(x, y)

    _islands(rows, union)
    _sources(rows, union)
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


def subsume_rows(rows: list[dict]) -> list[dict]:
    """Greedy, in the order of :func:`order_in_file`: of two that overlap the more confident stays, then the one that
    covers more, then the earlier; a row that has been removed removes no others. Rows are compared within their component
    only."""
    ranked = sorted(rows, key=order_in_file)
    alive = [True] * len(ranked)
    weight = [(r["confidence"], span(r)) for r in ranked]
    for group in components(ranked):
        active = group
        for i in group:
            if not alive[i]:
                continue
            for j in active:
                if i != j and alive[j] and overlaps(ranked[i], ranked[j]):
                    loser = j if (weight[i], -i) > (weight[j], -j) else i
                    alive[loser] = False
                    if loser == i:
                        break
            active = [j for j in active if alive[j]]
    return [r for i, r in enumerate(ranked) if alive[i]]


def settled(findings: DataFrame, file: tuple[str, ...] = ("repo_index", "location")) -> DataFrame:
    """:func:`drop_contained` and :func:`subsume_rows` for findings whose rows of a file follow one another, as a scan gives
    them: without an exchange, so also on a stream. Python sees the columns that decide and returns places."""

    def kept(run: pa.Table) -> pa.Table:
        if run.num_rows == 1:
            return run
        rows = run.select(_READ).to_pylist()
        for i, r in enumerate(rows):
            r["_at"] = i
        return run.take(pa.array([r["_at"] for r in subsume_rows(drop_contained(rows))], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in file), strict=True))
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            done = []
            for at, until in zip(starts, [*starts[1:], len(names)], strict=True):
                if held and names[at] != name:
                    done.append(kept(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(at, until - at))
                name = names[at]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from kept(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return findings.mapInArrow(run, findings.schema)


def remove_overlapping(findings: DataFrame, group: str | list[str] = "location", start: str = "raw_start", end: str = "raw_end", confidence: str = "confidence") -> DataFrame:
    """:func:`drop_contained` with window functions only: for each confidence level the furthest end reached by earlier
    starts, and the furthest end among equal starts."""
    keys = [group] if isinstance(group, str) else group
    earlier = Window.partitionBy(*keys).orderBy(start).rangeBetween(Window.unboundedPreceding, -1)
    together = Window.partitionBy(*keys, start)
    contained = F.lit(False)
    for level in range(INFO, CRITICAL + 1):
        far = F.when(F.col(confidence) >= level, F.col(end))
        reached = (F.max(far).over(earlier) >= F.col(end)) | (F.max(far).over(together) > F.col(end))
        contained = contained | ((F.col(confidence) == level) & F.coalesce(reached, F.lit(False)))
    return findings.withColumn("_contained", contained).where("not _contained").drop("_contained")


def span_column() -> Column:
    return (
        F.when(F.col("raw_end") > F.col("raw_start"), F.col("raw_end") - F.col("raw_start"))
        .when(F.col("end_line") > F.col("start_line"), 100 * (F.col("end_line") - F.col("start_line") + 1))
        .when(F.col("end_char") > F.col("start_char"), F.col("end_char") - F.col("start_char"))
        .otherwise(F.coalesce(F.octet_length("source"), F.lit(0)))
    )


def file_order() -> list[Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("raw_start"), span_column().desc(), F.col("confidence").desc(), F.col("start_line"), F.col("start_char"), text("provider_id"), text("headline"), text("source")]


def canonical_order() -> list[Column]:
    """Across files: location, repository, then the order within a file."""
    return [F.coalesce(F.col("location"), F.lit("")), F.col("repo_index"), *file_order()]


#: What the rules of subsumption read.
_READ = ("raw_start", "raw_end", "start_line", "end_line", "start_char", "end_char", "confidence", "provider_id", "headline", "source")


def subsume(findings: DataFrame, group: str | list[str] = "location") -> DataFrame:
    """:func:`subsume_rows` for stored findings, file by file. A file's findings come together in one row (contained ones
    are best removed first, which leaves few); Python sees only the columns that decide and returns places."""

    @F.arrow_udf("array<int>")
    def kept(groups: pa.Array) -> pa.Array:
        out = []
        for rows in groups.to_pylist():
            for i, r in enumerate(rows):
                r["_at"] = i
            out.append([r["_at"] for r in subsume_rows(rows)])
        return pa.array(out, pa.list_(pa.int32()))

    rows = F.collect_list(F.struct(*findings.columns)).alias("rows")
    gathered = findings.groupBy(*[F.col(c).alias(f"_{c}") for c in ([group] if isinstance(group, str) else group)]).agg(rows)
    narrow = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in _READ]))
    one = gathered.withColumn("kept", kept(narrow))
    return one.select(F.inline(F.transform("kept", lambda i: F.get("rows", i))))
