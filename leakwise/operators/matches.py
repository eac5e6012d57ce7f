"""Findings of plain patterns with built-in functions only.

``split`` and ``regexp_extract_all`` give the texts between and of the matches; their lengths add up to the offsets. For
patterns that mean the same in Java's and RE2's dialects this needs no Python; the full finders are in ``finders``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PatternRule:
    id: str
    pattern: str
    confidence: int
    #: A literal that every match holds; looked for first.
    needs: str = ""


#: Running sums go block by block, so that a text with very many matches doesn't cost their square.
BLOCK = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(array: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of longs, ``step`` folded from 0 over all places before it."""
    zero = F.lit(0).cast("long")
    fold = lambda numbers, at, n: F.aggregate(F.slice(numbers, at + 1, n), zero, step)
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def by_blocks(numbers: Column) -> Column:
        blocks = F.sequence(F.lit(0), block(F.size(numbers)))
        sums = F.transform(blocks, lambda b: fold(numbers, b * BLOCK, F.lit(BLOCK)))
        heads = _let(sums, lambda s: F.transform(s, lambda _, i: fold(s, F.lit(0), i)))
        return _let(heads, lambda h: F.transform(numbers, lambda _, i: step(F.get(h, block(i)), fold(numbers, block(i) * BLOCK, i % BLOCK))))

    return _let(array, by_blocks)


def _line_end(text: Column) -> Column:
    """The offset after the last line break of a text, 0 without one."""
    return F.when(text.contains("\n"), F.octet_length(text) - F.octet_length(F.substring_index(text, "\n", -1))).otherwise(0).cast("long")


def _pieces(text: Column, rule: PatternRule) -> Column:
    """The matches of a rule in order, each with the text between it and the one before: (gap, hit)."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = _let(hits, lambda h: F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(h)), h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit"))))
    there = text.rlike(rule.pattern) if not rule.needs else text.contains(rule.needs) & text.rlike(rule.pattern)
    return F.when(there, pieces).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _placed(rule: Column) -> Column:
    """The matches of (rule, confidence, pieces) with their offsets and places."""
    pieces = rule["pieces"]
    whole = F.transform(pieces, lambda x: F.concat(x["gap"], x["hit"]))
    breaks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long")
    add = lambda a, b: a + b
    starts = _before(F.transform(whole, lambda t: F.octet_length(t).cast("long")), add)

    def rows(s: Column) -> Column:
        ends = F.zip_with(s, whole, lambda at, t: F.when(t.contains("\n"), at + _line_end(t)).otherwise(F.lit(0).cast("long")))
        lines, last = _before(F.transform(whole, breaks), add), _before(ends, lambda a, b: F.greatest(a, b))
        return F.transform(F.arrays_zip(pieces.alias("piece"), s.alias("start"), lines.alias("lines"), last.alias("last")), row)

    def row(r: Column) -> Column:
        gap, hit = r["piece"]["gap"], r["piece"]["hit"]
        at = r["start"] + F.octet_length(gap)
        line_start = F.when(gap.contains("\n"), r["start"] + _line_end(gap)).otherwise(r["last"])
        return F.struct(
            rule["rule"].alias("rule"), rule["confidence"].alias("confidence"), hit.alias("value"), at.alias("raw_start"), (at + F.octet_length(hit)).alias("raw_end"),
            (r["lines"] + breaks(gap)).alias("start_line"), (at - line_start).alias("start_char"),
        )

    return _let(starts, rows)


def pattern_findings(files: DataFrame, rules: tuple[PatternRule, ...], keep: tuple[str, ...], text: str = "text", positions: bool = True) -> DataFrame:
    """A row per match: the ``keep`` columns, rule, confidence, value, raw_start, raw_end and the start's position.

    One pass over the texts for all rules; offsets are worked out per text, and only the matches go on from there.
    """
    found = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.confidence).alias("confidence"), _pieces(F.col(text), r).alias("pieces")) for r in rules])
    found = F.flatten(F.transform(F.filter(found, lambda r: F.size(r["pieces"]) > 0), _placed))
    rows = files.where(F.col(text).isNotNull()).select(*keep, F.inline(found))
    return rows if positions else rows.drop("start_line", "start_char")
