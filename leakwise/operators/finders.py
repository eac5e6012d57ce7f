"""Generators: from a file's text to its findings, with offsets.

No built-in Spark function gives the offsets of all matches, so one Arrow function runs the patterns of a file's class and
gives raw matches. Evidence, highlight, hashes and exclusions are columns (:mod:`leakwise.operators.evidence`), containment and
subsumption are operators over the findings (:mod:`leakwise.operators.overlap`).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leakwise.operators import overlap, prefilter
from leakwise.operators.evidence import with_evidence, with_hash
from leakwise.operators.matching import Exclusions, value_excluded
from leakwise.rules import patterns as p
from leakwise.schema import FINDING

_SPACE = re.compile(p.WS)
_CLASS_OF = {e: k for k, es in p.CLASS_EXTENSIONS.items() for e in es}


def class_of(extension: str) -> str:
    return _CLASS_OF.get(extension.lower(), "default")


@dataclass(frozen=True)
class FinderOptions:
    rules: tuple[p.VendorRule, ...] = field(default_factory=p.vendor_rules)
    exclusions: Exclusions = Exclusions()
    checksum: bool = True
    show_source: bool = True
    prefilter: bool = True
    #: Remove contained and subsumed findings of each file.
    fused: bool = True


class Text:
    """A text with its UTF-8 byte offsets and lines."""

    def __init__(self, text: str) -> None:
        self.text = text
        if text.isascii():
            self.bytes_at = None
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.bytes_at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        self.breaks = [self.byte(m.start()) for m in re.finditer("\n", text)]

    def byte(self, at: int) -> int:
        return at if self.bytes_at is None else int(self.bytes_at[min(max(at, 0), len(self.bytes_at) - 1)]) + min(at, 0)

    def position(self, offset: int) -> tuple[int, int]:
        """(line, byte in line); an offset on a line break belongs to the line that it ends."""
        line = bisect.bisect_left(self.breaks, offset)
        return line, offset - (self.breaks[line - 1] + 1 if line else 0)


class Finder:
    """The matchers of one scan, used for file after file. They say where something matches and nothing about its worth."""

    def __init__(self, options: FinderOptions) -> None:
        self.o = options
        self.patterns = p.finder_patterns()
        self.filter = prefilter.RuleFilter([r.pattern for r in options.rules])

    def matches(self, text: str, file_class: str) -> Iterator[tuple]:
        """Raw matches in the columns of ``MATCH`` from ``provider_id`` on."""
        t = Text(text)
        folded = prefilter.folded(text)
        for rule in self._rules(folded):
            if rule.emits:
                yield from self._strings(t, text, 0, (m.span() for m in rule.regex.finditer(text)), rule.id)
        if file_class == "xml":
            yield from self._xml(t)
        else:
            named, quotes = prefilter.may_name_secret(folded), any(q in text for q in "\"'`")
            for key in p.CLASSES[file_class]:
                if key not in p.ASSIGNMENTS:
                    if quotes or not self.o.prefilter:
                        yield from self._strings(t, text, 0, p.spans(key, text), p.PROVIDERS[key])
                elif not self.o.prefilter or named and p.NEEDS.get(key, "") in text:
                    yield from self._assignments(t, text, 0, self.patterns[key], p.PROVIDERS[key])

    def _rules(self, folded: str) -> list[p.VendorRule]:
        """The rules that may match a text, in their order."""
        return [self.o.rules[i] for i in self.filter.candidates(folded)] if self.o.prefilter else list(self.o.rules)

    @staticmethod
    def _row(t: Text, provider: str, shape: str, variable: str | None, source: str, matched: str | None, raw: str, front: int, start: int, end: int) -> tuple:
        places = [t.position(x) for x in (start, end, start - 1)]
        return (provider, shape, variable, source, matched, raw, front, start, end, *(x for place in places for x in place))

    def _assignments(self, t: Text, text: str, base: int, pattern: re.Pattern, provider: str) -> Iterator[tuple]:
        for m in pattern.finditer(text):
            variable = m[1].lower().strip()
            if not _SPACE.search(variable):
                start, end, right = m.start(1), m.end(), m.start(2)
                yield self._row(t, provider, "assignment", variable, text[max(0, start - 1) : end], text[start:end], text[right:end], right - start, t.byte(base + start), t.byte(base + end))

    def _strings(self, t: Text, text: str, base: int, spans: Iterable[tuple[int, int]], provider: str) -> Iterator[tuple]:
        for start, end in spans:
            source = text[start:end]
            if not _SPACE.search(source):
                yield self._row(t, provider, "string", None, source, source, source, 0, t.byte(base + start), t.byte(base + end))

    # -- markup ------------------------------------------------------------------------------------------------------

    def _xml_strings(self, t: Text, text: str, base: int) -> Iterator[tuple]:
        if text.strip():
            named = not self.o.prefilter or prefilter.may_name_secret(prefilter.folded(text))
            for key, provider in p.XML_STRINGS:
                if key not in p.ASSIGNMENTS:
                    yield from self._strings(t, text, base, p.spans(key, text), provider)
                elif not self.o.prefilter or named and p.NEEDS.get(key, "") in text:
                    yield from self._assignments(t, text, base, self.patterns[key], provider)

    def _xml_assignment(self, t: Text, name: str, raw: str, at: int, element: bool) -> Iterator[tuple]:
        if not _NAME.search(name.lower()):
            yield from self._xml_strings(t, raw, at)
            return
        end = at - 1 + len(raw) + (0 if element else len(name) + 3)
        provider = "ElementSecretAssignment" if element else "AttributeSecretAssignment"
        yield self._row(t, provider, "element" if element else "attribute", name.lower(), t.text[max(0, at - 1) : end + 1], None, raw, 0, t.byte(at), t.byte(end))

    def _xml(self, t: Text) -> Iterator[tuple]:
        open_: list[str] = []
        for m in _MARKUP.finditer(t.text):
            kind = "open" if m["open"] else m.lastgroup
            body = m[kind]
            if kind in ("comment", "cdata"):
                yield from self._xml_strings(t, body, m.start(kind))
            elif kind == "close" and open_:
                open_.pop()
            elif kind == "open":
                open_.append(body.rpartition(":")[2])
                for a in _ATTRIBUTE.finditer(m["attributes"]):
                    at = m.start("attributes") + m["attributes"].index(a["name"])
                    yield from self._xml_assignment(t, a["name"].rpartition(":")[2], a["double"] or a["single"] or a["bare"] or "", at, False)
                if m["attributes"].endswith("/"):
                    open_.pop()
            elif kind == "chars" and open_ and body.strip():
                yield from self._xml_assignment(t, open_[-1], body, m.start(kind), True)


_NAME = re.compile(p.secret_name())
_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[?!](?P<other>[^>]*)>|</(?P<close>[^>]*)>"
    r"|<(?P<open>[A-Za-z_][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<chars>[^<]+)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?P<name>[^\s=/\"'<>]+)\s*=\s*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<bare>[^\s\"'>]+))")


#: A raw match: where it lies, what it consists of, and the places of its start, its end and the byte before it.
MATCH = (
    "repo_index int, location string, provider_id string, shape string, variable string, source string, matched string, raw string, front int, "
    "raw_start long, raw_end long, start_line long, start_char long, end_line long, end_char long, before_line long, before_char long"
)
#: The columns of a finding, in order.
COLUMNS = tuple(c.split()[0] for c in re.sub(r"<.*?>>?", "", FINDING).split(", "))
#: Matches that go to Spark at once.
AT_ONCE = 4096


def raw_matches(files: DataFrame, options: FinderOptions | None = None, text: str = "text", path: str = "path", file_class: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All matches of ``files`` (repo_index, path, text, and the columns ``keep``, which go along) in the shape of ``MATCH``.

    The class of a file follows from its extension, or is the column ``file_class``. Null texts give nothing.
    """
    o = options or FinderOptions()
    kinds = F.lit("default")
    if file_class:
        kinds = F.col(file_class)
    else:
        extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
        for name, extensions in p.CLASS_EXTENSIONS.items():
            kinds = F.when(extension.isin(*extensions), name).otherwise(kinds)
    kept = files.select(*keep).schema
    rows = files.select(F.col("repo_index").cast("int"), F.col(path).alias("path"), kinds.alias("kind"), F.col(text).alias("text"), *keep)
    shape = StructType([*StructType.fromDDL(MATCH).fields, *kept.fields])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, found = Finder(o), []
        for batch in batches:
            more = batch.columns[4:]
            for i, (index, where, kind, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if body:
                    extra = tuple(c[i].as_py() for c in more)
                    for m in finder.matches(body, kind):
                        found.append((index, where, *m, *extra))
                        if len(found) == AT_ONCE:
                            yield _record_batch(found, arrow)
                            found = []
        if found:
            yield _record_batch(found, arrow)

    return rows.where(F.col("text") != "").mapInArrow(run, shape)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def judged(matches: DataFrame, options: FinderOptions | None = None) -> DataFrame:
    """Findings of raw matches: without excluded sources and hashes, with evidence, highlight and hash; tags are empty."""
    o = options or FinderOptions()
    e = o.exclusions
    left = matches.where(F.col("shape").isin("element", "attribute") | ~value_excluded(F.col("source"), e)) if e.values or e.value_patterns else matches
    found = with_hash(with_evidence(left, o.rules), o.checksum).withColumn("excluded", value_excluded(F.col("value"), e))
    if e.hashes and o.checksum:
        found = found.where(~F.col("sha256").isin(*e.hashes))
    source = F.col("source") if o.show_source else F.lit(None).cast("string")
    more = [c for c in matches.columns if c not in StructType.fromDDL(MATCH).names]
    return found.withColumns({"source": source, "tags": F.array().cast("array<string>")}).select(*COLUMNS, *more)


def find_secrets(files: DataFrame, options: FinderOptions | None = None, text: str = "text", path: str = "path", file_class: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of ``files``: one row each, in the shape of ``FINDING`` and the columns ``keep``.

    Python says where the patterns match; what a match is worth is worked out by columns. A file's findings follow one
    another then, so contained and subsumed ones go without an exchange; with ``fused=False`` they are left to the operators
    ``remove_overlapping`` and ``subsume``, which give the same.
    """
    o = options or FinderOptions()
    found = judged(raw_matches(files, o, text, path, file_class, keep), o)
    return overlap.settled(found) if o.fused else found
