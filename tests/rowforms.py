"""Plain row by row forms of what the library does with columns, to compare it with."""

import hashlib
import re
from functools import cache

from leakwise.operators.finders import Finder, FinderOptions, Text
from leakwise.operators.matching import valid_patterns
from leakwise.operators.overlap import drop_contained, order_in_file, overlaps, span
from leakwise.rules import patterns as p
from leakwise.schema import CRITICAL, HIGH, INFO, LOW, MEDIUM

_COMMON = re.compile("|".join(p.COMMON), re.I)
_HEX = re.compile(p.HEX)
_SPACE = re.compile(p.WS)


@cache
def connectors() -> list[tuple[re.Pattern, str]]:
    """Longest key first, then by name."""
    keys = sorted(p.CONNECTORS, key=lambda k: (-len(k), k))
    return [(re.compile(k), p.CONNECTORS[k]) for k in keys]


def connection_name(value: str) -> str:
    for pattern, name in connectors():
        if pattern.search(value):
            return f"{name} {p.CONNECTION}"
    return p.CONNECTION


def classify(value: str, rules) -> tuple[str, int]:
    """(description, confidence) of the evidence for a value."""
    low = value.lower()
    for rule in rules:
        if rule.regex.search(low):
            if rule.id == p.CONNECTION:
                return connection_name(low), HIGH
            return rule.id, CRITICAL if rule.id in p.VENDOR_CRITICAL else HIGH
    if not value or _SPACE.search(value) or value.isdigit() or low in ("true", "false", "null", "none") or value[0] in p.UNUSUAL_START:
        return p.NOT_SECRET, HIGH
    if _COMMON.search(value):
        return p.COMMON_CREDENTIAL, MEDIUM
    upper, lower, digit = (any(map(f, value)) for f in (str.isupper, str.islower, str.isdigit))
    if upper and lower and digit and len(value) >= p.MIN_LENGTH:
        return p.HIGH_ENTROPY, MEDIUM
    if _HEX.search(value) or p.has_base64(value):
        return p.ENCODED, HIGH
    if digit and (upper or lower) and len(value) >= p.MIN_LENGTH:
        return p.SUSPICIOUS, INFO
    return p.NOT_SECRET, LOW


def trim_quotes(text: str) -> tuple[str, int]:
    """The text without white space and balanced quotes, and how many quote characters went at its front."""
    out, count = text.strip(), 0
    for q in "`'\"":
        if len(out) > 1 and out[0] == q == out[-1]:
            out, count = out[1:-1], count + 1
    if len(out) > 3 and out.startswith('""') and out.endswith('""'):
        out, count = out[2:-2], count + 2
    return out, count


def subsume_rows(rows: list[dict]) -> list[dict]:
    """All pairs of a file."""
    ranked = sorted(rows, key=order_in_file)
    alive = [True] * len(ranked)
    weight = [(r["confidence"], span(r)) for r in ranked]
    for i, r in enumerate(ranked):
        for j in range(len(ranked)):
            if not alive[i]:
                break
            if i != j and alive[j] and overlaps(r, ranked[j]):
                loser = j if (weight[i], -i) > (weight[j], -j) else i
                alive[loser] = False
    return [r for i, r in enumerate(ranked) if alive[i]]


def scan(text: str, kind: str, **options) -> list[dict]:
    """The findings of a text."""
    o = FinderOptions(**options)
    e, t, out = o.exclusions, Text(text), []
    patterns = [re.compile(x) for x in valid_patterns(e.value_patterns)]
    excluded = lambda v: v in e.values or any(x.search(v) for x in patterns)
    for provider, shape, variable, source, _, raw, front, start, end, *places in Finder(o).matches(text, kind):
        markup = shape in ("element", "attribute")
        if not markup and excluded(source):
            continue
        value, quotes = trim_quotes(raw)
        value = value.strip() if markup else value
        if shape == "element" and not value:
            continue
        evidence = (p.HARD_CODED, HIGH) if shape != "string" and "passphrase" in variable else classify(value, o.rules)
        if not markup and evidence == (p.NOT_SECRET, HIGH):
            continue
        if shape != "string":
            headline = (p.SECRET_ASSIGNMENT, HIGH if evidence[1] > LOW and evidence[0] != p.NOT_SECRET else MEDIUM)
            reasons = [(p.NAME_IS_SECRET, HIGH), evidence]
        else:
            reasons = [evidence, (p.UNBROKEN, MEDIUM)] if evidence[1] > MEDIUM else [(p.UNBROKEN, MEDIUM), evidence]
            headline = (p.UNBROKEN, evidence[1]) if reasons[0][0] == p.UNBROKEN and evidence[1] < MEDIUM else reasons[0]
        checksum = hashlib.sha256(value.encode()).hexdigest() if o.checksum else None
        if checksum in e.hashes:
            continue
        first = len(text.encode()[:start].decode()) + front + quotes
        marks = (places[0:2], places[2:4]) if markup else (t.position(t.byte(first) - 1), t.position(t.byte(first + len(value)) - 1))
        out.append({
            "provider_id": provider, "headline": headline[0], "confidence": headline[1], "reasons": [{"description": d, "confidence": c} for d, c in reasons],
            "start_line": places[0], "start_char": places[1], "end_line": places[2], "end_char": places[3],
            "highlight_start_line": marks[0][0], "highlight_start_char": marks[0][1], "highlight_end_line": marks[1][0], "highlight_end_char": marks[1][1],
            "raw_start": start, "raw_end": end, "source": source if o.show_source else None, "value": value, "sha256": checksum, "excluded": excluded(value),
        })
    return subsume_rows(drop_contained(out)) if o.fused else out
