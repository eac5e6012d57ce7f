"""From raw matches to findings: evidence, headline, highlight and hash, all as columns.

The classification profile ("golden21") is reconstructed from known findings: vendor rules first (in order, first match
wins, over the lower-cased value), then values that are no secrets, common credentials, values that mix cases and digits,
encoded values, and suspicious ones. Where the known findings say nothing it is a documented choice, not a parity claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.functions.text import TRIM, let, trim_quotes, value_hash
from leakwise.rules import patterns as p
from leakwise.schema import CRITICAL, HIGH, INFO, LOW, MEDIUM


def java_pattern(pattern: str) -> str:
    """A pattern of Python's dialect in Java's: names of groups, the end of the text, and brackets within classes, which
    would nest there."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[:1] == "\\":
            out.append(r"\z" if two == r"\Z" else two)
            i += 2
            continue
        c = pattern[i]
        if inside and (c == "[" or two == "&&"):
            out.append("\\" + c)
        elif not inside and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif not inside and pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        else:
            out.append(c)
        if not inside and c == "[":
            inside = True
            for first in ("^", "]"):  # a bracket that comes first is a member
                if pattern.startswith(first, i + 1):
                    i += 1
                    out.append("\\]" if first == "]" else first)
        elif inside and c == "]":
            inside = False
        i += 1
    return "".join(out)


def _said(description: str | Column, confidence: int | Column) -> Column:
    d = F.lit(description) if isinstance(description, str) else description
    return F.struct(d.alias("description"), (F.lit(confidence) if isinstance(confidence, int) else confidence).cast("int").alias("confidence"))


def connection_name(value: Column) -> Column:
    """The kind of server of a connection string; the longest key comes first, then by name."""
    out = F.lit(p.CONNECTION)
    for key in reversed(sorted(p.CONNECTORS, key=lambda k: (-len(k), k))):
        out = F.when(value.rlike(key), f"{p.CONNECTORS[key]} {p.CONNECTION}").otherwise(out)
    return out


#: A run of base64 characters up to an equals sign with a digit that eight of them follow. This is where the encoded form
#: matches, and it costs linear time: a run is looked at from its start only.
BASE64 = r"(?<![a-zA-Z0-9+/])(?=[a-zA-Z0-9+/]{9,}+=)[a-zA-Z+/]*+[0-9][a-zA-Z0-9+/]{8}"


def classified(value: Column, rules: tuple[p.VendorRule, ...]) -> Column:
    """(description, confidence) of the evidence for a value."""
    low = F.lower(value)
    has = lambda kind: value.rlike(kind)
    upper, lower, digit = has(r"\p{IsUppercase}"), has(r"\p{IsLowercase}"), has(r"\p{Nd}")
    long = F.length(value) >= p.MIN_LENGTH
    empty = (value == "") | has(p.WS) | has(r"^\p{Nd}+\z") | low.isin("true", "false", "null", "none") | F.substring(value, 1, 1).isin(*p.UNUSUAL_START)
    encoded = has(p.HEX) | value.contains("=") & has(BASE64)
    out = F.when(empty, _said(p.NOT_SECRET, HIGH))
    out = out.when(has("(?i:" + "|".join(p.COMMON) + ")"), _said(p.COMMON_CREDENTIAL, MEDIUM))
    out = out.when(upper & lower & digit & long, _said(p.HIGH_ENTROPY, MEDIUM)).when(encoded, _said(p.ENCODED, HIGH))
    out = out.when(digit & (upper | lower) & long, _said(p.SUSPICIOUS, INFO)).otherwise(_said(p.NOT_SECRET, LOW))
    # the first rule that matches: its place in a list, so that the names are written once
    if rules:
        places = F.array(*[F.when(low.rlike(java_pattern(r.pattern)), F.lit(i)) for i, r in enumerate(rules)])
        named = [_said(connection_name(low), HIGH) if r.id == p.CONNECTION else _said(r.id, CRITICAL if r.id in p.VENDOR_CRITICAL else HIGH) for r in rules]
        out = F.coalesce(F.get(F.array(*named), F.array_min(places)), out)
    return out


def _newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def _place(before: Column) -> Column:
    """(line, byte in line) of the last byte of ``before``, the text from the start of a match on."""

    def place(t: Column) -> Column:
        inner = F.substring(t, F.lit(1), F.length(t) - 1)
        at = F.octet_length(t).cast("long") - 1
        line_start = F.octet_length(t) - F.octet_length(F.substring_index(inner, "\n", -1)) - F.octet_length(F.substring(t, -1, 1))
        line = F.when(t == "", F.col("before_line")).otherwise(F.col("start_line") + _newlines(inner))
        char = F.when(t == "", F.col("before_char")).when(inner.contains("\n"), at - line_start).otherwise(F.col("start_char") + at)
        return F.struct(line.cast("long").alias("line"), char.cast("long").alias("char"))

    return let(before, place)


def _markup() -> Column:
    return F.col("shape").isin("element", "attribute")


def _marks(value: Column) -> tuple[Column, Column]:
    """The highlight of a value: from the byte before it to its last byte; markup is highlighted as a whole."""
    quotes = ((F.length(F.btrim("raw", F.lit(TRIM))) - F.length(value)) / 2).cast("int")
    first = F.col("front") + quotes
    place = lambda line, char: F.struct(F.col(line).alias("line"), F.col(char).alias("char"))
    start = F.when(_markup(), place("start_line", "start_char")).otherwise(_place(F.substring(F.col("matched"), F.lit(1), first)))
    end = F.when(_markup(), place("end_line", "end_char")).otherwise(_place(F.substring(F.col("matched"), F.lit(1), first + F.length(value))))
    return start, end


def _finding(value: Column, evidence: Column) -> Column:
    """value, headline, confidence, reasons and highlight. An assignment to a secret-like name has its name as the first
    reason. A string has the stronger of its evidence and of being unbroken first, and that is its headline."""
    named, level, what = F.col("shape") != "string", evidence["confidence"], evidence["description"]
    likely = (level > LOW) & (what != p.NOT_SECRET)
    of_name = _said(p.SECRET_ASSIGNMENT, F.when(likely, HIGH).otherwise(MEDIUM))
    of_string = F.when(level > MEDIUM, evidence).otherwise(_said(p.UNBROKEN, F.least(level, F.lit(MEDIUM))))
    unbroken = _said(p.UNBROKEN, MEDIUM)
    reasons = F.when(named, F.array(_said(p.NAME_IS_SECRET, HIGH), evidence)).when(level > MEDIUM, F.array(evidence, unbroken)).otherwise(F.array(unbroken, evidence))
    start, end = _marks(value)
    head = F.when(named, of_name).otherwise(of_string)
    return F.struct(value.alias("value"), head.alias("head"), reasons.alias("reasons"), start.alias("from"), end.alias("to"), ((what == p.NOT_SECRET) & (level == HIGH)).alias("sure"))


def with_evidence(matches: DataFrame, rules: tuple[p.VendorRule, ...]) -> DataFrame:
    """``matches`` with value, highlight, headline, confidence and reasons; those that are surely no secrets are gone.

    A match becomes an array of no or one finding, so nothing is worked out twice by a filter that moves below it.
    """
    trimmed = trim_quotes(F.col("raw"))
    value = F.when(_markup(), F.btrim(trimmed, F.lit(TRIM))).otherwise(trimmed)
    is_phrase = (F.col("shape") != "string") & F.coalesce(F.col("variable").contains("passphrase"), F.lit(False))

    def judge(v: Column) -> Column:
        return let(F.when(is_phrase, _said(p.HARD_CODED, HIGH)).otherwise(classified(v, rules)), lambda e: _finding(v, e))

    worth = lambda r: F.when(_markup(), (F.col("shape") != "element") | (r["value"] != "")).otherwise(~r["sure"])
    found = F.filter(F.transform(F.array(value), judge), worth)
    one = matches.withColumn("found", F.explode(found))
    marks = {f"highlight_{a}_{b}": F.col(f"found.{c}.{d}") for a, c in (("start", "from"), ("end", "to")) for b, d in (("line", "line"), ("char", "char"))}
    return one.withColumns({"value": F.col("found.value"), "headline": F.col("found.head.description"), "confidence": F.col("found.head.confidence"), "reasons": F.col("found.reasons"), **marks}).drop("found")


def with_hash(findings: DataFrame, checksum: bool) -> DataFrame:
    return findings.withColumn("sha256", value_hash(F.col("value")) if checksum else F.lit(None).cast("string"))
