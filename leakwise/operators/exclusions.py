"""Exclusions and exceptions as filters: value, hash and path lists, and time-bound exceptions with scopes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from leakwise.operators.matching import Exclusions, any_match, valid_patterns, value_excluded

#: Paths that hold no secrets as a rule.
DEFAULT_PATHS = (r".*/(package-lock|npm-shrinkwrap|composer)[.]json", r".*[.](html?|s?css|sass|less)")
COMMON_PATHS = (r".*[.](?i:html?|css)", r".*/[.]git/.*", r".*/(?i:package-lock|npm-shrinkwrap)[.]json", r".*/node_modules/.*", r".*[.]md", r".*[.](?i:lock|xib|storyboard)")


def default_exclusions() -> Exclusions:
    return Exclusions(paths=DEFAULT_PATHS)


def common_exclusions() -> Exclusions:
    return Exclusions(paths=COMMON_PATHS)


def _union(*lists: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for xs in lists for x in xs))


def merge_exclusions(*many: Exclusions, keep_hashes: bool = True) -> Exclusions:
    """Unions that keep the first place of each entry. ``keep_hashes=False`` drops the hash lists (strict parity)."""
    out = Exclusions()
    maps = lambda a, b: {k: _union(a.get(k, ()), b.get(k, ())) for k in _union(tuple(a), tuple(b))}
    for e in many:
        out = Exclusions(
            _union(out.values, e.values), _union(out.value_patterns, e.value_patterns), _union(out.hashes, e.hashes), _union(out.paths, e.paths),
            maps(out.path_values, e.path_values), maps(out.path_hashes, e.path_hashes), maps(out.path_pattern_values, e.path_pattern_values),
            _union(out.repositories, e.repositories),
        )
    return out if keep_hashes else replace(out, hashes=(), path_hashes={})


def local_path(path: Column, repositories: tuple[str, ...]) -> Column:
    """The path without the checkout prefixes, taken off one after the other."""
    for prefix in repositories:
        path = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    return path


def _pairs(left: Column, right: Column, table: dict[str, tuple[str, ...]]) -> Column:
    keys = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in table.items() for v in vs]
    return F.coalesce(F.struct(left.alias("k"), right.alias("v")).isin(*keys), F.lit(False)) if keys else F.lit(False)


def excluded(path: Column, value: Column, e: Exclusions) -> Column:
    """Value or path excluded: global values, values of the file, paths, value patterns, patterns of path and value."""
    local = local_path(path, e.repositories)
    both = [any_match(local, (p,)) & any_match(value, vs) for p, vs in e.path_pattern_values.items()]
    return reduce(Column.__or__, [value_excluded(value, e), _pairs(local, value, e.path_values), any_match(local, e.paths), *both])


def hash_excluded(path: Column, checksum: Column, e: Exclusions) -> Column:
    everywhere = F.coalesce(checksum.isin(*e.hashes), F.lit(False)) if e.hashes else F.lit(False)
    return everywhere | _pairs(local_path(path, e.repositories), checksum, e.path_hashes)


def apply_exclusions(findings: DataFrame, e: Exclusions, path: str = "location", value: str = "value", checksum: str = "sha256") -> DataFrame:
    """Without findings whose path and value, or hash, are excluded. The lists are literals of one filter, so it is
    evaluated where the rows are; for lists that are tables use :func:`exclude_by_table`."""
    gone = excluded(F.col(path), F.coalesce(F.col(value), F.lit("")), e) | hash_excluded(F.col(path), F.col(checksum), e)
    return findings.where(~gone)


def exclude_by_table(findings: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Anti-join with a table of excluded keys; its size decides between a broadcast and a shuffle."""
    return findings.join(table.select(*on).distinct(), on, "left_anti")


def prunable_folder(pattern: str) -> str | None:
    """The folder that a path pattern of the shape ``.../X/.*`` excludes as a whole; None if that can't be proven."""
    body = pattern.removeprefix(".*")
    if body.startswith("/") and body.endswith("/.*"):
        name = body[1:-3].replace("[.]", ".").replace(r"\.", ".")
        if name and all(c.isalnum() or c in "._-/" for c in name):
            return name
    return None


Get = Callable[[str], Column]

# -- exceptions ---------------------------------------------------------------------------------------------------------


def with_expiry(exceptions: DataFrame, now: Column) -> DataFrame:
    """Status as of ``now``: an active exception whose time is up is expired."""
    return exceptions.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def active_exceptions(exceptions: DataFrame, now: Column) -> DataFrame:
    return with_expiry(exceptions, now).where("status = 'active'")


def same_path(location: Column, path: Column) -> Column:
    """Equal, or the location ends in the path and the path starts at a folder boundary."""
    return (location != "") & (path != "") & ((location == path) | (path.startswith("/") & location.endswith(path)))


def _rule_fits(finding: Get, exception: Get) -> Column:
    rule = F.coalesce(exception("rule_id"), F.lit(""))
    return rule.isin("", "*") | (rule == F.coalesce(finding("headline"), F.lit("")))


def _scopes(finding: Get, exception: Get) -> dict[str, Column]:
    """Exception type -> whether its scope covers the finding."""
    text = lambda get, name: F.coalesce(get(name).cast("string"), F.lit(""))
    location, checksum, source = (text(finding, n) for n in ("location", "sha256", "source"))
    path, part, pattern = (text(exception, n) for n in ("path", "string_match", "regex_match"))
    hashed = (checksum != "") & (checksum == text(exception, "secret_checksum"))
    held = (part != "") & source.contains(part)
    here = same_path(location, path)
    on_path = (location != "") & (path != "") & F.rlike(location, path)
    in_source = (pattern != "") & F.rlike(source, pattern)
    line = finding("start_line") + 1
    always = F.lit(True)
    return {
        "globalHash": hashed, "value": hashed, "globalString": held, "globalRegex": (source != "") & in_source, "pathRegex": on_path,
        "pathString": here & held, "pathHash": here & hashed, "pathRegexRegex": on_path & in_source, "global": always, "project": always,
        "directory": (location != "") & (path != "") & location.startswith(path), "file": here,
        "line": here & line.between(exception("line_start"), exception("line_end")),
    }


#: Up to this many exceptions are compiled into one expression, and up to this many are held as literals of a plan; the
#: result doesn't depend on either.
MAX_LITERALS, MAX_HELD = 64, 10_000
#: Types that an equal key finds: a hash, a path or its end, the start of a path. Others have to be tried on each row.
KEYED = ("globalHash", "value", "pathHash", "pathString", "file", "line", "directory")


def _compile(*patterns: str | None) -> bool:
    return len(valid_patterns(tuple(p or "" for p in patterns))) == len(patterns)


def usable_exceptions(active: DataFrame) -> list[Row]:
    """Active exceptions whose patterns compile, in their order."""
    good = [r for r in active.collect() if _compile(r["regex_match"], *([r["path"]] if r["type"] in ("pathRegex", "pathRegexRegex") else []))]
    return sorted(good, key=lambda r: (r["ord"], r["id"]))


def match_exceptions(findings: DataFrame, exceptions: DataFrame, now: Column, max_literals: int = MAX_LITERALS, max_held: int = MAX_HELD) -> DataFrame:
    """``findings`` with suppressed and exception_id: the first active exception, by ``ord``, that covers each row.

    Patterns that don't compile make an exception inert. Up to ``max_held`` active exceptions are literals, and each row is
    judged by itself, in a projection without a join: a few become one expression; more become one array for each type, in
    their order, of which a row takes the first that fits. Beyond that, exceptions are a table: those of ``KEYED`` types meet
    the rows by equal keys (:func:`keyed_hits`), and only the others, whose patterns have to be tried, are held. All forms give
    the same result.
    """
    active = active_exceptions(exceptions, now)
    if len(active.select("id").limit(max_held + 1).collect()) > max_held:
        return _match_many(findings, active, max_held)
    good = usable_exceptions(active)
    if len(good) <= max_literals:
        first = F.lit(None).cast("string")
        for r in reversed(good):
            literal = lambda name, r=r: F.lit(r[name]) if r[name] is not None else F.lit(None).cast("string")
            scope = _scopes(F.col, literal).get(r["type"])
            if scope is not None:
                first = F.when(_rule_fits(F.col, literal) & F.coalesce(scope, F.lit(False)), r["id"]).otherwise(first)
        return findings.withColumn("exception_id", first).withColumn("suppressed", F.col("exception_id").isNotNull())
    return findings.withColumn("exception_id", _first_of(good)["id"]).withColumn("suppressed", F.col("exception_id").isNotNull())


def _first_of(rows: list[Row]) -> Column:
    """The first exception of a list in order that covers a row, as (place, id)."""
    of_type: dict[str, list[tuple[int, Row]]] = {}
    for place, r in enumerate(rows):
        of_type.setdefault(r["type"], []).append((place, r))
    found = [_first_of_type(kind, held) for kind, held in of_type.items() if kind in _scopes(F.col, F.col)]
    return F.array_min(F.array(*found)) if found else F.lit(None).cast(HIT)


#: What decides about a finding.
SUBJECT = ("headline", "location", "sha256", "source", "start_line")


def _match_many(findings: DataFrame, active: DataFrame, max_held: int) -> DataFrame:
    tried = usable_exceptions(active.where(~F.col("type").isin(*KEYED)))
    orders = {r["id"]: r["ord"] for r in tried}
    firsts = [_first_of(tried[at : at + max_held]) for at in range(0, len(tried), max_held)]  # blocks in order: an earlier one wins
    held = F.coalesce(*[f["id"] for f in firsts]) if firsts else F.lit(None).cast("string")
    order = F.try_element_at(F.from_json(F.lit(json.dumps(orders)), "map<string, int>"), held)
    subject = F.sha2(F.to_json(F.struct(*SUBJECT)), 256)
    named = findings.withColumns({"_held": F.when(held.isNotNull(), F.struct(order.alias("ord"), held.alias("id"))), "_subject": subject})
    joined = named.join(keyed_hits(findings.select(*SUBJECT, subject.alias("_subject")), active), "_subject", "left")
    # least() skips nulls, and the order is that of (ord, id)
    return joined.withColumn("exception_id", F.least("_held", "_keyed")["id"]).withColumn("suppressed", F.col("exception_id").isNotNull()).drop("_held", "_keyed", "_subject")


def keyed_hits(subjects: DataFrame, active: DataFrame) -> DataFrame:
    """_subject and _keyed, the first exception of a ``KEYED`` type as (ord, id), of the subjects that have one.

    A hash is its own key. A path covers the locations that end in it at a folder, so a location asks for each of its
    ends; a directory covers those that start with it, so a location asks for its starts of the lengths that exist. What
    meets is judged in full. Both sides are tables: their sizes decide whether one is broadcast.
    """

    @F.arrow_udf("boolean")
    def compiles(patterns: pa.Array) -> pa.Array:
        return pa.array([_compile(p) for p in patterns.to_pylist()], pa.bool_())

    by_hash, by_start = F.col("type").isin("globalHash", "value", "pathHash"), F.col("type") == "directory"
    key = F.when(by_hash, F.concat(F.lit("h"), "secret_checksum")).when(by_start, F.concat(F.lit("d"), "path")).otherwise(F.concat(F.lit("p"), "path"))
    keyed = active.where(F.col("type").isin(*KEYED)).withColumn("_key", key).where("_key is not null")
    keyed = keyed.where(F.col("regex_match").isNull() | compiles(F.coalesce("regex_match", F.lit(""))))
    lengths = [r[0] for r in keyed.where(by_start).select(F.length("path")).distinct().collect()]  # as many as paths have lengths
    location = F.coalesce("location", F.lit(""))
    parts = F.split(location, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("p/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")))
    ends = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>"))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(location)), lambda n: F.concat(F.lit("d"), F.substring(location, F.lit(1), n)))
    own = F.array(F.concat(F.lit("h"), F.coalesce("sha256", F.lit(""))), F.concat(F.lit("p"), location))
    asked = subjects.dropDuplicates(["_subject"]).withColumn("_key", F.explode(F.array_distinct(F.concat(own, ends, starts))))
    fits = F.lit(False)
    for kind, scope in _scopes(F.col, F.col).items():
        if kind in KEYED:
            fits = F.when(F.col("type") == kind, scope).otherwise(fits)
    met = asked.join(keyed, "_key").where(_rule_fits(F.col, F.col) & F.coalesce(fits, F.lit(False)))
    return met.groupBy("_subject").agg(F.min(F.struct("ord", "id")).alias("_keyed"))


HIT = "struct<place:int,id:string>"
_HELD = "place int, id string, rule_id string, path string, line_start int, line_end int, secret_checksum string, string_match string, regex_match string"


def _first_of_type(kind: str, rows: list[tuple[int, Row]]) -> Column:
    """The first exception of a type that covers the row, as (place, id); null without one."""
    names = [x.split()[0] for x in _HELD.split(", ")]
    held = [{n: place if n == "place" else r[n] for n in names} for place, r in rows]
    shape = f"struct<{', '.join(':'.join(x.split()) for x in _HELD.split(', '))}>"
    if kind in ("globalHash", "value", "pathHash"):  # only those of the row's hash
        by_hash: dict[str, list[dict]] = {}
        for x in held:
            by_hash.setdefault(x["secret_checksum"] or "", []).append(x)
        table = F.from_json(F.lit(json.dumps(by_hash)), f"map<string, array<{shape}>>")
        candidates = F.coalesce(F.try_element_at(table, F.coalesce(F.col("sha256"), F.lit(""))), F.array().cast(f"array<{shape}>"))
    else:
        candidates = F.from_json(F.lit(json.dumps(held)), f"array<{shape}>")

    def fits(x: Column) -> Column:
        of_x = lambda name: x[name]
        return _rule_fits(F.col, of_x) & F.coalesce(_scopes(F.col, of_x)[kind], F.lit(False))

    first = F.try_element_at(F.filter(candidates, fits), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["place"].alias("place"), first["id"].alias("id"))).cast(HIT)


def reconcile(findings: DataFrame, exceptions: DataFrame, now: Column) -> DataFrame:
    """A second pass after a scan: findings that an exception covers by now become suppressed; none is released."""
    before = findings.withColumns({"_was": F.col("suppressed"), "_by": F.col("exception_id")})
    again = match_exceptions(before, exceptions, now)
    return again.withColumns({"exception_id": F.when(F.col("_was"), F.col("_by")).otherwise(F.col("exception_id")), "suppressed": F.col("suppressed") | F.col("_was")}).drop("_was", "_by")


def exclusions_from_exceptions(rows: list[dict]) -> Exclusions:
    """The scan-side form of active exceptions: hashes, values (equality) and patterns, everywhere or by path."""
    out = Exclusions()
    for r in rows:
        kind, path = r["type"], r.get("path") or ""
        add = {
            "globalHash": {"hashes": (r.get("secret_checksum"),)}, "value": {"hashes": (r.get("secret_checksum"),)},
            "globalString": {"values": (r.get("string_match"),)}, "globalRegex": {"value_patterns": (r.get("regex_match"),)},
            "pathRegex": {"paths": (path,)}, "pathString": {"path_values": {path: (r.get("string_match"),)}},
            "pathHash": {"path_hashes": {path: (r.get("secret_checksum"),)}}, "pathRegexRegex": {"path_pattern_values": {path: (r.get("regex_match"),)}},
        }.get(kind)
        if add:
            out = merge_exclusions(out, Exclusions(**add))
    return out
