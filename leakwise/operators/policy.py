"""Suppression policies and exception records: pure functions and append-only logs."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.operators.exclusions import merge_exclusions, with_expiry
from leakwise.operators.finders import Exclusions
from leakwise.operators.history import latest_by

HERE, HASH_HERE, EVERYWHERE, HASH_EVERYWHERE, FILE = "ignore_here", "ignore_sha2_here", "ignore_everywhere", "ignore_sha2_everywhere", "ignore_file"


def update_policy(policy: Exclusions, what: str, location: str, value: str | None = None, checksum: str | None = None) -> Exclusions:
    """The policy with one more thing ignored. Values are taken literally; unknown requests change nothing."""
    for prefix in policy.repositories:
        location = location.removeprefix(prefix)
    add = {
        HERE: lambda: Exclusions(path_values={location: (value,)}) if value else Exclusions(),
        HASH_HERE: lambda: Exclusions(path_hashes={location: (checksum,)}) if checksum else Exclusions(),
        EVERYWHERE: lambda: Exclusions(values=(value,)) if value else Exclusions(),
        HASH_EVERYWHERE: lambda: Exclusions(hashes=(checksum,)) if checksum else Exclusions(),
        FILE: lambda: Exclusions(paths=(f".*{_quoted(location)}",)),
    }.get(what)
    return merge_exclusions(policy, add()) if add else policy


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()|[]{}^$" else c for c in text)


def policy_to_json(policy: Exclusions) -> str:
    return json.dumps(asdict(policy), sort_keys=True)


def policy_from_json(text: str) -> Exclusions:
    plain = json.loads(text)
    fixed = {k: {p: tuple(x) for p, x in v.items()} if isinstance(v, dict) else tuple(v) for k, v in plain.items()}
    return replace(Exclusions(), **fixed)


def current_exceptions(log: DataFrame, now: Column, soft: bool = False) -> DataFrame:
    """The latest version of each exception in an append-only log (id, version, action, ...); deleted ones are gone, or
    stay with the status revoked (``soft``). Active ones whose time is up are expired."""
    last = latest_by(log, ["id"], [F.col("version").desc()])
    if soft:
        last = last.withColumn("status", F.when(F.col("action") == "delete", "revoked").otherwise(F.col("status")))
    else:
        last = last.where("action <> 'delete'")
    return with_expiry(last, now)


def audit_trail(log: DataFrame) -> DataFrame:
    """exception -> its events in the order of time."""
    event = F.struct("time", "actor", "action", "details")
    return log.groupBy("exception_id").agg(F.sort_array(F.collect_list(event)).alias("audit"))


def invalid_exceptions(exceptions: DataFrame) -> DataFrame:
    """Exceptions that lack what their type needs: (id, problem)."""
    need = {
        "globalHash": "secret_checksum", "value": "secret_checksum", "globalString": "string_match", "globalRegex": "regex_match", "pathRegex": "path",
        "pathString": "path", "pathHash": "path", "pathRegexRegex": "path", "directory": "path", "file": "path", "line": "path",
    }
    problem = F.lit("unknown type")
    for kind, column in [*need.items(), ("global", None), ("project", None)]:
        missing = F.lit(None).cast("string") if column is None else F.when(F.coalesce(F.col(column), F.lit("")) == "", f"{column} is missing")
        problem = F.when(F.col("type") == kind, missing).otherwise(problem)
    return exceptions.select("id", problem.alias("problem")).where("problem is not null")


def export_exceptions(exceptions: DataFrame, path: str) -> None:
    exceptions.coalesce(1).write.mode("overwrite").json(path)


def import_exceptions(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
