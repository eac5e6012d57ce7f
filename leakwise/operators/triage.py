"""Hooks for external functions over findings: triage by a model, and report transformers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from ipaddress import ip_address
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwise.functions.text import redacted


#: Names of hosts on this machine (fixed values).
LOCAL_NAMES = ("localhost", "host.docker.internal", "ollama")


def is_local(endpoint: str) -> bool:
    """Whether a URL points to a local name or a loopback, private or link-local address."""
    host = urlparse(endpoint).hostname or ""
    try:
        address = ip_address(host)
    except ValueError:
        return host in LOCAL_NAMES
    return address.is_loopback or address.is_private or address.is_link_local


def triage_input(findings: DataFrame, endpoint: str, allow_raw: bool = False) -> DataFrame:
    """Findings with the text that may be shown to the model: the raw value only if it is allowed and the endpoint is on
    this machine, else the redacted one."""
    raw = allow_raw and is_local(endpoint)
    shown = F.col("value") if raw else redacted(F.col("value"))
    return findings.withColumns({"shown": shown, "prompt_mode": F.lit("RAW_VALUE" if raw else "REDACTED")})


def triage(findings: DataFrame, ask: Callable[[dict], dict], columns: list[str], key: str = "finding_id") -> DataFrame:
    """``ai_annotation`` (JSON) for each finding; ``ask`` is the client. A failed call leaves null and the scan goes on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            notes = []
            for row in frame[columns].to_dict("records"):
                try:
                    notes.append(json.dumps(ask(row), sort_keys=True))
                except Exception:  # an external service may fail for any row
                    notes.append(None)
            yield pd.DataFrame({key: frame[key], "ai_annotation": notes})

    kind = findings.schema[key].dataType.simpleString()
    return findings.select(key, *columns).mapInPandas(run, f"{key} {kind}, ai_annotation string")


def transform_report(findings: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A report plugin: batches in, batches of the same shape out; a batch whose transformation fails stays as it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                yield transform(frame.copy())[list(frame.columns)]
            except Exception:  # a plugin's failure means no change
                yield frame

    return findings.mapInPandas(run, findings.schema)


def unannotated(findings: DataFrame) -> DataFrame:
    return findings.where("ai_annotation is null")
