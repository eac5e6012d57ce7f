"""What is never reported, and patterns as filters of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exclusions:
    """What is never reported. Regexes that don't compile are dropped."""

    values: tuple[str, ...] = ()
    value_patterns: tuple[str, ...] = ()
    hashes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    path_values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    path_hashes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    path_pattern_values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Prefixes of checkouts, taken off before a path is compared.
    repositories: tuple[str, ...] = ()


def valid_patterns(patterns: tuple[str, ...]) -> list[str]:
    out = []
    for x in patterns:
        try:
            re.compile(x)
            out.append(x)
        except re.error:
            pass
    return out


def any_match(col: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """One alternation of all patterns that compile, unanchored; false if there are none."""
    good = valid_patterns(tuple(patterns))
    return F.coalesce(col.rlike("|".join(f"(?:{x})" for x in good)), F.lit(False)) if good else F.lit(False)


def value_excluded(value: Column, e: Exclusions) -> Column:
    return F.coalesce(value.isin(*e.values), F.lit(False)) | any_match(value, e.value_patterns) if e.values else any_match(value, e.value_patterns)
