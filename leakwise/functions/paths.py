"""Functions of paths and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """From the last dot on, dot included; empty if a separator comes after it or there is none."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def base_name(path: Column) -> Column:
    """Without folders and without the extension (a name that is only an extension is empty)."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_test_path(path: Column) -> Column:
    """The path holds "test" in any case; the long s folds to s."""
    return F.lower(F.translate(path, "ſ", "s")).contains("test")


def git_to_https(address: Column) -> Column:
    """``git@host:owner/repo.git`` as an https address; other addresses as they are, trimmed."""
    t = F.trim(address)
    host = F.regexp_replace(F.regexp_replace(t, "^(?i:git@)", ""), "^([^:]*):", "$1/")
    return F.when(F.lower(t).startswith("git@"), F.concat(F.lit("https://"), host)).otherwise(t)


def checkout_location(base: Column, repository: Column) -> Column:
    """The folder below ``base`` that a repository is checked out to: its last name without ``.git``."""
    name = F.regexp_replace(F.substring_index(F.regexp_replace(repository, "/+$", ""), "/", -1), r"\.git$", "")
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), name)


def repository_of(location: Column) -> Column:
    """The part up to ``.git`` where a location lies in one, else the location."""
    return F.when(location.contains(".git/"), F.concat(F.substring_index(location, ".git/", 1), F.lit(".git"))).otherwise(location)


def under_pruned_folder(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path (not its file name) has one of these names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)).cast("array<string>"))


def short_location(location: Column, limit: int = 50) -> Column:
    """Locations over ``limit`` characters as their first and last two names; as both ends around three dots where that
    is still too long or there are four names at most."""
    half = (limit - 3) // 2
    ends = lambda c: F.concat(F.substring(c, 1, half), F.lit("..."), F.substring(c, F.length(c) - (half - 1), F.lit(half)))
    parts = F.split(location, "/")
    outer = F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/.../"), F.array_join(F.slice(parts, -2, 2), "/"))
    few = F.size(parts) <= 4
    return F.when(F.length(location) <= limit, location).when(few, ends(location)).when(F.length(outer) > limit, ends(outer)).otherwise(outer)
