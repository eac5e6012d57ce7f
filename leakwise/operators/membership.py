"""Which directory users belong to which groups: trees of attribute constraints as joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Membership:
    """``constraints`` are (user attribute, group attribute) pairs that hold if the two share a value; ``dn``, in any case,
    is the name of the entry itself. ``all_of`` says whether all constraints and ``rules`` must hold, or any."""

    constraints: tuple[tuple[str, str], ...] = ()
    all_of: bool = True
    rules: tuple[Membership, ...] = ()


def _values(attribute: str) -> Column:
    """The values of an attribute, none if there is no such one."""
    if attribute.lower() == "dn":
        return F.array("dn")
    return F.coalesce(F.try_element_at("attributes", F.lit(attribute)), F.array().cast("array<string>"))


def memberships(users: DataFrame, groups: DataFrame, tree: Membership) -> DataFrame:
    """``users`` and ``groups`` (dn, attributes: map of lists) -> distinct (user, group).

    A constraint is an equi-join of the values of both sides, so a pair that shares none never meets; a tree intersects or
    unites the pairs of its parts. Names are taken to be unique. An empty part that must hold as a whole would make every
    user a member of every group and is refused; an empty part of which any must hold gives nothing. Null values are never
    equal.
    """

    def pairs(constraint: tuple[str, str]) -> DataFrame:
        of_user = users.select(F.col("dn").alias("user"), F.explode(_values(constraint[0])).alias("_value"))
        of_group = groups.select(F.col("dn").alias("group"), F.explode(_values(constraint[1])).alias("_value"))
        return of_user.join(of_group, "_value").select("user", "group").distinct()

    def held(part: Membership) -> DataFrame:
        parts = [*map(pairs, part.constraints), *map(held, part.rules)]
        if not parts:
            if part.all_of:
                raise ValueError("an empty rule that must hold makes every user a member of every group")
            return users.select(F.col("dn").alias("user"), F.col("dn").alias("group")).where(F.lit(False))
        if part.all_of:
            return reduce(lambda a, b: a.join(b, ["user", "group"]), parts)
        return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]

    return held(tree)
