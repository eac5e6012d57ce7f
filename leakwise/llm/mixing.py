"""Mixing sources to target weights by hierarchical budgets.

The tree is given by columns (domain, language, source) and weights per level. Capacities go up it once: a leaf can take
its tokens times ``max_epochs``, a node what its children can, and nothing where the weight is 0. A budget of tokens then
flows down: at each node the children share it by weight; a child that can take less is filled and what it lacks goes to
its siblings by weight. As no node is given more than it can take, what no sibling can take has gone to the ancestors'
other branches. All of it is windows over the table of leaves, so there may be any number of them. A leaf with a budget of e whole passes and a rest takes every document e times and, in the seeded order of
epoch e, the longest prefix of documents whose tokens fit the rest.

The prefix is a bound on the order key (a hash of seed, epoch and id), found without sorting a leaf: token sums per key
bucket, a running sum over each leaf's 256 buckets, the same again inside the bucket where the budget ends, and the
exact bound inside the last one (1 / 2^24 of the keys). Taking
part is then a filter on each row, so no text is shuffled and a hot source is not gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwise.llm.common import SPACE, written

LEAF = ["domain", "language", "source"]
#: Key bits per step of the search for a leaf's bound, and steps.
STEP_BITS = 8
LEVELS = 3


@dataclass(frozen=True)
class Targets:
    """Weights per level by name; names without one get ``other`` of their level."""

    weights: tuple[dict[str, float], ...] = ({}, {}, {})
    other: tuple[float, ...] = (1.0, 1.0, 1.0)
    #: Tokens wanted as a share of all tokens there are.
    budget_share: float = 1.0
    max_epochs: int = 3
    seed: int = 42
    #: Tables with a row per leaf are broadcast up to this many leaves; beyond it rows meet them in a salted join.
    broadcast_leaves: int = 100_000
    names: tuple[str, ...] = field(default=tuple(LEAF))


SALTS = 32


def _capped(level: DataFrame, depth: int, targets: Targets) -> DataFrame:
    """``level`` (names down to ``depth``, capacity) with weight; nothing fits where the weight is 0 or less."""
    table, name = targets.weights[depth - 1], F.col(LEAF[depth - 1])
    weight = F.lit(float(targets.other[depth - 1]))
    if table:
        known = F.create_map(*[F.lit(x) for k, w in sorted(table.items()) for x in (k, float(w))])
        weight = F.coalesce(F.try_element_at(known, name), weight)
    return level.withColumn("weight", weight).withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """``leaves`` (domain, language, source, leaf_tokens; a row each) with budget, whole tokens for each."""
    depths = range(len(LEAF), 0, -1)
    level = leaves.withColumn("capacity", F.col("leaf_tokens").cast("double") * targets.max_epochs)
    levels = {}
    for depth in depths:
        levels[depth] = _capped(level, depth, targets)
        level = levels[depth].groupBy(*LEAF[: depth - 1]).agg(F.sum("capacity").alias("capacity"))
    wanted = targets.budget_share * (leaves.agg(F.sum("leaf_tokens")).first()[0] or 0)
    above = None
    for depth in reversed(depths):
        nodes = levels[depth]
        given = nodes.withColumn("budget", F.lit(float(wanted))) if above is None else nodes.join(above, LEAF[: depth - 1])
        children = Window.partitionBy(*LEAF[: depth - 1])
        # in the order in which rising water fills them: the children before one are full if it is
        ratio = F.when(F.col("capacity") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0)
        before = children.orderBy("ratio", LEAF[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        open_weight = F.when(F.col("capacity") > 0, F.col("weight")).otherwise(0.0)
        framed = given.withColumns({"ratio": ratio, "weight": open_weight}).withColumns({
            "budget": F.least("budget", F.sum("capacity").over(children)),
            "whole": F.sum("weight").over(children),
            "full_capacity": F.coalesce(F.sum("capacity").over(before), F.lit(0.0)),
            "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        })
        full = F.col("ratio") * (F.col("whole") - F.col("full_weight")) <= F.col("budget") - F.col("full_capacity")
        left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(children)
        rest = F.col("whole") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(children)
        part = F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", F.greatest(F.lit(0.0), F.try_divide(F.col("weight") * left, rest))))
        keep = LEAF[:depth] if depth < len(LEAF) else [*LEAF, "leaf_tokens"]
        above = framed.withColumn("full", full).withColumn("budget", part).select(*keep, "budget")
    return above.withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def meet(rows: DataFrame, small: DataFrame, leaves: int, targets: Targets, salt: Column) -> DataFrame:
    """``rows`` joined to a table with a row per leaf. A source may hold any share of the rows, so without a broadcast the
    leaf is salted."""
    if leaves <= targets.broadcast_leaves:
        return rows.join(F.broadcast(small), LEAF)
    salted = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*LEAF, "salt"]).drop("salt")


def order_key(seed: Column | int, epoch: Column, id_col: str) -> Column:
    """The place of a document in the order of an epoch; rows that repeat an id share it."""
    return F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^" + SPACE[1:])).cast("long")


def mixing_plan(docs: DataFrame, leaf: dict[str, Column], tokens: Column, targets: Targets, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(plan, rows): plan has domain, language, source, leaf_tokens, budget, passes, bound (null: no prefix);
    rows has mix_id, domain, language, source, tokens."""
    names = [F.coalesce(leaf[n].cast("string"), F.lit("")).alias(n) for n in LEAF]
    rows = written(docs.select(F.col(id_col).alias("mix_id"), *names, F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")), "mix-rows")
    leaves = written(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("leaf_tokens")), "mix-leaves")
    many = leaves.count()
    some = F.col("leaf_tokens") > 0
    split = {"passes": F.when(some, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(0), "rest": F.when(some, F.col("budget") % F.col("leaf_tokens")).otherwise(0)}
    plan = written(leaf_budgets(leaves, targets).withColumns({k: c.cast("long") for k, c in split.items()}), "mix-budgets")
    salt = F.xxhash64("mix_id", "tokens")
    keyed = meet(rows, plan.where("rest > 0"), many, targets, salt).withColumn("key", order_key(targets.seed, F.col("passes"), "mix_id"))
    running = Window.partitionBy(*LEAF).orderBy("bucket")  # 2 ** STEP_BITS rows per leaf at most
    near, ends = keyed.withColumn("before", F.lit(0).cast("long")), None
    for bits in range(STEP_BITS, LEVELS * STEP_BITS + 1, STEP_BITS):
        if ends is not None:  # only rows of the bucket in which the leaf's budget ends
            near = meet(keyed, ends.withColumnRenamed("bucket", "outer"), many, targets, salt).where(F.shiftright("key", 64 - bits + STEP_BITS) == F.col("outer"))
        sums = near.groupBy(*LEAF, "rest", "before", F.shiftright("key", 64 - bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        cumulated = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(running)).where("upto > rest")
        first = F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before")), "bucket")
        ends = written(cumulated.groupBy(*LEAF).agg(first.alias("end")).select(*LEAF, "end.*"), "mix-ends")  # a row per leaf
    last = 64 - LEVELS * STEP_BITS
    inside = meet(keyed, ends, many, targets, salt).where(F.shiftright("key", last) == F.col("bucket")).groupBy(*LEAF, "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    within = Window.partitionBy(*LEAF).orderBy("key")  # one bucket of the last level
    fits = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(within)).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("bound"))
    # where no document of that bucket fits, the prefix ends with the bucket before it, if there is one
    earlier = F.when(F.col("bucket") > -(1 << LEVELS * STEP_BITS - 1), F.shiftleft(F.col("bucket").cast("long"), last) - 1)
    bounds = ends.join(fits, LEAF, "left").select(*LEAF, F.coalesce("bound", earlier).alias("bound"))
    done = written(plan.join(bounds, LEAF, "left").select(*LEAF, "leaf_tokens", "budget", "passes", "bound"), "mix-plan")
    return done, rows


def taken(frame: DataFrame, plan: DataFrame, targets: Targets, id_col: str) -> DataFrame:
    """``frame`` with the plan's columns and ``copies``: how often each row is taken."""
    joined = meet(frame, plan, plan.count(), targets, F.xxhash64(id_col))
    extra = F.col("bound").isNotNull() & (order_key(targets.seed, F.col("passes"), id_col) <= F.col("bound"))
    return joined.withColumn("copies", F.col("passes") + F.when(extra, 1).otherwise(0))


def mix(docs: DataFrame, leaf: dict[str, Column], tokens: Column, targets: Targets, id_col: str = "doc_id") -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, domain, language, source, tokens, epoch (from 0).

    Null names are a name of their own (empty); null token counts are 0. A leaf without tokens or below a weight of 0
    takes nothing. Rows that
    repeat an id go together. Columns of ``docs`` that aren't named in the expressions are not read; an empty table
    gives an empty result.
    """
    plan, rows = mixing_plan(docs, leaf, tokens, targets, id_col)
    return taken(rows, plan, targets, "mix_id").where("copies > 0").select(
        F.col("mix_id").alias("doc_id"), *LEAF, "tokens", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("epoch")
    )
