"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root), root the smallest node reachable; only nodes with an edge appear.

    Each round hooks the parents of both ends of every edge to the smaller parent, then halves all paths by one
    pointer jump, so long chains take a number of rounds that grows with the logarithm of their length. Every step is
    a partial aggregate or an equi-join that Spark can split when a parent is hot; the joins are told to sort, as a
    broadcast of labels would take memory of the driver that grows with them. State is written to the shared folder after
    each round. Null ends and self links are ignored.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = written(
        both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"),
        "links",
    )
    state = written(
        links.select(F.col("b").alias("node"), F.col("a").alias("near"))
        .unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("near")))
        .groupBy("node")
        .agg(F.min("near").alias("root")),
        "components",
    )
    for _ in range(max_rounds):
        of_a = state.select(F.col("node").alias("a"), F.col("root").alias("ra")).hint("merge")
        of_b = state.select(F.col("node").alias("b"), F.col("root").alias("rb")).hint("merge")
        ends = links.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        small, large = F.least("ra", "rb"), F.greatest("ra", "rb")
        offers = ends.select(F.inline(F.array(*[F.struct(k.alias("node"), small.alias("offer")) for k in (large, F.col("a"), F.col("b"))])))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer")).hint("merge")
        hooked = state.join(best, "node", "left").select("node", "root", F.least("root", "offer").alias("next"))
        above = hooked.select(F.col("node").alias("next"), F.col("next").alias("top")).hint("merge")
        after = written(
            hooked.join(above, "next").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
            "components",
        )
        forget(state)
        state = after
        if state.where("moved").isEmpty():
            return state.select("node", "root")
    raise RuntimeError("components did not settle")
