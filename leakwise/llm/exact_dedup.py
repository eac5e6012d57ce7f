"""Exact dedup by a heavy-hitter split.

1. A narrow table (doc_id, digest) is written once; every later pass reads that, never the texts.
2. Misra-Gries summaries of at most ``counters`` digests are built per partition and merged in two levels; every
   digest with more than n / counters rows survives the merge.
3. The candidates are counted exactly (the candidate list has at most ``counters`` rows, so it is broadcast); those
   with at least n / counters rows are verified winners.
4. Rows of a winner take keep_id and group_size from the broadcast winners, with no shuffle; the others use an
   ordinary partial aggregate and join on the digest, where no key has more than n / counters rows. That join is told to
   sort: both sides grow with the input, and the driver would hold what is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import SPACE, written

#: Tasks that merge the summaries of all partitions, before one merges theirs.
MIDDLE = 64


def normalised(text: str | Column) -> Column:
    """Null as empty, each run of white space as one space."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def _fold(summary: dict[bytes, int], key: bytes, count: int, counters: int) -> None:
    """Weighted Misra-Gries step."""
    if key in summary:
        summary[key] += count
    else:
        summary[key] = count
        if len(summary) > 2 * counters:
            _shrink(summary, counters)


def _shrink(summary: dict[bytes, int], counters: int) -> None:
    """Subtract the (counters + 1)-th largest count from all; at most ``counters`` keys stay."""
    if len(summary) > counters:
        cut = sorted(summary.values(), reverse=True)[counters]
        for key in [k for k, n in summary.items() if n <= cut]:
            del summary[key]
        for key in summary:
            summary[key] -= cut


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One partition's Misra-Gries summary of (digest, weight) rows."""
    summary: dict[bytes, int] = {}
    for batch in batches:
        if batch.num_rows:
            tally: Counter = Counter()
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally[key] += n
            for key, n in tally.items():
                _fold(summary, key, n, counters)
    _shrink(summary, counters)
    yield pa.RecordBatch.from_pydict({"digest": pa.array(summary, pa.binary()), "weight": pa.array(summary.values(), pa.int64())})


def heavy_candidates(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests, among them each with more than n / counters rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summarise(batches, counters)

    shape = "digest binary, weight long"
    first = digests.select("digest", F.lit(1).cast("long").alias("weight")).mapInArrow(step, shape)
    # summaries of groups of partitions first, each level behind its own exchange (coalesce(1) would pull the first merge
    # into the last task), so that the last merge reads at most MIDDLE x counters rows
    middle = first.repartition(MIDDLE, F.spark_partition_id()).mapInArrow(step, shape)
    return middle.repartition(1).mapInArrow(step, shape)


def exact_dedup(docs: DataFrame, counters: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal. Of equal texts the smallest non-null id stays; rows that repeat both id and text
    are one document and are all marked kept. A group of null ids only has a null keep_id and is kept. Other columns
    of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest")), "digests"
    )
    total = rows.count()
    candidates = heavy_candidates(rows, counters).select("digest")
    # the candidate list has at most `counters` rows of 32 bytes, whatever the input
    counted = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = written(counted.where(F.col("group_size") * counters >= total), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).hint("merge")
    return hot.unionByName(rest.join(groups, "digest")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
