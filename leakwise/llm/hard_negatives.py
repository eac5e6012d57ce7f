"""Hard-negative mining over k-means inverted lists with stored radii.

The index: centroids are fitted on a bounded sample, every row goes to the list of its nearest centroid, and long lists
are cut into blocks of a bounded number of rows. A block stores its centroid c and its radius r, the largest distance of
its rows to c. By Cauchy-Schwarz the inner product of a query q with any row of a block lies in
[q·c - ‖q‖r, q·c + ‖q‖r].

A search visits the blocks of each query by falling upper bound, skips those whose interval lies outside the wanted
window of scores, and stops where the upper bound falls strictly below the k-th score found so far (an equal bound may
still hold a tie with a smaller id). Many queries visit at once: a round takes the next run of blocks in each query's own
order, and runs get longer from round to round, so a search of any table takes a few rounds; the k-th scores are merged
between rounds. Which blocks a query visits is decided by row; (query, block) meet by an equi-join on the block, whose
rows on both sides are packed: at most ``CHUNK`` queries, or one block. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakwise.llm.annulus_kmeans import finite, matrix, quantized
from leakwise.llm.common import forget, written

#: Components beyond this after scaling are refused: scores times places in a block are 64-bit integers.
LARGEST = 1 << 20
#: Queries that visit a block together.
CHUNK = 256
#: Blocks that a query visits in the first round, and how many times as many in each later one.
FIRST, FACTOR = 16, 8
ANY = 1 << 62


@dataclass
class ListIndex:
    """``blocks`` (block, ids, labels, v: packed rows) and, by block number, what decides about a visit. The arrays have
    one entry a block: at most 2^16 + 1,024 up to 2^31 rows, 1 to 2^15 rows beyond."""

    blocks: DataFrame
    centroids: np.ndarray
    cluster: np.ndarray
    radius: np.ndarray
    width: int


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Integer centroids of a sample by Lloyd's rounds."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)]
    for _ in range(rounds):
        which = _nearest(sample, centroids)[0]
        n = np.bincount(which, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, which, sample)
        centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of a nearest centroid of each row; exact integers in floats."""
    c = centroids.astype(np.float64)
    y = x.astype(np.float64)
    gap = (c * c).sum(1)[None] - 2 * (y @ c.T)
    which = gap.argmin(1)
    return which, gap[np.arange(len(x)), which] + (y * y).sum(1)


def build_index(points: DataFrame, n: int, width: int, per_list: int = 64, block: int = 1024) -> ListIndex:
    """Index all ``points`` (vec_id, label, v). About sqrt(n) / 2 lists, 1,024 at most; the sample has at most
    ``per_list`` rows a list, those with the smallest hashes, so at most 65,536 rows reach the driver."""
    lists = max(1, min(1024, round(n**0.5 / 2)))
    size = lists * per_list
    drawn = points.select("v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).alias("draw")).where(F.col("draw") < 2 * size)
    sample = np.array([r.v for r in drawn.orderBy("draw", "v").limit(size).collect()], np.int64).reshape(-1, width)
    if not len(sample):  # nothing hashes so low
        sample = np.array([r.v for r in points.limit(1).collect()], np.int64).reshape(-1, width)
    centroids = fit_centroids(sample, lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                which, far = _nearest(matrix(batch.column(2), width), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which, pa.int32()), pa.array(far)], ["vec_id", "label", "v", "cluster", "far"])

    placed = written(points.select("vec_id", "label", "v").mapInArrow(place, "vec_id long, label long, v array<int>, cluster int, far double"), "placed")
    rows = max(block, min(1 << 15, -(-n // (1 << 16))))
    sizes = sorted(tuple(r) for r in placed.groupBy("cluster").count().collect())  # one row a list
    starts, cluster = [], []
    for c, count in sizes:
        parts = -(-count // rows)
        starts.append((c, len(cluster), parts))
        cluster += [c] * parts
    numbers = placed.sparkSession.createDataFrame(starts, "cluster int, start int, parts int")
    # rows are dealt over the blocks of their list by their place in the written table, whatever repeats in them
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int")
    blocks = written(
        placed.join(F.broadcast(numbers), "cluster")
        .select((F.col("start") + dealt).alias("block"), F.struct("vec_id", "label", "v").alias("row"), "far")
        .groupBy("block")
        .agg(F.collect_list("row").alias("rows"), F.max("far").alias("far"))
        .select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.label").alias("labels"), F.flatten("rows.v").alias("packed"), "far"),
        "blocks",
    )
    forget(placed)
    radius = np.full(len(cluster), -1.0)  # a block that got no row is never visited
    for r in blocks.select("block", "far").collect():
        radius[r.block] = np.sqrt(r.far) * (1 + 1e-9)
    return ListIndex(blocks, centroids, np.array(cluster, np.int64), radius, width)


def bounds(index: ListIndex, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the scores of each query with the rows of each block."""
    y = q.astype(np.float64)
    middle = (y @ index.centroids.astype(np.float64).T)[:, index.cluster]
    reach = np.sqrt((y * y).sum(1))[:, None] * index.radius[None] + 1e-6
    return middle - reach, middle + reach


def visits(index: ListIndex, q: np.ndarray, low: np.ndarray, least: np.ndarray, high: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, block) pairs of a round. ``low``, ``least`` and ``high`` (queries x windows): the window of wanted scores
    and the least score that still counts, the k-th of those found or the lower end."""
    under, over = bounds(index, q)
    fits = np.zeros(over.shape, bool)
    wanted = np.zeros(over.shape, bool)
    for s in range(low.shape[1]):
        inside = (under <= high[:, s, None]) & (low[:, s] <= high[:, s])[:, None]
        fits |= inside & (over >= low[:, s, None])
        wanted |= inside & (over >= least[:, s, None])
    fits &= index.radius[None] >= 0
    # the order doesn't depend on what has been found, so that rounds together take each block once
    order = np.argsort(np.where(fits, -over, np.inf), axis=1, kind="stable")[:, begin:end]
    taken = np.take_along_axis(fits & wanted, order, 1)
    return np.nonzero(taken)[0], order[taken]


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    """Lists of different lengths as a matrix."""
    lists = [x or [] for x in column.to_pylist()]
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


VISIT = "block int, keys array<long>, own array<long>, named array<long>, asked array<int>, least array<long>, high array<long>"
FOUND = "key long, slot int, score long, vec_id long"


def _plan(index: ListIndex, begin: int, end: int):
    bare = ListIndex(None, index.centroids, index.cluster, index.radius, index.width)
    names = [f.split(" ")[0] for f in VISIT.split(", ")]
    at_once = max(1, (4 << 20) // max(1, len(index.cluster)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own, named = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            q = matrix(batch.column(3), bare.width)
            low, least, high = _padded(batch.column(4), 1), _padded(batch.column(5), 1), _padded(batch.column(6), 0)
            pairs = []
            for at in range(0, len(q), at_once):
                part = slice(at, at + at_once)
                query, block = visits(bare, q[part], low[part], least[part], high[part], begin, end)
                pairs.append((query + at, block))
            if not pairs:
                continue
            query, block = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(block, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
                for i in range(0, len(group), CHUNK):
                    rows = query[group[i : i + CHUNK]]
                    lists = [key[rows], own[rows], named[rows], q[rows].ravel().astype(np.int32), least[rows].ravel(), high[rows].ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([block[group[0]]], pa.int32()), *[pa.array([x]) for x in lists]], names)

    return run


def top(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` allowed entries of each row by falling score, ties by smaller column."""
    m = scores.shape[1]
    rank = np.where(allowed, scores * m + np.arange(m - 1, -1, -1), np.iinfo(np.int64).min)
    if m <= k:
        return np.nonzero(allowed)
    chosen = np.argpartition(rank, m - k, axis=1)[:, m - k :]
    good = np.take_along_axis(allowed, chosen, 1)
    return np.nonzero(good)[0], chosen[good]


def _score(width: int, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, own, named, asked, least, high, ids, labels, packed = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 10))
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], labels[order]
                x = packed.reshape(-1, width)[order].astype(np.float64)
                scores = (asked.reshape(-1, width).astype(np.float64) @ x.T).astype(np.int64)
                alike = named[:, None] == labels[None]
                allowed = alike & (own[:, None] != ids[None]) if same else ~alike
                least, high = least.reshape(len(keys), -1), high.reshape(len(keys), -1)
                for s in range(least.shape[1]):
                    row, column = top(scores, allowed & (scores >= least[:, s, None]) & (scores <= high[:, s, None]), k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(np.full(len(row), s, np.int32)), pa.array(scores[row, column]), pa.array(ids[column])], ["key", "slot", "score", "vec_id"])

    return run


def search(queries: DataFrame, index: ListIndex, k: int, same: bool) -> DataFrame:
    """``queries`` (key, vec_id, label, v, low, high) -> (key, slot, score, vec_id, place): for each window [low, high]
    of a query its first ``k`` rows of the same label and another id (or of other labels), by score, then id."""
    best, begin, length = None, 0, FIRST
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))
    while begin < len(index.cluster):
        asked = queries.withColumn("least", F.col("low"))
        if best is not None:  # at most windows x k rows a query
            reached = best.where(F.col("place") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
            raised = F.transform("low", lambda x, i: F.greatest(x, F.try_element_at(F.col("kth"), i)))  # greatest() skips nulls
            asked = queries.join(reached, "key", "left").withColumn("least", raised)
        planned = asked.select("key", "vec_id", "label", "v", "low", "least", "high").mapInArrow(_plan(index, begin, begin + length), VISIT)
        # the optimizer takes the visits to be as small as the queries, so it must not pick a broadcast
        met = planned.hint("merge").join(index.blocks.drop("far"), "block")
        found = met.mapInArrow(_score(index.width, k, same), FOUND)
        merged = found if best is None else found.unionByName(best.drop("place"))
        after = written(merged.withColumn("place", place).where(F.col("place") <= k), "found")
        if best is not None:
            forget(best)
        best, begin, length = after, begin + length, length * FACTOR
    return best


def _floor_div(x: Column, by: int) -> Column:
    return F.floor((x - F.pmod(x, F.lit(by))) / by).cast("long")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 1024) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without id or label, without vector, or with a null or non-finite component take no part; each component x
    becomes floor(scale * x). ``anchor``, over vec_id, picks the anchors. A positive is one of the first ``positives``
    rows of the anchor's label under another id; for each, the first ``negatives`` rows of other labels with
    low * p <= 100 * n <= high * p are given, p and n the inner products with the anchor. Pairs without one give no row.
    Shorter vectors count as if they ended in zeros, an empty vector scores 0. Rows that repeat an id each take part, so
    a repeated anchor has its rows again; equal scores go by the smaller id. An empty table gives an empty result. Other
    columns, whatever their names, are not read. Components beyond 2^20 after scaling are refused, as scores are compared as
    64-bit integers. A block has about ``block`` rows, more in tables of over 2^26.
    """
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    points = rows.where("vec_id is not null and label is not null").where(finite("vector")).select("vec_id", "label", quantized("vector", scale, LARGEST).cast("array<int>").alias("v"))
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], shape)
    width = max(width, 1)
    points = points.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    index = build_index(points, n, width, block=block)
    asked = written(points.where(anchor).withColumn("key", F.monotonically_increasing_id()), "anchors")
    every = asked.withColumns({"low": F.array(F.lit(-ANY)), "high": F.array(F.lit(ANY))})
    near = search(every, index, positives, same=True)
    p = F.col("score")
    window = F.struct("place", (-_floor_div(p * -low, 100)).alias("low"), _floor_div(p * high, 100).alias("high"))
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(window)).alias("w"))  # at most `positives` a key
    ranged = asked.join(windows, "key").select("key", "vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hard = search(ranged, index, negatives, same=False)
    forget(index.blocks)
    pairs = near.select("key", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hard.select("key", "slot", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["key", "slot"])
        .join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select(*[c.split(" ")[0] for c in shape.split(", ")])
    )
