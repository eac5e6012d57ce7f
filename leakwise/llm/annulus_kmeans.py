"""K-means over integer vectors by annulus search.

|‖x‖ - ‖c‖| is never more than the distance of x and c. So a centroid that is at least as near as a known one, at
distance u, has its norm in the annulus [‖x‖ - u, ‖x‖ + u]. The centroids are sorted by norm; for each vector the bound
u starts as the distance to the centroid that is nearest by norm, the ends of the annulus are found by binary search,
and the centroids within it are compared exactly, from its middle outwards in runs of doubling length. After each run
the bound has shrunk and the ends are searched again. Both ends belong to the annulus and are moved outwards by more
than a rounding error, so a centroid that ties on the boundary is compared too; ties go to the smaller number.

Distances are exact integers. A round is one pass over the vectors without a shuffle of them: a task adds its vectors by
cluster and gives one row a cluster; the driver gets one row of sums a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import written

#: Components beyond this could overflow a squared distance of 64-bit integers (at up to 1,024 components).
LARGEST = 1 << 25
#: Pairs of a vector and a centroid that are compared at once.
PAIRS = 1 << 14


class NormIndex:
    """Centroids (k x d integers) sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.numbers = np.argsort(squares, kind="stable")
        self.centroids, self.squares = centroids[self.numbers], squares[self.numbers]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def annulus(self, norms: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends (first, and one past the last) of the centroids within the annuli of these bounds."""
        bound = np.sqrt(squared.astype(np.float64))
        slack = 1e-9 * (1 + norms + bound)
        return np.searchsorted(self.norms, norms - bound - slack, "left"), np.searchsorted(self.norms, norms + bound + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row, and the number of comparisons made."""
        n, k = len(x), len(self.norms)
        squares = (x * x).sum(1)
        norms = np.sqrt(squares.astype(np.float64))
        right = np.searchsorted(self.norms, norms)
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, k - 1)
        start = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        best = squares + self.squares[start] - 2 * np.einsum("ij,ij->i", x, self.centroids[start])
        number, compared = self.numbers[start].copy(), n
        seen_from, seen_to, step = start, start + 1, 1
        rows = np.arange(n)  # those whose annulus holds more
        while len(rows):
            low, high = self.annulus(norms[rows], best[rows])
            first, last = np.maximum(low, seen_from[rows] - step), np.minimum(high, seen_to[rows] + step)
            for begin, end in ((first, seen_from[rows]), (seen_to[rows], last)):
                compared += self._compare(x, squares, rows, begin, end, best, number)
            seen_from[rows], seen_to[rows] = np.minimum(first, seen_from[rows]), np.maximum(last, seen_to[rows])
            rows = rows[(low < seen_from[rows]) | (high > seen_to[rows])]
            step *= 2
        return number, best, compared

    def _compare(self, x: np.ndarray, squares: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, best: np.ndarray, number: np.ndarray) -> int:
        """Compares each of ``rows`` with the sorted centroids begin to end; updates ``best`` and ``number``."""
        length = np.maximum(end - begin, 0)
        ends = np.cumsum(length)
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            size = length[at:upto]
            if total := int(size.sum()):
                row = np.repeat(rows[at:upto], size)
                offset = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
                which = np.repeat(begin[at:upto], size) + offset
                distance = squares[row] + self.squares[which] - 2 * np.einsum("ij,ij->i", x[row], self.centroids[which])
                names = self.numbers[which]
                order = np.lexsort((names, distance, row))
                head = order[np.r_[True, row[order][1:] != row[order][:-1]]]
                r, d, c = row[head], distance[head], names[head]
                better = (d < best[r]) | ((d == best[r]) & (c < number[r]))
                best[r[better]], number[r[better]] = d[better], c[better]
            at = upto
        return int(ends[-1]) if len(ends) else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of integer lists of one length, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def quantized(vector: str | Column, scale: int, largest: int = LARGEST) -> Column:
    """floor(scale * x) of each component, as long; a null or non-finite one is null, one beyond ``largest`` an error."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        y = x * scale
        refuse = F.raise_error(F.lit(f"a component is beyond {largest} after scaling")).cast("long")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(F.abs(y) <= largest, F.floor(y)).when(x.isNotNull(), refuse)

    return F.transform(vector, one)


def finite(vector: str | Column) -> Column:
    """Neither the vector nor any of its components is null, NaN or infinite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(ok, F.lit(False))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _sums(points: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, rows, sums of components) of each cluster that has rows."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, rows = NormIndex(centroids), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            number = index.nearest(x)[0]
            order = np.argsort(number, kind="stable")
            if len(order):
                starts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
                total[number[order][starts]] += np.add.reduceat(x[order], starts)
                rows += np.bincount(number, minlength=k)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = points.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return [(r[0], r[1], list(r[2:])) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()]


def fit(points: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Each round replaces every centroid that has vectors by the floor of their mean; the others stay."""
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, n, sums in _sums(points, centroids):
            moved[cluster] = [s // n for s in sums]
        centroids = moved
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points`` (vec_id, v) -> (vec_id, cluster, distance), the squared distance."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NormIndex(centroids)
        for batch in batches:
            number, distance, _ = index.nearest(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return points.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def annulus_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array).

    Kept are vectors of exactly ``width`` components, none null or non-finite; each component x becomes
    floor(scale * x). With fewer than ``k`` kept vectors each is a first centroid. Rows that repeat an id or a vector
    each count; among first centroids of equal ids the smaller vector comes first, a null id hashes as an empty one. Equal
    centroids share nothing: ties go to the smaller number and the other one stays where it is. Without a kept
    vector the result is empty. Other columns, whatever their names, are not read. Components beyond 2^25 after scaling
    are refused, as squared distances are 64-bit integers.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    points = rows.where((F.size("vector") == width) & finite("vector")).select("vec_id", quantized("vector", scale).alias("v"))
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("vec_id").mapInArrow(lambda batches: iter(()), shape)
    centroids = fit(points, centroids, rounds)
    assigned = written(assign(points, centroids), "assigned")
    # one row a cluster: k at most, so the broadcast is bounded by a parameter
    found = [tuple(r) for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()]
    whole = sum(s for _, s in found)
    facts = [(c, s, whole, centroids[c].tolist()) for c, s in found]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(table), "cluster").select(*[c.split(" ")[0] for c in shape.split(", ")])
