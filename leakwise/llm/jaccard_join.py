"""N-gram Jaccard join over R-trees of count vectors.

A text is the set of its word shingles. Shingles are hashed into ``GROUPS`` groups; the counts by group are the text's
point. Two sets share at most the sum of the coordinate minima of their points, so a pair, or a pair of R-tree boxes by
their upper corners, whose sum falls short of the overlap that the threshold asks for holds no link.

In so many dimensions the boxes of one tree over all points overlap and a search from its root would visit all of them.
So the first level of the tree is cut along exact values: the groups fall into m slices, and a box of the first level
(a cell) is all sets that have the same shingles in one slice. Sets within the threshold differ by at most
D = (1 - t) / (1 + t) * (|a| + |b|) shingles, so with m > D slices they agree in at least one and meet in its cell. m goes
by classes of set sizes; a set near the upper end of its class is a member in the next class too. Cells with the same
members are one. Below the first level the trees are packed in memory, by size and by the coordinate that varies most,
over at most ``PAGE`` members; two pages of a long cell are joined by going down both trees.

What survives is verified by the exact sets (64-bit hashes of shingles). As components are wanted, a cell first gives
a spanning forest of its surviving pairs, best bounds first; the pairs that are left are those between different
components of the links found so far. So a group of g near copies doesn't give g^2 / 2 pairs, and no link that could join
two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import bytes_of, scope, slices, written
from leakwise.llm.components import connected_components

#: Coordinates of a point.
GROUPS = 128
#: Members of a tree.
PAGE = 128
#: Members of a leaf.
LEAF = 16
#: Sets beyond this size are verified without a bound, as counts are 16-bit integers.
LARGE = 1 << 16
#: Where classes of sizes begin (up to 2^40), each about 1.5 times the one before.
CLASSES = np.array([1, *[round(10 * 1.5**i) for i in range(62)]])
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the word shingles of a text; of the whole sequence if it has fewer words."""
    words = text.lower().split()  # on bytes: A-Z only, and splits at [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(words) - width + 1))


def mixed(h: np.ndarray) -> np.ndarray:
    """Other bits for other uses of a hash."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def differing(a, b, percent: int):
    """The most shingles in which sets of these sizes within the threshold differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def needed(a, b, percent: int):
    """The least overlap of sets of these sizes within the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def cell_keys(hashes: np.ndarray, percent: int = 90) -> np.ndarray:
    """The cells of a set: a hash of (class, slice, the shingles in that slice). Sets that don't differ from any other
    within the threshold have none."""
    n = len(hashes)
    classes = [int(np.searchsorted(CLASSES, n, "right")) - 1]
    while 100 * n >= percent * CLASSES[classes[-1] + 1]:
        classes.append(classes[-1] + 1)
    keys = []
    spread, content = mixed(hashes), mixed(hashes ^ MIX)
    for c in classes:
        largest = int(CLASSES[c + 1]) - 1
        most = differing(largest, largest, percent)
        if not most:
            continue  # only equal sets, which are one class anyway
        slice_of = (spread % np.uint64(most + 1)).astype(np.int64)
        order = np.argsort(slice_of, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(slice_of[order]) != 0])
        sums = np.zeros(most + 1, np.uint64)
        sums[slice_of[order][starts]] = np.add.reduceat(content[order], starts)
        keys.append(mixed(sums + mixed(np.arange(most + 1, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(42)))))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def point(hashes: np.ndarray) -> np.ndarray:
    """Shingles by group. Counts that don't fit only occur in sets beyond LARGE, which no bound is used for."""
    counts = np.bincount((mixed(hashes) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, 65535).astype(np.uint16)


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, digest, keys, point) of each row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "text_key", "n", "digest", "keys", "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_hashes(t, width) for t in bytes_of(batch.column(1))]
            keys = [cell_keys(h, percent) if len(h) else h for h in sets]
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([digest_of(h) for h in sets], pa.binary()), lists, pa.array([point(h).tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names)

    shape = "doc_id long, text_key long, n long, digest binary, keys array<long>, point binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, shape)


class BoxTree:
    """A packed R-tree over points: rows in leaves of ``LEAF``, leaves in one level of boxes. A box holds the upper corner
    and the smallest and largest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * 4  # tiles: by size first, then by the coordinate that varies most within the slab
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            order[at : at + slab] = part[np.argsort(points[part, points[part].var(0).argmax()], kind="stable")]
        self.rows, self.points, self.sizes = order, points[order], sizes[order]
        starts = np.arange(0, len(order), LEAF)
        self.upper = np.maximum.reduceat(self.points, starts) if len(order) else self.points
        self.least, self.most = (f.reduceat(self.sizes, starts) if len(order) else self.sizes for f in (np.minimum, np.maximum))

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, (i + 1) * LEAF)


def shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all pairs of rows."""
    return np.minimum(a[:, None], b[None]).sum(2, dtype=np.int64)


def near_sizes(a_least, a_most, b_least, b_most, percent: int):
    return (100 * a_most >= percent * b_least) & (100 * b_most >= percent * a_least)


def tree_join(a: BoxTree, b: BoxTree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, bound of the Jaccard similarity) of the pairs that can be within the threshold; each pair
    once if the trees are the same."""
    over = shared_at_most(a.upper, b.upper)
    least_a, least_b = a.least[:, None], b.least[None]
    good = near_sizes(least_a, a.most[:, None], least_b, b.most[None], percent)
    good &= (over >= needed(least_a, least_b, percent)) | (a.most[:, None] > LARGE) | (b.most[None] > LARGE)
    if same:
        good = np.triu(good)
    found = [], [], []
    for i, j in zip(*np.nonzero(good), strict=True):
        p, q = a.leaf(i), b.leaf(j)
        m, n = a.sizes[p, None], b.sizes[None, q]
        bound = shared_at_most(a.points[p], b.points[q])
        bound = np.where((m > LARGE) | (n > LARGE), np.minimum(m, n), np.minimum(bound, np.minimum(m, n)))
        close = (bound >= needed(m, n, percent)) & near_sizes(m, m, n, n, percent)
        if same and i == j:
            close = np.triu(close, 1)
        x, y = np.nonzero(close)
        found[0].append(a.rows[p][x])
        found[1].append(b.rows[q][y])
        found[2].append((bound / (m + n - bound))[x, y])
    return tuple(np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, (np.int64, np.int64, np.float64), strict=True))


def spanning(rows: np.ndarray, others: np.ndarray, similar: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of pairs of rows, those of a forest that joins what they join, more similar ones first; rows of one label are
    joined from the start."""
    names, root = np.unique(label, return_inverse=True)
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    taken = []
    for k in np.argsort(-similar, kind="stable"):
        x, y = top(root[rows[k]]), top(root[others[k]])
        if x != y:
            parent[max(x, y)] = min(x, y)
            taken.append(k)
    return np.array(taken, np.int64)


MEMBERS = "struct<node: long, n: long, label: long, point: binary>"


def _join_pages(percent: int, forest: bool):
    """Maps rows of two lists of members, the second one null for a page with itself, to pairs (a, b)."""

    def members(value: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node, n, label = (value.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        points = np.frombuffer(b"".join(value.field(3).to_pylist()), np.uint16).reshape(-1, GROUPS)
        return node, n, label, points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                node, n, label, points = members(left.values)
                tree = BoxTree(points, n)
                if right.is_valid:
                    more = members(right.values)
                    x, y, similar = tree_join(tree, BoxTree(more[3], more[1]), percent, same=False)
                    y = y + len(node)
                    node, label = np.r_[node, more[0]], np.r_[label, more[2]]
                else:
                    x, y, similar = tree_join(tree, tree, percent, same=True)
                keep = np.flatnonzero(label[x] != label[y])
                if forest and len(keep) > 1:
                    keep = keep[spanning(x[keep], y[keep], similar[keep], label)]
                x, y = node[x[keep]], node[y[keep]]
                pairs.append((np.minimum(x, y), np.maximum(x, y)))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], ["a", "b"])

    return run


def candidates(members: DataFrame, points: DataFrame, percent: int, forest: bool) -> DataFrame:
    """``members`` (key, node, parts, label) -> distinct (a, b) that meet in a cell and survive the bounds."""
    page = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pages = written(
        members.join(points, "node")
        .groupBy("key", "parts", page.alias("page"))
        .agg(F.collect_list(F.struct("node", "n", "label", "point")).alias("members")),
        "pages",
    )
    none = F.lit(None).cast(f"array<{MEMBERS}>")
    long = pages.where("parts > 1")
    other = long.select("key", F.col("page").alias("other"), F.col("members").alias("more"))
    met = long.join(other, "key").where("page <= other").select("members", F.when(F.col("page") != F.col("other"), F.col("more")).alias("more"))
    found = pages.select("members", none.alias("more")).where("parts = 1").unionByName(met)
    return found.mapInArrow(_join_pages(percent, forest), "a long, b long").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` (node, own_id, text_key, digest) -> (node, hashes): the sets, made again from the texts of these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_hashes(t, width) for t in bytes_of(batch.column(1))]
            same = pa.array([digest_of(h) == d for h, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"])
            yield out.filter(same)

    texts = docs.withColumn("key", F.xxhash64("text"))
    asked = texts.join(nodes, (texts["key"] == nodes["text_key"]) & texts["doc_id"].eqNullSafe(nodes["own_id"])).select("node", "text", "digest")
    return asked.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) -> (a, b, ok) by the exact sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(s) + len(t) - len(np.union1d(s, t))
                ok.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    of = lambda c, name: sets.select(F.col("node").alias(c), F.col("hashes").alias(name))
    return pairs.join(of("b", "hb"), "b").join(of("a", "ha"), "a").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long, ok boolean")


def cells(reps: DataFrame) -> DataFrame:
    """``reps`` (node, keys, ...) -> (key, node, parts): the members of cells that hold more than one set, each of several
    cells with the same members once."""
    postings = reps.select("node", F.explode("keys").alias("key"))
    sizes = postings.groupBy("key").agg(
        F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all")
    )
    kept = sizes.where("size > 1").groupBy("size", "lo", "hi", "all").agg(F.min("key").alias("key"))
    return postings.join(kept.select("key", F.ceil(F.col("size") / PAGE).cast("int").alias("parts")), "key")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Texts link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. Null and
    empty texts, and those of white space only, have an empty set and link with nothing: they keep their own id. Texts with
    equal sets are one class whatever their number. Null ids take part but are never a component_id; a component of null ids
    only has a null one. Rows that repeat an id each get the component of their own text. Other columns are not read; an
    empty table gives an empty result. Shingles are compared by 64-bit hashes, whole sets by 128-bit ones.
    """
    if not 50 <= percent < 100:
        raise ValueError("the threshold is a percentage from 50 to 99")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scope() as kept:
        rows = written(described(source, width, percent).withColumn("rid", F.monotonically_increasing_id()), "sets")
        kept.append(rows)
        classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id")), "classes")
        reps = written(rows.join(classes.select("node"), rows["rid"] == F.col("node")).where("size(keys) > 0").drop("rid"), "representatives")
        members = written(cells(reps), "members")
        points = reps.select("node", "n", "point")
        first = written(candidates(members.withColumn("label", F.col("node")), points, percent, forest=True), "pairs")
        ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = written(sets_of(source, reps.join(ends, "node").select("node", F.col("doc_id").alias("own_id"), "text_key", "digest"), width), "exact")
        checked = written(verified(first, sets, percent), "checked")
        links = checked.where("ok").select("a", "b")
        found = connected_components(links)
        # cells of two sets are settled; of the others, those in which several components meet
        told = members.join(found.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_cells = told.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("size > 2 and lo <> hi")
        rest = candidates(told.join(open_cells.select("key"), "key", "left_semi"), points, percent, forest=False)
        late = written(verified(rest.join(checked, ["a", "b"], "left_anti"), sets, percent).where("ok").select("a", "b"), "late")
        if not late.isEmpty():
            found = connected_components(links.unionByName(late))
        labelled = classes.join(found, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root"))
        smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
        final = written(labelled.join(smallest, "root").select("digest", "component_id"), "labels")
        kept.append(final)
    with_words = rows.where("n > 0").join(final, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
