"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most 2 bits differ in at most 2 of those bytes,
so they share at least 6. A posting list of one positional byte would hold 1/256 of the corpus and tallying over it would
touch a fixed share of all pairs, so the index is keyed by five of the eight positional bytes at once: 56 choices. A pair
that shares 6 positions meets in 6 of these lists, one that shares 7 in 21, one that shares 5 in a single one. The count
filter tallies the distinct lists in which a pair meets and keeps pairs that reach 6, the guaranteed minimum; those are
verified by the exact bit distance.

Fingerprints are distinct. A list longer than ``list_limit`` is split by its three free positions: each member is posted
under each of their bytes, and as 2 bits lie in at most two of three positions, a pair within 2 bits meets again. Such a
part has at most 65,536 members; if it is too long as well, it is split by its two free positions, each byte with one of
its 8 bits left out: one of the two holds at most one of the bits, so the pair meets there, among at most 512 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import bytes_of, written
from leakwise.llm.components import connected_components

BITS = 64
POSITIONS = 8


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text; 0 if it has no word."""
    words = text.lower().split()  # on bytes: A-Z only, and splits at [\x20\x09-\x0D]
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """(doc_id, fp, and ``digest`` if given): the fingerprint as a signed long."""
    more = [] if digest is None else [digest.alias("digest")]
    names = ["doc_id", "fp", *["digest" for _ in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in bytes_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest string" * len(more))


#: The three free positions of each choice.
FREE = list(combinations(range(POSITIONS), 3))
KEPT = [[p for p in range(POSITIONS) if p not in free] for free in FREE]
#: A pair that shares this many positions meets in so many lists.
LEAST = comb(POSITIONS - 2, 5)


def _byte(fp: Column, shift: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(shift) if isinstance(shift, int) else shift).bitwiseAND(F.lit(255))


def _posting(fp: Column, number: int) -> Column:
    """The five bytes of a choice (40 bits) below its number."""
    kept = [F.shiftleft(_byte(fp, 8 * p), 8 * i) for i, p in enumerate(KEPT[number])]
    return reduce(Column.bitwiseOR, kept).bitwiseOR(F.lit(number << 40))


def _number(posting: Column) -> Column:
    return F.shiftright(posting, 40).cast("int")


def _free_byte(fp: Column, posting: Column, which: int) -> Column:
    """The byte at one of the three free positions of a list."""
    return _byte(fp, F.element_at(F.array(*[F.lit(8 * free[which]) for free in FREE]), _number(posting) + 1)).cast("int")


def _parts(fp: Column, posting: Column) -> Column:
    """The parts of a long list in which a member is posted: by each of its free bytes."""
    return F.array(*[_free_byte(fp, posting, f).bitwiseOR(F.lit(f << 8)) for f in range(3)])


def _finer(fp: Column, posting: Column, part: Column) -> Column:
    """The parts of a long part: by each other free byte, without one of its bits."""
    used = F.shiftright(part, 8)

    def by(f: int) -> Column:
        byte = _free_byte(fp, posting, f)
        return F.array(*[F.shiftleft(part, 16).bitwiseOR(byte.bitwiseAND(F.lit(255 & ~(1 << bit)))).bitwiseOR(F.lit(f << 12 | bit << 8)) for bit in range(8)])

    return F.flatten(F.filter(F.array(*[F.when(used != f, by(f)) for f in range(3)]), lambda x: x.isNotNull()))


def tallies(distinct: DataFrame, list_limit: int = 64) -> DataFrame:
    """``distinct`` (fp long, unique) -> (a, b, lists): pairs a < b that meet, and in how many distinct lists; complete for
    pairs within 2 bits. The joins are told to sort: the planner takes ``explode`` for one row per row, so a table well
    above the broadcast threshold, 56 postings a fingerprint, would go through the driver's memory."""
    posted = distinct.select("fp", F.explode(F.array(*[_posting(F.col("fp"), n) for n in range(len(FREE))])).alias("posting"))
    sizes = posted.groupBy("posting").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(posted.join(sizes.hint("merge"), "posting").select("fp", "posting", "size"), "postings")
    short = lists.where(F.col("size") <= list_limit).select("fp", "posting", F.lit(-1).alias("part"))
    long = lists.where(F.col("size") > list_limit).select("fp", "posting", F.explode(_parts(F.col("fp"), F.col("posting"))).alias("part"))
    held = long.groupBy("posting", "part").agg(F.count("*").alias("held")).where("held > 1")
    finer = F.when(F.col("held") <= list_limit, F.array("part")).otherwise(_finer(F.col("fp"), F.col("posting"), F.col("part")))
    split = long.join(held.hint("merge"), ["posting", "part"]).select("fp", "posting", F.explode(finer).alias("part"))
    cells = short.unionByName(split)
    met = cells.withColumnRenamed("fp", "a").join(cells.withColumnRenamed("fp", "b").hint("merge"), ["posting", "part"]).where("a < b")
    return met.groupBy("a", "b").agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _number(F.col("posting"))))).alias("lists"))


def links(distinct: DataFrame, max_bits: int = 2, list_limit: int = 64) -> DataFrame:
    """``distinct`` (fp long, unique) -> (a, b): all pairs a < b of fingerprints within ``max_bits`` bits."""
    if max_bits != 2:
        raise ValueError("the index is laid out for 2 bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return tallies(distinct, list_limit).where(F.col("lists") >= LEAST).where(near).select("a", "b")


def simhash_dedup(docs: DataFrame, list_limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link to each other. Null ids take part but are never a
    component_id; a component of null ids only has a null one. Rows that repeat an id each get the component of their
    own fingerprint. Other columns are not read; an empty table gives an empty result.
    """
    return components(fingerprints(docs, id_col=id_col, text_col=text_col), list_limit).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def components(rows: DataFrame, list_limit: int = 64) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with component_id and root, which tells components apart whatever their ids. The joins
    are told to sort: labels grow with the rows, and the driver would hold what is broadcast."""
    rows = written(rows, "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = connected_components(links(classes.select("fp"), list_limit=list_limit))
    labelled = classes.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(labelled.join(smallest.hint("merge"), "root").select("fp", "root", "component_id").hint("merge"), "fp")
