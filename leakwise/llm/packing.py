"""Best-fit packing planned over the length histogram.

1. Texts become token ids, documents longer than a sequence are cut, and the pieces are written once with their task
   and their rank among the task's pieces of equal length.
2. The histogram (at most ``capacity`` rows) goes to the driver, which runs best-fit decreasing over counts: sequences
   with equal free space are one interval of sequence numbers, so the plan has a few rows per length however many
   documents there are.
3. Ranks per task become ranks per length by a running sum over the small (length, task) table, and each piece finds
   its planned slot by its rank within its length. The pieces meet the running sums by a sort-merge join on (length,
   task), keys of which none is hot; no task gets all pieces of a length.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakwise.llm.common import slices, texts_of, written


@cache
def encoder(path: str):
    """A function from texts to lists of ids, for a file of the ``tokenizers`` library, added tokens in texts included.

    A byte-level BPE file whose merges are in the order of their ids is run by ``tiktoken``, which gives the same ids
    several times as fast; any other file, and any text that it refuses or that holds an added token, by ``tokenizers``
    itself.
    """

    @cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    plain = lambda text: slow().encode(text, add_special_tokens=False).ids
    fast = _as_ranks(path)
    if fast is None:
        return plain

    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return plain(text)
        try:
            return fast(text)
        except BaseException as e:  # its panics on extreme texts derive from nothing narrower
            if type(e).__name__ != "PanicException":
                raise
            return plain(text)

    return encode


def _as_ranks(path: str):
    """The file as ranked byte strings, or None if it isn't a plain byte-level BPE."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or any(c not in letter for t in vocab for c in t) or len(merged) + 256 != len(vocab):
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens; only the first may be shorter."""
    head = total % capacity or capacity
    return [(0, head)] + [(at, capacity) for at in range(head, total, capacity)] if total > capacity else [(0, total)]


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (length, first rank, first sequence, offset): the slots of best-fit decreasing over counts.

    A row serves the ranks from its first rank to the next row's of that length; rank r goes to sequence
    first sequence + r - first rank.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> intervals (first sequence, how many)
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity) if free[r]), None)
            if room is None:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = free[room].pop()
            # a sequence takes as many as fit before the next one is used
            layers, used = room // length, min(many, left // (room // length))
            if not used:
                layers, used = left, 1
            for layer in range(layers):
                plan.append((length, rank, first, capacity - room + layer * length))
                rank += used
            left -= layers * used
            if many > used:
                free[room].append((first + used, many - used))
            if rest := room - layers * length:
                free[rest].append((first, used))
    return plan


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces with their task and their rank among the task's pieces of that length."""
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", 1 << 21):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc, k, start, length, crc32(part.tobytes()), task, int(seen[length]))
                    out.append((*row, part.astype(np.int32)) if with_ids else row)
                    seen[length] += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names[: len(out[0])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, shape + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null text counts as empty, so it is one piece that holds only ``end_id``. Repeated rows, repeated ids and null ids
    are packed like any other row. Other columns are not read; an empty table gives an empty result.
    """
    cells = written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    by_task = written(cells.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(best_fit_plan(histogram, capacity))
    table = np.array(plan or [(0, 0, 0, 0)], np.int64)
    starts = table[:, 0] * (1 << 48) + table[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    # the bases grow with the number of tasks, so they are not to be broadcast; a length has a key per task, so none is hot
    ranked = cells.join(bases.hint("merge"), ["length", "task"]).select(*keep, (F.col("base") + F.col("task_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            slot = [pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])]
            yield pa.RecordBatch.from_arrays([*kept, *slot], [*keep, "sequence_id", "offset"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name in keep)
    return ranked.mapInArrow(place, f"{shape}, sequence_id long, offset long")
