import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakwise.llm.packing import best_fit_plan, cut, encoder, pack
from leakwise.llm.queries import tokenizer_path

SHAPE = "doc_id long, text string, length long, task string"


@cache
def plain_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sdlré1中a", max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|", "x", " ", "endoftext|>"])).map("".join))
def test_encoder_gives_the_ids_of_tokenizers(text):
    assert list(encoder(tokenizer_path())(text)) == plain_encoder()(text)


@pytest.mark.parametrize("text", ["a" * 60_000, "é" * 30_000, " " * 60_000, "\n" * 60_000, "1" * 60_000, "#" * 60_000, "ab" * 30_000 + "<|endoftext|>"])
def test_long_unbroken_texts(text):
    assert list(encoder(tokenizer_path())(text)) == plain_encoder()(text)


def best_fit_one_by_one(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(free) if r >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    capacity, counts = 40, Counter(lengths)
    plan = best_fit_plan(counts, capacity)
    slots, spans = set(), defaultdict(list)
    for length, n in counts.items():
        rows = sorted(p for p in plan if p[0] == length)
        for rank in range(n):
            row = [p for p in rows if p[1] <= rank][-1]
            spans[row[2] + rank - row[1]].append((row[3], length))
            slots.add((row[2] + rank - row[1], row[3]))
    assert len(slots) == len(lengths)
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(spans) == best_fit_one_by_one(lengths, capacity)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut(n):
    parts = cut(n, 1024)
    assert sum(k for _, k in parts) == n and all(k == 1024 for _, k in parts[1:]) and parts[0][0] == 0
    assert all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))


def test_pack_round_trip(spark):
    texts = [(1, "one two three"), (2, None), (3, ""), (4, "word and more " * 3000), (5, "a\n\n b"), (5, "a\n\n b"), (None, "x")]
    rows = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], SHAPE).repartition(3)
    got = pack(rows, tokenizer_path(), capacity=64, with_ids=True).collect()
    encode, want = plain_encoder(), Counter()
    for i, t in texts:
        ids = [*encode(t or ""), 2]
        for k, (start, n) in enumerate(cut(len(ids), 64)):
            part = ids[start : start + n]
            want[i, k, start, n, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(spans) == best_fit_one_by_one([r.length for r in got], 64)
    assert pack(rows.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|"])
def test_added_tokens_have_the_ids_of_tokenizers(text):
    assert list(encoder(tokenizer_path())(text)) == plain_encoder()(text)
