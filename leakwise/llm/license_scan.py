"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template is a text of at least five words; its shingles are its five-word runs. For every template of m shingles the
windows are all runs of m shingles, one starting at every word, so they overlap in all but one shingle. A window and a
template that agree in a whole band of MinHash values are candidates. A window that holds 0.8 of a template has Jaccard
similarity of at least 0.8 / 1.2 = 2/3 with it, so it is retrieved with probability 1 - (1 - (2/3) ** rows) ** bands:
more than 0.99999 with the 12 bands of one row that are the default. Candidates are verified on the words themselves: the
share of the template's shingles that occur in the window.

Each MinHash value is a one-to-one function of a shingle's hash, so a template's value is that of one of its shingles
(the anchor), and a window has the value if it holds the anchor and no shingle with a smaller value. Windows are therefore
looked at only around anchors, which one table look-up per shingle finds for all templates at once; the cost hardly
depends on the number or length of templates.

Words are taken as in the other operators, A-Z in lower case, without the ASCII punctuation at their ends.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import bytes_of, slices
from leakwise.llm.licenses import TEMPLATES

WIDTH = 5
_ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_GAP = 0x5BD1E995


def word_form(word: bytes) -> bytes:
    return word.lower().strip(_ENDS)


class _Numbers(dict):
    """Hashes of words by their raw form; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word_form(word))
        return n


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = sum((words[i : len(words) - WIDTH + 1 + i] * _MIX[i] for i in range(1, WIDTH)), words[: len(words) - WIDTH + 1] * _MIX[0])
        h ^= h >> np.uint64(31)
        h *= _MIX[1]
        h ^= h >> np.uint64(29)
    return h


def _exact(words: list[bytes], shingles: dict[tuple[bytes, ...], int], starts: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(start, distinct shingles of the template in the window from there) of ascending starts, sliding over each run."""
    at, last = 0, len(words) - WIDTH + 1
    while at < len(starts):
        end = at
        while end + 1 < len(starts) and starts[end + 1] == starts[end] + 1:
            end += 1
        first, stop = starts[at], min(starts[end] + size, last)
        forms = [word_form(w) for w in words[first : stop + WIDTH - 1]]
        ids = [shingles.get(tuple(forms[i : i + WIDTH])) for i in range(stop - first)]
        held = Counter(i for i in ids[:size] if i is not None)
        for start in range(first, starts[end] + 1):
            yield start, len(held)
            gone = ids[start - first] if start - first < len(ids) else None
            if gone is not None:
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            come = start - first + size
            if come < len(ids) and ids[come] is not None:
                held[ids[come]] += 1
        at = end + 1


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = 0.8, bands: int = 12, rows: int = 1, seed: int = 11) -> None:
        self.threshold, self.bands, self.rows = threshold, bands, rows
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shingles: dict[str, dict[tuple[bytes, ...], int]] = {}
        self.sizes: dict[str, int] = {}
        self.values: dict[str, np.ndarray] = {}
        #: Anchor -> the templates and values that it is the anchor of.
        self.anchors: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.marked = np.zeros(1 << 16, bool)
        for name, text in templates.items():
            words = [word_form(w) for w in text.encode().split()]
            if len(words) < WIDTH:
                raise ValueError(f"{name}: a template has at least {WIDTH} words")
            own = list(dict.fromkeys(zip(*(words[i:] for i in range(WIDTH)), strict=False)))
            self.shingles[name] = {s: i for i, s in enumerate(own)}
            hashed = _shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
            self.sizes[name] = len(hashed)
            with np.errstate(over="ignore"):
                values = hashed[None, :] * self.factors[:, None]
            self.values[name] = values.min(1)
            for k, anchor in enumerate(hashed[values.argmin(1)].tolist()):
                self.anchors[anchor].append((name, k))
                self.marked[anchor & 0xFFFF] = True
        self.numbers = _Numbers()

    def _windows(self, hashes: np.ndarray, name: str, k: int, at: int) -> range:
        """Starts of the windows whose k-th value is the template's by the anchor at ``at``."""
        size = self.sizes[name]
        lo = max(0, at - size + 1)
        with np.errstate(over="ignore"):
            less = np.flatnonzero(hashes[lo : at + size] * self.factors[k] < self.values[name][k]) + lo
        place = int(np.searchsorted(less, at))
        first = int(less[place - 1]) + 1 if place else lo
        last = min(at, int(less[place]) - size) if place < len(less) else at
        return range(first, last + 1)

    def candidates(self, texts: list[list[bytes]]) -> Iterator[tuple[int, str, list[int]]]:
        """(text number, template, window starts in words, ascending)."""
        lengths = np.array([len(t) + WIDTH for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        words = np.full(int(lengths.sum()), _GAP, np.uint64)
        for at, text in zip(starts, texts, strict=True):
            words[at : at + len(text)] = np.fromiter(map(self.numbers.__getitem__, text), np.uint64, len(text))
        hashes = _shingle_hashes(words) if len(words) >= WIDTH else words[:0]
        found: dict[tuple[int, str], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        places = np.flatnonzero(self.marked[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        numbers = np.searchsorted(starts, places, side="right") - 1
        for i, place, anchor in zip(numbers.tolist(), places.tolist(), hashes[places].tolist(), strict=True):
            base = int(starts[i])
            last = base + len(texts[i]) - WIDTH + 1
            if anchor in self.anchors and place < last:
                for name, k in self.anchors[anchor]:
                    found[i, name][k].update(self._windows(hashes[base:last], name, k, place - base))
        for (i, name), agree in found.items():
            bands = [set.intersection(*(agree.get(k, set()) for k in range(b * self.rows, (b + 1) * self.rows))) for b in range(self.bands)]
            if union := set().union(*bands):
                yield i, name, sorted(union)

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, int, int, float, int]]:
        """(text number, template, first word, words, containment, windows) for each run of overlapping verified windows;
        the place is that of its best window, the first of several."""
        words = [t.split() for t in texts]
        out = []
        for i, name, starts in self.candidates(words):
            want, size = len(self.shingles[name]), self.sizes[name]
            verified = [(at, min(size + WIDTH - 1, len(words[i]) - at), n / want) for at, n in _exact(words[i], self.shingles[name], starts, size) if n / want >= self.threshold]
            run: list[tuple[int, int, float]] = []
            for window in [*verified, None]:
                if run and (window is None or window[0] >= run[-1][0] + run[-1][1]):
                    at, n, share = max(run, key=lambda w: (w[2], -w[0]))
                    out.append((i, name, at, n, share, len(run)))
                    run = []
                if window is not None:
                    run.append(window)
        return sorted(out)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, bands: int = 12, rows: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and place where a template stands: doc_id, template, first_word, n_words, containment, windows.

    Null and empty texts hold no template. Repeated rows and ids give rows of their own; a null id is carried through.
    Other columns are not read; an empty table or no template gives an empty result.
    """
    table = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, threshold, bands, rows)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        names = ["doc_id", "template", "first_word", "n_words", "containment", "windows"]
        for batch in slices(batches, "text", 1 << 21):
            found = scanner.scan(bytes_of(batch.column(1))) if table else []
            ids = batch.column(0).to_pylist()
            columns = list(zip(*((ids[i], *rest) for i, *rest in found), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, template string, first_word long, n_words long, containment double, windows long")
