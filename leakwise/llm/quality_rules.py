"""Quality rules whose cut-offs are certified on labelled rows.

Each rule rejects a text when a ratio of its counts is above a cut-off. For every rule, cut-off and stratum (language)
the false rejections k among the n labelled good rows are counted; the cut-off is certified if the exact binomial upper
bound of the false-rejection rate stays within the rule's part of ``max_rate``, i.e. if
P(Binomial(n, rate) <= k) <= error / tests (Bonferroni over rules, cut-offs and strata). The strictest certified
cut-off of each rule and stratum is used; with too few labels none is, and the rule rejects nothing there. With
probability 1 - error, each stratum loses at most ``max_rate`` of its good texts to the rules together. The bound needs
independent draws, so a labelled id counts once however often it is labelled or stands in the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakwise.llm.common import slices, texts_of, written

#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects when numerator / denominator (two columns of the counts) is above the cut-off; 0 / 0 never rejects."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (0.02, 0.05, 0.1, 0.2, 0.4)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.5)),
    Rule("repeat_words", "n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.2, 0.3)),
    Rule("exclaims", "n_exclaims", "n_words", (0.05, 0.1, 0.2, 0.4, 0.8)),
    Rule("word_length", "word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0)),
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text; exact, by doubling ranks of ever longer runs."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ranks = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    width = 1
    while width < window:
        if (size := int(ranks.max()) + 1) == len(ranks):  # all different, so all longer runs are
            return 0
        step = min(width, window - width)
        _, ranks = np.unique(ranks[: len(ranks) - step] * size + ranks[step:], return_inverse=True)
        width += step
    again = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_exclaims."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), text.count("!")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims"]


def text_counts(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            table = np.array([counts(t) for t in texts_of(batch.column(2))], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, table.T.copy())], ["doc_id", "stratum", *NAMES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in NAMES))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), the regularised incomplete beta function I(1 - p; n - k, k + 1) by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):  # where the fraction converges fast
        return 1.0 - _beta(b, a, p, 1 - p)
    return _beta(a, b, x, p)


def _beta(a: int, b: int, x: float, y: float) -> float:
    """I(x; a, b) for x below (a + 1) / (a + b + 2), y = 1 - x, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(y)) * out / a


def certified(k: int, n: int, rate: float, error: float) -> bool:
    """Whether the exact upper bound, at level ``error``, of a rate with k of n seen is at most ``rate``."""
    return n > 0 and k <= rate * n and binomial_cdf(k, n, rate) <= error


def fires(rule: Rule, cutoff: Column | float) -> Column:
    top, bottom = F.col(rule.numerator), F.col(rule.denominator)
    return (bottom > 0) & (top > (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)) * bottom)


def choose_cutoffs(table: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], max_rate: float, error: float) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cut-off, from counts over all labelled good ids."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    tests = [(r, c) for r in rules for c in r.cutoffs]
    # of rows that repeat an id, the least strict verdict would not be a bound: a test counts if any of them fires
    hits = [F.max(fires(r, c).cast("int")).alias(f"f{i}") for i, (r, c) in enumerate(tests)]
    once = table.join(good, "doc_id").groupBy("stratum", "doc_id").agg(*hits)
    sums = [F.sum(f"f{i}").alias(f"k{i}") for i in range(len(tests))]
    counted = written(once.groupBy("stratum").agg(F.count("*").alias("n"), *sums), "strata")
    strata, rate = counted.count(), max_rate / max(1, len(rules))
    level = error / max(1, len(tests) * strata)
    # a smaller stratum can certify nothing, so there are at most as many rows as labelled ids by this number
    least = max(1, ceil(log(level) / log1p(-rate)) - 1) if 0 < rate < 1 else 1
    out = {}
    for row in counted.where(F.col("n") >= least).collect():
        passed = [(r, c) for i, (r, c) in enumerate(tests) if certified(row[f"k{i}"], row["n"], rate, level)]
        out[row["stratum"]] = {r.name: min(c for s, c in passed if s is r) for r in rules if any(s is r for s, _ in passed)}
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_rate: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, rejected_by (names of the rules that fire).

    Null text has no words, so it fails the base rule. A null stratum is a stratum of its own. An id counts once in each
    of its strata, however often it is labelled good or repeated; a rule counts as firing if it does on any of its rows.
    Null ids and labels are left out of the counts. Repeated rows are judged row by row.
    Other columns are not read; an empty table gives an empty result; without labels only the base rule rejects.
    """
    table = written(text_counts(docs, id_col, text_col, stratum_col), "text-counts")
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality")
    chosen = choose_cutoffs(table, named, rules, max_rate, error)

    cutoffs = docs.sparkSession.createDataFrame([(k, *[c.get(r.name) for r in rules]) for k, c in chosen.items()], "stratum string" + "".join(f", c{i} double" for i in range(len(rules))))
    # as few rows as there are strata with enough labels for a test
    joined = table.join(F.broadcast(cutoffs), "stratum", "left")
    verdicts = [F.when(F.coalesce(fires(r, F.col(f"c{i}")), F.lit(False)), r.name) for i, r in enumerate(rules)]

    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = joined.withColumn("base_failed", base).withColumn("rejected_by", F.array_compact(F.array(*verdicts)))
    return judged.select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
