"""Quality rules with an isolation forest on their statistics.

Each text is measured once, in Arrow batches: the base counts (``BASE``) and the statistics of the rules (``RATIOS``). Two
base rules reject at once. The forest is fitted on labelled documents, at most ``TRAIN_ROWS`` of either label, those
with the smallest hashes of their ids: each tree splits a random sample of good ones by random thresholds of random
statistics. A document that few splits set apart from all others has short paths, hence a high anomaly score. All
labelled rows that pass the base rules, sampled or not, set the threshold by a histogram of their scores in ``BINS``
bins: the score that best tells good from bad, but with at most ``LOSS`` of the good ones above it. Where the labels lack
one of the two kinds, the forest rejects nothing.

Cases: a null or empty text has no words and fails the base rules; words repeated throughout fail; documents without a
label are judged like the others; of several labels for one id all count; equal rows are judged alike, each its own
row; an empty table gives no rows; other columns are left out, or kept whole by ``kept_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.shared import materialize
from voxelry.llm.text import Words, encode, released, slices, split_words, texts_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "doubled")
TRAIN_ROWS, TREES, TREE_ROWS, LOSS, BINS = 4000, 200, 256, 0.002, 1 << 16
#: Bytes of text that are measured at once.
MEASURE_BYTES = 2 << 20


def repeats(words: Words) -> np.ndarray:
    """Words of each text in three-word windows that occur twice or more in it."""
    codes, starts = words.codes, words.starts
    out = np.zeros(len(starts) - 1, np.int64)
    if len(codes) < 4:
        return out
    row = words.rows()
    n = len(codes) - 2
    inside = row[2:] == row[:n]
    base = np.int64(len(words.unique))
    # exact integers for windows, made dense again after each step so that they never overflow
    _, two = np.unique(codes[:-1] * base + codes[1:], return_inverse=True)
    at = np.flatnonzero(inside)
    _, three = np.unique(two[at] * base + codes[at + 2], return_inverse=True)
    _, own, times = np.unique(three * np.int64(len(out)) + row[at], return_inverse=True, return_counts=True)
    again = at[times[own] > 1]
    hit = np.zeros(len(codes), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(row[hit], minlength=len(out))


def doubled_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of the text."""
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    full = pc.match_substring_regex(flat, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))[full]
    code = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.bincount(row, minlength=len(texts))
    first = np.unique(code * np.int64(len(texts)) + row)
    return n, n - np.bincount(first % max(len(texts), 1), minlength=len(texts))


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts and the ratios, a row for each text."""
    words = split_words(texts)
    n, row = words.counts(), words.rows()
    size = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.bincount(row, weights=size[words.codes], minlength=len(n)).astype(np.int64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols, upper, digits, punct = count(r"[#*$%&|<>]"), count("[A-Z]"), count("[0-9]"), count("[.,;:!?]")
    lines, dup = doubled_lines(texts)
    repeat = repeats(words)
    same = np.bincount(row[1:][(words.codes[1:] == words.codes[:-1]) & (row[1:] == row[:-1])], minlength=len(n))
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    per = lambda x, y: np.log1p(100 * x / y)  # noqa: E731  shares of a few hundredths and of all count alike
    ratios = np.column_stack([chars / w, per(symbols, w), per(dup, np.maximum(lines, 1)), per(repeat, w), per(upper, c), per(digits, c), per(punct, w), per(same, w)])
    return np.column_stack([n, chars, symbols, dup, repeat]), ratios


MEASURED = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "ratios array<double>"])


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, MEASURE_BYTES):
                base, ratios = measure(texts.slice(a, b - a))
                columns = {"doc_id": batch.column("doc_id").slice(a, b - a)} | {c: pa.array(base[:, i], pa.int64()) for i, c in enumerate(BASE)}
                yield pa.record_batch(columns | {"ratios": pa.array(list(ratios), pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), MEASURED)


class Forest:
    """Random isolation trees in arrays: a node's statistic, threshold and children; leaves hold path lengths.

    Thresholds come from a node's part of a box, at the root the range of all labelled rows, good and bad, and not from
    the range of the sample alone: else no tree could split on a statistic in which good documents do not vary.
    """

    def __init__(self, rows: np.ndarray, others: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        take = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(take, 2)))))
        self.usual = self.mean_path(take)
        size = (1 << self.depth + 1) - 1
        self.feature, self.split, self.path = np.zeros((trees, size), np.int64), np.full((trees, size), np.nan), np.zeros((trees, size))
        every = np.concatenate([rows, others])
        for t in range(trees):
            pick = rows[rng.choice(len(rows), take, replace=False)]
            self.grow(t, 0, 0, pick, every.min(axis=0), every.max(axis=0), rng)

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean length of an unsuccessful search among n keys in a random binary tree."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, t: int, node: int, depth: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self.path[t, node] = depth + self.mean_path(len(rows))
            return
        f = int(rng.choice(wide))
        s = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, s
        left = rows[:, f] < s
        below, above = high.copy(), low.copy()
        below[f] = above[f] = s
        self.grow(t, 2 * node + 1, depth + 1, rows[left], low, below, rng)
        self.grow(t, 2 * node + 2, depth + 1, rows[~left], above, high, rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; higher is odder."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                s = self.split[t, node]
                inner = ~np.isnan(s)
                step = 2 * node + np.where(rows[at, self.feature[t, node]] < s, 1, 2)
                node = np.where(inner, step, node)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


def calibrated(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The score above which to reject: the widest gap between the shares of bad and good above it, within ``loss``."""
    at = np.unique(np.concatenate([good, bad]))
    count = lambda x: np.bincount(np.searchsorted(at, x), minlength=len(at))
    return threshold(at, at, count(good), count(bad), loss)


def threshold(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The same from the least and the greatest score and the counts of each bin, bins in order."""
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda n: 1 - np.cumsum(n) / n.sum()
    gain = np.where(above(good) <= loss, above(bad) - above(good), -1.0)
    best = int(np.argmax(gain))
    return float((high[best] + low[best + 1]) / 2) if best + 1 < len(low) else float(high[best])


@dataclass
class Verdict:
    """A forest and the score above which it rejects; without a forest nothing is rejected."""

    forest: Forest | None
    limit: float

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return self.forest.scores(ratios) if self.forest else np.zeros(len(ratios))


def learned(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Verdict:
    """The verdict of the forest fitted on the labelled ones of measured ``rows`` that pass the base rules."""
    known = rows.filter(~base_failed()).join(labels.filter("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    known = materialize(known.select("quality", "ratios", F.xxhash64("doc_id").alias("h")), "labelled")
    pick = lambda q: np.array([r.ratios for r in known.filter(F.col("quality") == q).orderBy("h").limit(train_rows).collect()]).reshape(-1, len(RATIOS))
    good, bad = pick(1), pick(0)
    if not len(good):
        return Verdict(None, float("inf"))
    forest = Forest(good, bad)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("ratios").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RATIOS))
            yield pa.record_batch({"quality": batch.column("quality"), "score": pa.array(shared.value.scores(x))})

    every = known.select("quality", "ratios").mapInArrow(score, f"quality {known.schema['quality'].dataType.simpleString()}, score double")
    count = lambda q: F.sum((F.col("quality") == q).cast("long"))
    bins = every.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), count(1).alias("good"), count(0).alias("bad"))
    found = sorted(bins.collect(), key=lambda b: b.bin)  # at most BINS + 1 rows
    return Verdict(forest, threshold(*(np.array([b[c] for b in found]) for c in ("low", "high", "good", "bad"))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for each row of ``docs``."""
    rows = materialize(measured(docs), "measured")
    verdict = learned(rows, labels, train_rows)
    shared, names = docs.sparkSession.sparkContext.broadcast(verdict), ("doc_id", *BASE, "base_failed")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("ratios").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RATIOS))
            yield pa.record_batch({c: batch.column(c) for c in names} | {"score": pa.array(shared.value.scores(x))})

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean, score double"])
    scored = rows.withColumn("base_failed", base_failed()).select(*names, "ratios").mapInArrow(judge, schema)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= verdict.limit))


def kept_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with all columns, without the rows that the rules reject. Each row is judged where it stands, by being
    measured again: no text is shuffled, and rows of one id do not share a verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(measured(docs), labels, train_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = shared.value
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, MEASURE_BYTES):
                base, ratios = measure(texts.slice(a, b - a))
                n, repeat = base[:, BASE.index("n_words")], base[:, BASE.index("n_repeat_words")]
                good = (n >= 50) & (100 * repeat <= 50 * n) & (verdict.scores(ratios) <= verdict.limit)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(released(keep), docs.schema)
