"""Packing documents into windows: non-negative least squares over combinations of piece lengths.

Every document is cut into full windows and one rest. The rests' lengths make a histogram of at most ``window`` counts,
the only thing that reaches the driver. Combinations of two and three lengths that fill a window are enumerated from
it, non-negative least squares finds how often to use each, the counts are rounded down, and what is left of the
histogram is packed greedily, length class by length class. Rests then take their places by rank within their length:
a rank is counted in buckets of the document id, so that no length, however common, meets in one task. At most ``most``
combinations enter the least squares, those with the most pieces first; that may cost padding, never a piece.

Cases: a null or empty text is its end id alone; rows with equal ids are packed each for itself; an empty table gives
no rows; other columns are left out; a rest of a power of two needs no padding and may stand alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import materialize
from voxelry.llm.text import TOKEN_BYTES, released, slices, texts_of, word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of each document in its order: full windows, then the rest if there is one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, TOKEN_BYTES):
                ids, starts = encoder.ids(texts.slice(a, b - a), end_id)
                sizes = np.diff(starts)
                n = -(-sizes // window)
                row = np.repeat(np.arange(b - a), n)
                at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, sizes[row] - at)
                begin = starts[row] + at
                raw = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (at, length, crcs, sizes[row]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(pieces), PIECES)


def combinations(counts: np.ndarray, window: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Two or three lengths that occur and fill a window, those with the most pieces first; longest length first."""
    there = np.flatnonzero(counts)
    twos = [(int(window - a), int(a)) for a in there if 2 * a <= window and counts[window - a]]
    threes: list[tuple[int, tuple[int, ...]]] = []
    for c in there[np.argsort(-counts[there], kind="stable")][:64]:
        b = there[(there >= c) & (there <= (window - c) // 2)]
        a = window - c - b
        ok = counts[a] > 0
        threes += [(int(min(counts[x], counts[y], counts[c])), (int(x), int(y), int(c))) for x, y in zip(a[ok], b[ok], strict=True)]
    threes.sort(key=lambda t: (-t[0], t[1]))
    return twos + [t for _, t in threes[: max(0, most - len(twos))]]


def nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with the sum over patterns of x * (uses of each length) close to ``counts``: accelerated
    projected gradient on the sparse system, begun at zero, fixed in its number of steps."""
    if not patterns:
        return np.zeros(0)
    row = np.array([a for p in patterns for a in p])
    col = np.array([i for i, p in enumerate(patterns) for _ in p])
    times = lambda x: np.bincount(row, weights=x[col], minlength=len(counts))
    back = lambda y: np.bincount(col, weights=y[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(times(v))
        step = 1 / np.linalg.norm(v)
        v *= step
    step *= 0.95
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(times(z) - counts))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, z, t = new, new + (t - 1) / after * (new - x), after
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences use each, over all of ``counts`` (index: length)."""
    left = counts.astype(np.int64).copy()
    patterns = combinations(left, window)
    found = []
    for p, n in zip(patterns, np.floor(nnls(patterns, left.astype(float)) + 1e-6).astype(np.int64), strict=True):
        n = min(int(n), *(int(left[a]) // p.count(a) for a in p))
        if n > 0:
            found.append((p, n))
            for a in p:
                left[a] -= n
    while (there := np.flatnonzero(left)).size:
        # the longest rest, then again and again the longest that still fits
        p, room, used = [], window, {}
        while room:
            fit = there[there <= room]
            fit = next((int(a) for a in fit[::-1] if left[a] > used.get(int(a), 0)), 0)
            if not fit:
                break
            p.append(fit)
            used[fit] = used.get(fit, 0) + 1
            room -= fit
        n = min(int(left[a]) // k for a, k in used.items())
        found.append((tuple(p), n))
        for a, k in used.items():
            left[a] -= n * k
    return found


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, buckets: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence_id and offset.

    ``buckets`` splits the count of ranks within a length; by default there are four for each shuffle partition.
    """
    buckets = buckets or max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialize(cut(docs, tokenizer, end_id, window), "pieces")
    rests = pieces.filter(F.col("length") < window).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(buckets)))
    per = rests.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    sums = per.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most ``window`` rows
    counts = np.zeros(window + 1, np.int64)
    for r in sums:
        counts[r["length"]] = r["n"]
    found = plan(counts, window)

    # for each length, consecutive ranks go to the places of consecutive patterns
    taken, places, base = np.zeros(window + 1, np.int64), [], 0
    for p, n in found:
        offset = 0
        for a in p:
            places.append((a, int(taken[a]), base, offset))
            taken[a] += n
            offset += a
        base += n
    places.sort()
    place = np.array(places, np.int64).reshape(-1, 4)
    key = place[:, 0] << 44 | place[:, 1]  # length, then first rank

    own = Window.partitionBy("length", "_bucket")
    before = per.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_base", F.lit(0)).alias("_base"))
    ranked = rests.withColumn("_rank", F.row_number().over(own.orderBy("doc_id", "start", "ids_crc32")) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.record_batch(columns | {"sequence_id": pa.array(place[at, 2] + rank - place[at, 1]), "offset": pa.array(place[at, 3])})

    out = f"{PIECES}, sequence_id long, offset long"
    small = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(placed, out)

    # full windows: numbers by bucket too
    full = pieces.filter(F.col("length") == window).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(buckets)))
    each = full.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))  # ``buckets`` rows
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1 + F.coalesce("_base", F.lit(0)) + F.lit(base)
    whole = full.join(F.broadcast(each.drop("_n")), "_bucket").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(whole)
