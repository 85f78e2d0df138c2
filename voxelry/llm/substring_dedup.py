"""Substring dedup: a count-min sketch finds windows that may repeat, an exact grouping decides, covered words go.

A window is ``SPAN`` consecutive words of one document; it is known by 96 bits of hash. Windows repeat where their words
also start earlier: at a smaller document id, at the same id and a smaller hash of the text, or earlier in the text.

1. Each chunk of documents sketches its windows: for each of ``ROWS`` rows the cells that they fall in, with counts of 1 or
   more. A sketch goes out in parts, one for each shard of the cells, as sorted gaps. A shard merges the parts by adding
   counters and answers each chunk with a bit for each of its cells: whether the cell counts 2 at least. A window whose
   cells all do may be repeated; cells only ever count too much, so no repeated window is lost.
2. Each chunk sends the first of each such window, and Spark groups them exactly by hash, the smallest place first.
3. A chunk learns which of its windows are first; the others' words are removed.

Texts are written once, in chunks, and not shuffled; cells for each window stay the same in number at every size
(``CELLS``), so that the sketch filters alike and no part of it is broadcast.

Cases: null and empty texts and texts without words have no words and give an empty text; texts of fewer than ``SPAN`` words
stay whole; rows with a null id come before all others; rows of one id are ordered by their text's hash; of equal rows
one keeps its words and the others lose those in windows; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.chunks import by_group, chunked, packed, unpacked, with_answers
from voxelry.llm.shared import materialize
from voxelry.llm.text import Words, byte_hashes, split_words, texts_of

SPAN = 20
#: Rows of the sketch, cells in each row for each window of the corpus (about), and cells of a row in a shard.
ROWS, CELLS, SHARD_CELLS = 2, 4, 1 << 22
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * P3
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def in_order(group: pa.Table) -> pa.RecordBatch:
    """A chunk's rows by id, nulls first, then the text's hash: the same in each pass."""
    at = pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("text_hash", "ascending")], null_placement="at_start")
    return group.take(at).combine_chunks().to_batches()[0] if group.num_rows else pa.RecordBatch.from_pylist([], group.schema)


def rolled(h: np.ndarray, span: int, by: np.uint64) -> np.ndarray:
    """A hash of each run of ``span`` values, from those of half as many."""
    if span == 1:
        return h
    half = rolled(h, span // 2, by)
    n = len(h) - span + 1
    first = half[:n] * np.uint64(pow(int(by), span // 2, 1 << 64)) + half[span // 2 : span // 2 + n]
    return first * by + h[span - 1 : span - 1 + n] if span % 2 else first


def windows(words: Words, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window starts among all words, 64 bits of its hash, and 32 more."""
    n = len(words.codes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = byte_hashes(words.unique)
    rows = words.rows()
    at = np.flatnonzero(rows[: n - span + 1] == rows[span - 1 :])
    a = spread_bits(rolled(h[words.codes], span, P1)[at])
    b = spread_bits(rolled(spread_bits(h + P2)[words.codes], span, P2)[at])
    return at, a, b & LOW


def cells_of(a: np.ndarray, b: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each row of the sketch the cell of each window: its shard, then a place in the shard."""
    shard = ((a >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return [shard * np.uint64(SHARD_CELLS) + (((x & LOW) * np.uint64(SHARD_CELLS)) >> np.uint64(32)) for x in (a, b)]


def gaps(cells: np.ndarray) -> np.ndarray:
    """Sorted distinct cells as differences in the narrowest type."""
    d = np.diff(cells, prepend=cells[:1] * 0)
    return d.astype(np.uint16 if not len(d) or d.max() < 1 << 16 else np.uint32)


def sketched(group: pa.Table, shards: int, span: int = SPAN) -> pa.Table:
    """A chunk's sketch: for each row and shard its cells and whether more than one window falls in each."""
    rows = in_order(group)
    _, a, b = windows(split_words(texts_of(rows)), span)
    out = {"shard": [], "row": [], "cells": [], "many": []}
    for row, cells in enumerate(cells_of(a, b, shards)):
        cells = np.sort(cells)
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(cells))) > 1
        cells = cells[first]
        ends = np.searchsorted(cells, np.arange(1, shards + 1, dtype=np.uint64) * np.uint64(SHARD_CELLS))
        for shard in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            x, y = (int(ends[shard - 1]) if shard else 0), int(ends[shard])
            g = gaps(cells[x:y] - np.uint64(shard * SHARD_CELLS))
            out["shard"].append(shard), out["row"].append(row), out["cells"].append(packed(pa.table({"gap": g}))), out["many"].append(np.packbits(many[x:y]).tobytes())
    chunk = rows.column("chunk")[0].as_py() if rows.num_rows else 0
    return pa.table({"chunk": pa.array([chunk] * len(out["row"]), pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "row": pa.array(out["row"], pa.int32()), "cells": pa.array(out["cells"], pa.binary()), "many": pa.array(out["many"], pa.binary())})


def merged(group: pa.Table) -> pa.Table:
    """One shard's row of the sketch, merged from the chunks' parts: for each part which of its cells count two at least."""
    counter = np.zeros(SHARD_CELLS, np.uint8)
    parts = []
    for cells, many in zip(group.column("cells").to_pylist(), group.column("many").to_pylist(), strict=True):
        at = np.cumsum(unpacked(cells).column("gap").to_numpy(), dtype=np.int64)
        more = np.unpackbits(np.frombuffer(many, np.uint8), count=len(at))
        counter[at] = np.minimum(counter[at] + 1 + more, 2)
        parts.append(at)
    bits = [np.packbits(counter[at] > 1).tobytes() for at in parts]
    return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "row": group.column("row"), "bits": pa.array(bits, pa.binary())})


def suspected(a: np.ndarray, b: np.ndarray, shards: int, answers: pa.Table) -> np.ndarray:
    """Which windows the merged sketch counts twice at least."""
    out = np.ones(len(a), bool)
    found = {(r["row"], r["shard"]): r["bits"] for r in answers.select(["row", "shard", "bits"]).to_pylist() if r["bits"] is not None}
    for row, cells in enumerate(cells_of(a, b, shards)):
        order = np.argsort(cells)
        ordered = cells[order]
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        known = ordered[new]
        sizes = np.diff(np.searchsorted(known, np.arange(1, shards + 1, dtype=np.uint64) * np.uint64(SHARD_CELLS)), prepend=0)
        twice = [np.unpackbits(np.frombuffer(found[row, s], np.uint8), count=int(sizes[s])) for s in np.flatnonzero(sizes).tolist()]
        if twice:
            out[order] &= np.concatenate(twice).astype(bool)[np.cumsum(new) - 1]
    return out


def candidates(group: pa.Table, answers: pa.Table, shards: int, span: int = SPAN) -> pa.Table:
    """The first of each window of a chunk that may be repeated."""
    rows = in_order(group)
    words = split_words(texts_of(rows))
    at, a, b = windows(words, span)
    there = np.flatnonzero(suspected(a, b, shards, answers))
    order = there[np.lexsort((there, b[there], a[there]))]
    first = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))] if len(order) else order
    first = np.sort(first)
    of = pa.array(words.rows()[at[first]])
    return pa.table({"hash_a": a[first].view(np.int64), "hash_b": b[first].astype(np.int64), "doc_id": rows.column("doc_id").take(of), "text_hash": rows.column("text_hash").take(of), "chunk": rows.column("chunk").take(of), "at": at[first]})


KEPT = "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>"


def cleaned(group: pa.Table, answers: pa.Table, shards: int, span: int = SPAN) -> pa.Table:
    """A chunk's rows without the words that repeated windows cover; ``answers`` has the sketch's and which windows are first."""
    rows = in_order(group)
    texts = texts_of(rows)
    words = split_words(texts)
    at, a, b = windows(words, span)
    again = suspected(a, b, shards, answers)
    first = answers.column("at").drop_null().to_numpy()
    again[np.searchsorted(at, first)] = False
    n = len(words.codes)
    edge = np.zeros(n + 1, np.int64)
    edge[at[again]] += 1
    edge[at[again] + span] -= 1  # at most n
    out = np.cumsum(edge[:n]) > 0
    of = words.rows()
    kept = np.flatnonzero(~out)
    offsets = np.zeros(rows.num_rows + 1, np.int64)
    np.cumsum(np.bincount(of[kept], minlength=rows.num_rows), out=offsets[1:])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), words.unique.take(pa.array(words.codes[kept])))
    # runs of removed words, cut where a document ends
    start = np.flatnonzero(out & np.append(True, ~out[:-1] | (of[1:] != of[:-1]))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(out & np.append(~out[1:] | (of[1:] != of[:-1]), True)) + 1 if n else start
    spans = pa.StructArray.from_arrays([pa.array(start - words.starts[of[start]]), pa.array(end - words.starts[of[start]])], ["start", "end"])
    runs = np.zeros(rows.num_rows + 1, np.int32)
    np.cumsum(np.bincount(of[start], minlength=rows.num_rows), out=runs[1:])
    return pa.table({
        "doc_id": rows.column("doc_id"), "n_words": words.counts(), "n_removed": words.counts() - np.diff(offsets),
        "text": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()), "removed": pa.ListArray.from_arrays(pa.array(runs), spans),
    })


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, its text of kept words joined by one space, and
    the removed ranges of words."""
    chunks, size = chunked(docs, {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text"), "text": F.col("text")})
    shards = max(1, -(-size // 6 * CELLS // SHARD_CELLS))  # a word and a space take about six bytes
    sketches = by_group(chunks, ["chunk"], lambda g: sketched(g, shards, span), "chunk long, shard int, row int, cells binary, many binary")
    answers = materialize(by_group(sketches, ["shard", "row"], merged, "chunk long, shard int, row int, bits binary"), "window-answers")
    rows = with_answers(chunks, answers, lambda g, x: candidates(g, x, shards, span), "hash_a long, hash_b long, doc_id long, text_hash long, chunk long, at long")
    first = rows.groupBy("hash_a", "hash_b").agg(F.min(F.struct("doc_id", "text_hash", "chunk", "at")).alias("first")).select("first.chunk", "first.at")
    both = answers.withColumn("at", F.lit(None).cast("long")).unionByName(first, allowMissingColumns=True)
    return with_answers(chunks, both, lambda g, x: cleaned(g, x, shards, span), KEPT)
