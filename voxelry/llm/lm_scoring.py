"""Language-model scores by prediction by partial matching (PPM) over bytes, pretrained on part of the documents.

The model is a trie of byte contexts up to ``depth`` deep with the counts of what followed them in the training texts.
A byte's probability comes from the longest context in which it was seen. Each longer context that is known but lacks
the byte costs its escape (method D: half a count from each distinct successor goes to the escape), and the bytes seen there
are excluded from the counts of the shorter ones. Texts are lower-cased (A-Z), begin in a context of ``MARK`` bytes,
which no UTF-8 text holds, and end with one ``MARK``.

What is gathered from the corpus: counts of all words and of all byte runs of ``depth + 1``, both summed within tasks
first. Since a byte's cost depends on its ``depth`` predecessors alone, the trie becomes one table from runs to costs,
for the runs of all documents, seen in training or not. The depth is the same at every size: orders up to ``LOW`` are
gathered and broadcast (runs of three bytes, bounded by the alphabet), and a cost of a higher order needs only runs that
share the ``LOW + 1`` bytes before the last, so the table is costed in groups of those. Neither costs nor word counts
are bounded, so only the most frequent runs and words, ``COSTS`` and ``FREQUENT`` at most, are broadcast; all others are
looked up by a join on the run or on the word's hash and summed by document.

Cases: null and empty texts are one end token; white space alone too; equal rows score alike, each its own row; null
document ids count as the empty string in the split; very long texts are read in windows; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.shared import least_frequent, materialize
from voxelry.llm.text import slices, split_words, texts_of, word_hashes

DEPTH, FREQUENT, MARK = 5, 1 << 17, 0xFF
#: The highest order that is broadcast whole, the runs whose costs are broadcast at most, and those costed at once.
LOW, COSTS, GROUP = 2, 2_000_000, 200_000
#: Bytes of text whose runs are in memory at once.
RUN_BYTES = 2 << 20


def is_held_out(doc_ids: list[int | None], parts: int = 7, part: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % parts == part for i in doc_ids], bool)


def runs(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of depth + 1 bytes as integers, one for each byte of each text and its end, and how many each text has."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(pc.ascii_lower(texts).cast(pa.large_binary()).to_pylist()), np.uint8)
    padded = np.full(int(sizes.sum()) + len(texts) * (depth + 1), MARK, np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    padded[np.arange(len(data)) + depth + row * (depth + 1)] = data
    out = np.zeros(len(data) + len(texts), np.uint64)
    at = np.arange(len(out)) + np.repeat(np.arange(len(texts)) * depth, sizes + 1)
    for k in range(depth + 1):
        out = out << np.uint64(8) | padded[at + k]
    return out, sizes + 1


def run_windows(texts: pa.Array, depth: int, limit: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of at most about ``limit`` bytes of text at a time, and each run's text; a longer text comes in windows."""
    for a, b in slices(texts, limit):
        part = texts.slice(a, b - a)
        if b - a > 1 or len(part[0].as_buffer()) <= limit:
            found, sizes = runs(part, depth)
            yield found, np.repeat(np.arange(a, b), sizes)
            continue
        whole = np.frombuffer(pc.ascii_lower(part)[0].as_buffer(), np.uint8)
        padded = np.concatenate([np.full(depth, MARK, np.uint8), whole, np.full(1, MARK, np.uint8)])
        for k in range(0, len(whole) + 1, limit):
            own = padded[k : k + limit + depth]
            out = np.zeros(len(own) - depth, np.uint64)
            for i in range(depth + 1):
                out = out << np.uint64(8) | own[i : i + len(out)]
            yield out, np.full(len(out), a)


def run_counts(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and their counts, gathered from small windows so that only those are in memory at once."""
    parts = [np.unique(found, return_counts=True) for found, _ in run_windows(texts, depth)]
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


COUNTS = "kind int, key long, n long, m long"


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """Counts over the training documents (n) and all documents (m): kind 0 of word hashes and kind 2 of documents, of
    training only, kind 1 of byte runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, held = texts_of(batch), is_held_out(batch.column("doc_id").to_pylist())
            for train, texts in ((1, every.filter(pa.array(~held))), (0, every.filter(pa.array(held)))):
                for a, b in slices(texts):
                    part = texts.slice(a, b - a)
                    found = [(1, *run_counts(part, depth))]
                    if train:
                        words = split_words(part, lower=True)
                        found += [(0, word_hashes(words.unique), np.bincount(words.codes, minlength=len(words.unique))), (2, np.zeros(1, np.uint64), np.array([b - a]))]
                    for kind, keys, sums in found:
                        sums = sums.astype(np.int64)
                        yield pa.record_batch({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(sums * train), "m": pa.array(sums)})

    each = docs.select("doc_id", "text").mapInArrow(count, COUNTS)
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Trie:
    """Costs (log10 of probabilities) of runs of depth + 1 bytes, from the counts of the training runs.

    With ``low``, the trie of the lower orders over all training runs, ``grams`` need to be whole only for the contexts
    of ``low.depth + 1`` bytes that occur in them, and no table of their costs is made.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, low: Trie | None = None):
        self.depth = depth
        # each order's runs of order + 1 bytes, their counts, and their contexts' sums
        self.runs, self.n, self.contexts, self.total, self.kinds = [], [], [], [], []
        for order in range(depth + 1):
            if low and order <= low.depth:
                for own, whole in ((self.runs, low.runs), (self.n, low.n), (self.contexts, low.contexts), (self.total, low.total), (self.kinds, low.kinds)):
                    own.append(whole[order])
                continue
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys, inverse = np.unique(grams & mask, return_inverse=True)
            sums = np.bincount(inverse, weights=n, minlength=len(keys))
            context, back = np.unique(keys >> np.uint64(8), return_inverse=True)
            self.runs.append(keys), self.n.append(sums), self.contexts.append(context)
            self.total.append(np.bincount(back, weights=sums, minlength=len(context)))
            self.kinds.append(np.bincount(back, minlength=len(context)).astype(float))
        # for each context of order k + 1, what its successors take from the counts of order k
        self.excluded = []
        for order in range(depth):
            if low and order < low.depth:
                self.excluded.append(low.excluded[order])
                continue
            keys = self.runs[order + 1]
            at = np.searchsorted(self.runs[order], keys & np.uint64((1 << 8 * (order + 1)) - 1))
            back = np.searchsorted(self.contexts[order + 1], keys >> np.uint64(8))
            self.excluded.append(np.bincount(back, weights=self.n[order][at], minlength=len(self.contexts[order + 1])))
        if not low:
            self.table, self.costs = self.runs[depth], self.cost(self.runs[depth]).astype(np.float32)

    @staticmethod
    def find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        return at, keys[at] == sought

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte after the others, for any runs."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        longer, known_longer = np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        for order in range(self.depth, -1, -1):
            part = grams & np.uint64((1 << 8 * (order + 1)) - 1)
            at, known = self.find(self.contexts[order], part >> np.uint64(8))
            total, kinds = self.total[order][at] if len(self.contexts[order]) else out, self.kinds[order][at] if len(self.contexts[order]) else out
            if order < self.depth and len(self.contexts[order + 1]):
                total = total - np.where(known_longer, self.excluded[order][longer], 0)
                kinds = kinds - np.where(known_longer, self.kinds[order + 1][longer], 0)
            run, seen = self.find(self.runs[order], part)
            live = open_ & known & (kinds > 0)
            hit = live & seen
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(hit, out + np.log10((self.n[order][run] - 0.5) / total) if len(self.n[order]) else out, np.where(live, out + np.log10(kinds / 2 / total), out))
            open_ &= ~hit
            longer, known_longer = at, known
        never = 256 - (len(self.runs[0]) if len(self.runs[0]) else 0)
        return np.where(open_, out - np.log10(max(never, 1)), out)


class Lookup:
    """Positions of 64-bit keys among distinct ones, through a directory by leading hash bits."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        slot = self.slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.first = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each is (0 if nowhere), and whether it is there."""
        slot = self.slot(sought)
        at, end = self.first[slot], self.first[slot + 1]
        out, there = np.zeros(len(sought), np.int32), np.zeros(len(sought), bool)
        rest = np.flatnonzero(at < end)
        while len(rest):
            hit = self.keys[at[rest]] == sought[rest]
            done = rest[hit]
            out[done], there[done] = self.order[at[done]], True
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out, there


def run_costs(count: DataFrame, depth: int) -> DataFrame:
    """key, m (how often it occurs) and cost of each run of the documents."""
    runs, spark = count.filter("kind = 1").select("key", "n", "m"), count.sparkSession
    order = min(depth, LOW)
    found = runs.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(Trie(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy(), order))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // GROUP + 1)
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))

    def price(rows: pa.Table) -> pa.Table:
        keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        trie = Trie(keys[n > 0], n[n > 0], depth, shared.value)
        return pa.table({"key": rows["key"], "m": rows["m"], "cost": pa.array(trie.cost(keys).astype(np.float32))})

    return runs.groupBy(F.pmod(F.xxhash64(context), F.lit(groups))).applyInArrow(price, "key long, m long, cost float")


SCORED = "doc_id long, held_out boolean, n_tokens long, score double, frequent_known long, frequent_score double, rare array<long>, rare_runs array<long>"


def scores(docs: DataFrame, depth: int = DEPTH, costs: int = COSTS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    count = materialize(counts(docs, depth), "counts")
    words = count.filter("kind = 0").select("key", "n")
    ends = count.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    n_words, v_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + ends, v_words + (1 if ends else 0)
    top = words.filter(F.col("n") >= least_frequent(words, frequent)).toArrow()  # at most ``frequent`` rows
    top_keys, top_n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(top_keys)
    cost_of = materialize(run_costs(count, depth), "costs")
    usual = least_frequent(cost_of.select("key", F.col("m").alias("n")), costs)
    top_runs = cost_of.filter(F.col("m") >= usual).select("key", "cost").toArrow()  # at most ``costs`` rows
    shared, number = sc.broadcast((top_runs["key"].to_numpy().view(np.uint64), top_runs["cost"].to_numpy(), top_keys[order], top_n[order], ends)), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_keys, run_cost, keys, n, end = shared.value
        find = lookup_of(number, run_keys)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, RUN_BYTES):
                part, ids = texts.slice(a, b - a), batch.column("doc_id").slice(a, b - a)
                words, rows = split_words(part, lower=True), b - a
                hashes = word_hashes(words.unique)
                at, there = Trie.find(keys, hashes)
                c = np.where(there, n[at], 0) if len(n) else np.zeros(len(hashes))
                row = words.rows()
                known, value = there[words.codes], np.log10(c + 1.0)[words.codes]
                rare = hashes[words.codes[~known]].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=rows))])
                sums, others, n_others = np.zeros(rows), [], np.zeros(rows, np.int64)
                for grams, of in run_windows(part, depth):
                    place, seen = find(grams)
                    if len(run_keys):
                        sums += np.bincount(of, weights=np.where(seen, run_cost[place], 0.0), minlength=rows)
                    others.append(grams[~seen].view(np.int64))
                    n_others += np.bincount(of[~seen], minlength=rows)
                run_offsets = np.concatenate([[0], np.cumsum(n_others)])
                yield pa.record_batch({
                    "doc_id": ids, "held_out": pa.array(is_held_out(ids.to_pylist())),
                    "n_tokens": pa.array(words.counts() + 1), "score": pa.array(sums),
                    "frequent_known": pa.array(np.bincount(row[known], minlength=rows).astype(np.int64) + (end > 0)),
                    "frequent_score": pa.array(np.bincount(row, weights=value, minlength=rows) + np.log10(end + 1.0)),
                    "rare": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare)),
                    "rare_runs": pa.ListArray.from_arrays(pa.array(run_offsets, pa.int32()), pa.array(np.concatenate(others))),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORED)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("_row", F.explode("rare").alias("key")).join(words, "key").groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("_value"))
    others = cost_of.filter(F.col("m") < usual).select("key", "cost")
    rare_runs = rows.select("_row", F.explode("rare_runs").alias("key")).join(others, "key").groupBy("_row").agg(F.sum(F.col("cost").cast("double")).alias("_cost"))
    out = rows.drop("rare", "rare_runs").join(rare, "_row", "left").join(rare_runs, "_row", "left")
    base = F.col("frequent_score") + F.coalesce("_value", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("frequent_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("_cost", F.lit(0.0))).alias("score"))


_lookups: dict[str, Lookup] = {}


def lookup_of(number: str, keys: np.ndarray) -> Lookup:
    """One directory for each broadcast table in a Python worker; an older one goes."""
    if number not in _lookups:
        _lookups.clear()
        _lookups[number] = Lookup(keys)
    return _lookups[number]
