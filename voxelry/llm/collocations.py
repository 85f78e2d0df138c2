"""Phrases that keep together, from lossless counts of n-grams in counting quotient filters.

1. Each chunk of documents sends its distinct words with their counts to shards by the word's hash; a shard adds them up,
   numbers those of at least ``LEAST`` occurrences and answers each chunk with numbers.
2. A chunk packs each run of 2 to 4 numbered words into one integer and counts it in a filter: an invertible permutation
   (a Feistel network, or one multiplication and shifts) spreads the integers, the upper bits are the quotient, all others
   the remainder. A filter keeps its entries sorted, a bit for each quotient that occurs, a bit for each run's end, the
   remainders in as few bits as they need, and counts in a byte each with longer ones aside.
3. The filters of a shard of the quotients are merged in order and their equal entries added up; what counts ``LEAST`` at
   least is permuted back into word numbers. The filters lose nothing, so counts are exact.
4. Cuts, containment and ranks are joins, groupings and a window over these phrases; products are decimals.

Everything is within a language; a word of two languages has two numbers, so a language's n-grams are its own.

Cases: null and empty texts have no words; a null language is ``und``, together with rows that say so; ties in rank are
broken by the phrase's bytes; repeated rows count repeatedly; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.chunks import by_group, chunked, packed, unpacked, with_answers
from voxelry.llm.shared import materialize
from voxelry.llm.text import byte_hashes, split_words, texts_of

LEAST, LONGEST, TOP = 30, 4, 2000
#: Words, and n-grams, that a shard gets at most if all differ (about).
SHARD_WORDS, SHARD_GRAMS = 1 << 20, 1 << 22
#: Bytes as the splitter wants them: A-Z lower, a line feed for what ends a piece, a space between words.
TABLE = np.arange(256, dtype=np.uint8)
TABLE[65:91] += 32
TABLE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10
TABLE[9] = 32
ONE = np.uint64(1)


def u64(n: int) -> np.uint64:
    return np.uint64(n)


def mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Shape:
    """How n-grams of ``n`` words of ``bits`` bits each lie in two integers, ``high`` and ``low`` bits wide.

    Up to 64 bits are one integer (``low`` is 0); more are two halves.
    """

    n: int
    bits: int

    @property
    def one(self) -> bool:
        return self.n * self.bits <= 64

    @property
    def high(self) -> int:
        return self.n * self.bits if self.one else 2 * self.bits

    @property
    def low(self) -> int:
        return self.n * self.bits - self.high

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        join = lambda parts: parts[0].astype(np.uint64) if len(parts) == 1 else (join(parts[:-1]) << u64(self.bits)) | parts[-1].astype(np.uint64)
        return (join(ids), np.zeros(len(ids[0]), np.uint64)) if self.one else (join(ids[:2]), join(ids[2:]))

    def unpack(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        take = lambda x, k: [((x >> u64(self.bits * (k - 1 - i))) & mask(self.bits)).astype(np.int64) for i in range(k)]
        return take(high, self.n) if self.one else take(high, 2) + take(low, self.n - 2)

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.one:
            for key in KEYS:
                low = low ^ (stirred(high, key) & mask(self.low))
                high = high ^ (stirred(low, ~key) & mask(self.high))
            return high, low
        for key in KEYS:
            high = (high * key) & mask(self.high)
            high = high ^ (high >> u64(self.high // 2))
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.one:
            for key in reversed(KEYS):
                high = high ^ (stirred(low, ~key) & mask(self.high))
                low = low ^ (stirred(high, key) & mask(self.low))
            return high, low
        half = self.high // 2
        for key in reversed(KEYS):
            x = high ^ (high >> u64(half))
            if self.high % 2:  # three shifts cover an odd width
                x = high ^ (x >> u64(half))
            high = (x * u64(pow(int(key), -1, 1 << 64))) & mask(self.high)
        return high, low


#: Odd multipliers, so that multiplication has an inverse.
KEYS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def stirred(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ (x >> u64(31))) * (key | ONE)
    return (x ^ (x >> u64(29))) * KEYS[2]


def in_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """The values' lower ``bits``, one value after the other."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)])
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")


def from_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and bits:
        each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
        out[:, : -(-bits // 8)] = np.packbits(each, axis=1, bitorder="little")
    return out.view("<u8").ravel().astype(np.uint64)


def added(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values and the sums of their counts."""
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    if counts is None and not low.any():
        high = np.sort(high)
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        return high[first], low[first], np.diff(np.append(first, len(high)))
    order = np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    same = np.flatnonzero(high[1:] == high[:-1])
    if len(same) and (low[same] != low[same + 1]).any():
        again = np.lexsort((low, high))
        order, high, low = order[again], high[again], low[again]
    first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    sums = np.diff(np.append(first, len(high))) if counts is None else np.add.reduceat(counts[order], first)
    return high[first], low[first], sums


@dataclass
class QuotientFilter:
    """Permuted n-grams of one shard and their counts, sorted."""

    shape: Shape
    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    def to_bytes(self, prefix: int) -> bytes:
        """``prefix``: upper bits that all entries of the shard have in common but for a few."""
        n = len(self.high)
        quotient = min(self.shape.high, prefix + max(1, n.bit_length()))
        rest = self.shape.high - quotient
        q = (self.high >> u64(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
        base = int(q[0]) if n else 0
        ends = np.append(q[1:] != q[:-1], True)[:n]
        there = np.zeros(int(q[-1]) - base + 1 if n else 0, bool)
        there[q - base] = True
        long = np.flatnonzero(self.counts >= 255)
        column = lambda *arrays: [np.ascontiguousarray(a).tobytes() for a in arrays]
        parts = column(np.packbits(there), np.packbits(ends), in_bits(self.high & mask(rest), rest), in_bits(self.low, self.shape.low), np.minimum(self.counts, 255).astype(np.uint8), long.astype("<i8"), self.counts[long].astype("<i8"))
        return packed(pa.table({"numbers": pa.array([[n, quotient, base, len(there)]]), "parts": pa.array([parts], pa.list_(pa.binary()))}))

    @staticmethod
    def from_bytes(shape: Shape, data: bytes) -> QuotientFilter:
        row = unpacked(data).to_pylist()[0]
        (n, quotient, base, places), (there, ends, high, low, counts, long, more) = row["numbers"], row["parts"]
        rest = shape.high - quotient
        bits = lambda raw, k: np.unpackbits(np.frombuffer(raw, np.uint8), count=k)
        occupied = np.flatnonzero(bits(there, places)) + base
        run = np.cumsum(bits(ends, n), dtype=np.int64) - bits(ends, n)  # runs that ended before
        q = occupied[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        sums = np.frombuffer(counts, np.uint8).astype(np.int64)
        sums[np.frombuffer(long, "<i8")] = np.frombuffer(more, "<i8")
        return QuotientFilter(shape, (q << u64(rest)) | from_bits(high, n, rest), from_bits(low, n, shape.low), sums)

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        shape = filters[0].shape
        join = lambda name: np.concatenate([getattr(f, name) for f in filters])
        return QuotientFilter(shape, *added(join("high"), join("low"), join("counts")))

    def grams(self, least: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
        """Word numbers and counts of the entries that count ``least`` at least."""
        often = self.counts >= least
        return self.shape.unpack(*self.shape.restore(self.high[often], self.low[often])), self.counts[often]


@dataclass
class Tokens:
    """Words of a chunk: ``codes`` point to ``words``, ``langs`` to ``names``; ``piece`` tells pieces apart."""

    codes: np.ndarray
    langs: np.ndarray
    piece: np.ndarray
    words: pa.Array
    names: pa.Array


def tokens(group: pa.Table) -> Tokens:
    batch = group.combine_chunks().to_batches()[0]
    texts, langs = texts_of(batch), batch.column("lang").dictionary_encode()
    texts = pa.concat_arrays([texts])  # offsets from 0 on
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    plain = TABLE[raw[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    words = split_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(plain)))
    # where words begin, and how many ends of pieces come before
    word = plain > 32
    word |= (plain != 32) & (plain != 10)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins[starts] = word[starts]
    breaks = plain == 10
    breaks[starts] = True
    piece = np.cumsum(breaks)[begins]
    # a text's first word may lie on the very byte that counts as its break
    of = words.rows()
    return Tokens(words.codes, langs.indices.to_numpy().astype(np.int64)[of], piece + of, words.unique, langs.dictionary)


def pairs_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (language, word) pairs as sorted keys, which of them each token is, and their counts."""
    keys, inverse, counts = np.unique(t.langs * max(1, len(t.words)) + t.codes, return_inverse=True, return_counts=True)
    return keys, inverse, counts


def order_in(t: Tokens, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """An order of the pairs by shard, language and word; where each shard ends; and the pairs in that order."""
    m = max(1, len(t.words))
    word, lang = t.words.take(pa.array(keys % m)), t.names.take(pa.array(keys // m))
    shard = (byte_hashes(t.words)[keys % m] >> u64(11)) % u64(shards)
    table = pa.table({"shard": shard.astype(np.int64), "lang": lang, "word": word.cast(pa.string())})
    order = pc.sort_indices(table, [("shard", "ascending"), ("lang", "ascending"), ("word", "ascending")]).to_numpy()
    return order, np.searchsorted(shard[order].astype(np.int64), np.arange(1, shards + 1)), table.take(pa.array(order)).drop_columns("shard")


def told(group: pa.Table, shards: int) -> pa.Table:
    """A chunk's words for each shard."""
    t = tokens(group)
    keys, _, counts = pairs_of(t)
    order, ends, table = order_in(t, keys, shards)
    table = table.append_column("n", pa.array(counts[order]))
    starts = np.append(0, ends[:-1])
    shard = np.flatnonzero(ends > starts)
    data = [packed(table.slice(int(starts[s]), int(ends[s] - starts[s]))) for s in shard]
    return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()] * len(shard), pa.int64()), "shard": pa.array(shard, pa.int32()), "data": pa.array(data, pa.binary())})


NUMBERED = "chunk long, shard int, data binary, lang string, word string, id long, n long"


def numbered(group: pa.Table, shards: int, least: int) -> pa.Table:
    """One shard's words: an answer for each chunk (data: a number for each word sent, 0 for rare ones), a row for each
    numbered word, and one for each language with the sum over all words (word is null)."""
    parts = [unpacked(d) for d in group.column("data").to_pylist()]
    every = pa.concat_tables(parts).append_column("part", pa.array(np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])))
    sums = every.group_by(["lang", "word"]).aggregate([("n", "sum")])
    often = sums.filter(pc.greater_equal(sums["n_sum"], least)).sort_by([("lang", "ascending"), ("word", "ascending")])
    shard = group.column("shard")[0].as_py()
    # numbers of the shards interleave, from 1 on
    often = often.append_column("id", pa.array(np.arange(often.num_rows, dtype=np.int64) * shards + shard + 1))
    totals = sums.group_by("lang").aggregate([("n_sum", "sum")])
    place = {(a, b): i for a, b, i in zip(*(often[c].to_pylist() for c in ("lang", "word", "id")), strict=True)}
    answers = [packed(pa.table({"id": pa.array([place.get(k, 0) for k in zip(p["lang"].to_pylist(), p["word"].to_pylist(), strict=True)], pa.int64())})) for p in parts]
    k, m = often.num_rows, totals.num_rows
    none = lambda n, kind: pa.nulls(n, kind)
    return pa.concat_tables([
        pa.table({"chunk": group["chunk"], "shard": group["shard"], "data": pa.array(answers, pa.binary()), "lang": none(len(parts), pa.string()), "word": none(len(parts), pa.string()), "id": none(len(parts), pa.int64()), "n": none(len(parts), pa.int64())}),
        pa.table({"chunk": none(k, pa.int64()), "shard": none(k, pa.int32()), "data": none(k, pa.binary()), "lang": often["lang"].cast(pa.string()), "word": often["word"], "id": often["id"], "n": often["n_sum"]}),
        pa.table({"chunk": none(m, pa.int64()), "shard": none(m, pa.int32()), "data": none(m, pa.binary()), "lang": totals["lang"].cast(pa.string()), "word": none(m, pa.string()), "id": none(m, pa.int64()), "n": totals["n_sum_sum"]}),
    ])


def counted(group: pa.Table, answers: pa.Table, shards: int, bits: int, gram_bits: int) -> pa.Table:
    """A chunk's filters of 2 to ``LONGEST`` words, for each shard of 2 ** ``gram_bits``."""
    t = tokens(group)
    keys, inverse, _ = pairs_of(t)
    order, ends, _ = order_in(t, keys, shards)
    number = np.zeros(len(keys), np.int64)
    for shard, data in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True):
        number[order[int(ends[shard - 1]) if shard else 0 : int(ends[shard])]] = unpacked(data).column("id").to_numpy()
    ids = number[inverse]
    known, out = ids > 0, {"n": [], "shard": [], "data": []}
    whole = known
    for n in range(2, LONGEST + 1):
        m = len(ids) - n + 1
        if m <= 0:
            break
        whole = whole[:m] & known[n - 1 :] & (t.piece[:m] == t.piece[n - 1 :])
        shape, at = Shape(n, bits), np.flatnonzero(whole)
        high, low, counts = added(*shape.permute(*shape.pack([ids[at + k] for k in range(n)])))
        prefix = min(gram_bits, shape.high)
        cut = np.searchsorted(high >> u64(shape.high - prefix), np.arange(1, (1 << prefix) + 1, dtype=np.uint64)) if len(high) else np.zeros(1 << prefix, np.int64)
        for shard in np.flatnonzero(np.diff(cut, prepend=0)).tolist():
            a, b = (int(cut[shard - 1]) if shard else 0), int(cut[shard])
            out["n"].append(n), out["shard"].append(shard), out["data"].append(QuotientFilter(shape, high[a:b], low[a:b], counts[a:b]).to_bytes(prefix))
    return pa.table({"n": pa.array(out["n"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()), "data": pa.array(out["data"], pa.binary())})


def frequent(group: pa.Table, bits: int, least: int) -> pa.Table:
    """The phrases of one shard that its merged filter counts ``least`` times at least."""
    shape = Shape(group.column("n")[0].as_py(), bits)
    ids, counts = QuotientFilter.merge([QuotientFilter.from_bytes(shape, d) for d in group.column("data").to_pylist()]).grams(least)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * shape.n), pa.array(np.stack(ids, axis=1).ravel()))
    return pa.table({"ids": lists, "f": counts})


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted phrases (ids, f) of 1 to ``LONGEST`` words, words (id, lang, word), and sums by language (lang, n)."""
    chunks, size = chunked(docs, {"lang": F.coalesce("lang", F.lit("und")), "text": F.col("text")})
    shards = max(1, -(-size // 12 // SHARD_WORDS))
    gram_bits = max(0, int(size // 2 // SHARD_GRAMS)).bit_length()
    sent = by_group(chunks, ["chunk"], lambda g: told(g, shards), "chunk long, shard int, data binary")
    found = materialize(by_group(sent, ["shard"], lambda g: numbered(g, shards, least), NUMBERED), "words")
    words, totals = found.filter("id is not null"), found.filter("chunk is null and id is null").groupBy("lang").agg(F.sum("n").alias("n"))
    bits = int(found.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0]).bit_length()
    if bits > 31:
        raise ValueError("more than 2 ** 31 words of the least count")
    answers = found.filter("data is not null").select("chunk", "shard", "data")
    filters = with_answers(chunks, answers, lambda g, x: counted(g, x, shards, bits, gram_bits), "n int, shard int, data binary")
    grams = by_group(filters, ["n", "shard"], lambda g: frequent(g, bits, least), "ids array<long>, f long")
    every = materialize(grams.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("f"))), "phrases")
    return every, words.select("id", "lang", "word"), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 80) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``share``: percent of a phrase's count at which a longer phrase that holds it makes it go.
    """
    every, words, totals = phrases(docs, least)
    long = every.filter("size(ids) > 1")
    # phrases within longer ones
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    held = long.filter("size(ids) > 2").select(F.explode(F.array_distinct(inner)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    exact = lambda n: F.lit(n).cast("decimal(10,0)")
    kept = long.join(held, "ids", "left").filter(F.col("longer").isNull() | (exact(100) * F.col("longer").cast("decimal(20,0)") < exact(share) * F.col("f").cast("decimal(20,0)")))
    cuts = kept.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))"))
    best = cuts.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.*")
    # words of the phrases
    said = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words, "id").groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    rows = best.join(said, "ids").withColumn("phrase", F.concat_ws(" ", "w.word"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
