"""Near-duplicate groups: MinHash bands find candidates, odd sketches sieve them, full shingle sets confirm them.

A document's set holds 64-bit hashes of its distinct runs of five words. Rows with equal sets are one class, which has
the number of one of its rows and is represented by that row's text. ``BANDS`` bands of ``ROWS`` MinHash samples put
each class into buckets; a pair at a similarity of 0.75 shares no bucket with a probability of (1 - 0.75 ** 6) ** 64 <
4e-6, a pair at 0.8 with 5e-9. The samples are also folded into an odd sketch, a bitmap in which each sample flips one
bit; the number of ones in two sketches' XOR estimates how many samples differ, and a pair estimated well below the
threshold goes no further.

Links are found in rounds. In a bucket's first two rounds each member is held against the bucket's centre alone, so that
a group of m near copies costs m pairs and not m * m. Confirmed links join classes into components; a link within one
adds nothing. Where a bucket then still holds two components, its classes are joined on rare shingles (``rare_pairs``), an
exact way that refuses most pairs by size and place before they meet. All candidates that a lossless bound on plain
bitmaps lets through are confirmed or refused on their full sets, so that no link between components is lost.

Cases: null and empty texts and texts of white space have an empty set and stand alone; fewer than five words make one
shingle; equal rows are in one component; rows with one id and different texts are each judged by their own text; null
document ids form no component but come back with nulls; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.components import components
from voxelry.llm.shared import looked_up, materialize
from voxelry.llm.text import Words, released, slices, split_words, texts_of, word_hashes

SHINGLE, ROWS, BANDS, BITS, PLACES, THRESHOLD = 5, 6, 64, 1024, 2048, 0.75
SAMPLES = ROWS * BANDS
#: Pairs whose sketches estimate a similarity below this are refused: about six standard deviations under 0.75.
SIEVE = 0.60
#: Sizes of sets are told apart in steps of this factor before the sets meet.
STEP = 1.04
_rng = np.random.default_rng(20_011)
_MUL = _rng.integers(1, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_SALT = _rng.integers(1, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * P2
    x = (x ^ (x >> np.uint64(29))) * P2
    return x ^ (x >> np.uint64(32))


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h = word_hashes(words.unique)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    run = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        run = run * P1 + h[k : k + len(run)]
    run = mixed(run)
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(run[a : b - SHINGLE + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        else:
            one = np.zeros(min(1, b - a), np.uint64)
            for x in h[a:b]:
                one = one * P1 + x
            yield mixed(one + np.uint64(b - a))


def samples(s: np.ndarray, block: int = 512) -> np.ndarray:
    """MinHash samples of a set, under independent linear orders of its mixed hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), block):
        np.minimum(low, (_MUL[:, None] * x[None, a : a + block] + _ADD[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * P1 + low.reshape(BANDS, ROWS)[:, r])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """``BITS`` parities as int64 words: sample i flips the bit that a hash of i and its value names."""
    at = mixed(low.astype(np.uint64) * P1 + _SALT) % np.uint64(BITS)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def most_ones(similarity: float) -> int:
    """Ones expected in the XOR of two sketches at this similarity: 2 * SAMPLES * (1 - J) flips on BITS parities."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def bitmap(s: np.ndarray) -> np.ndarray:
    """``PLACES`` bits as int64 words: those that the set's hashes name."""
    bits = np.zeros(PLACES, np.uint8)
    bits[(s % np.uint64(PLACES)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8")


def may_link(n_a: str, n_b: str, bits_a: str, bits_b: str) -> Column:
    """Whether two sets can have the threshold's similarity: a bound that no pair above it fails.

    Each bit of one bitmap that the other lacks stands for a shingle of one set, at least, that the other lacks.
    """
    lack = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, n: t + n)
    percent = int(100 * THRESHOLD)
    # with m shingles in common at most, the union has n_a + n_b - m at least
    enough = lambda m: 100 * m >= percent * (F.col(n_a) + F.col(n_b) - m)
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & enough(F.col(n_a) - lack(bits_a, bits_b)) & enough(F.col(n_b) - lack(bits_b, bits_a))


SKETCHES = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>, bits array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text; the first two tell apart rows of one id with different texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 4 << 20):
                n, prints, bands, odd, bits = [], [], [], [], []
                last: dict[bytes, tuple] = {}
                for s in shingle_sets(split_words(texts.slice(a, b - a), lower=True)):
                    n.append(len(s))
                    print_ = xxhash.xxh3_128_digest(s.tobytes())
                    prints.append(print_)
                    if not len(s):
                        bands.append(None), odd.append(None), bits.append(None)
                        continue
                    if print_ not in last:
                        low = samples(s)
                        last[print_] = band_keys(low), odd_sketch(low), bitmap(s)
                    x, y, z = last[print_]
                    bands.append(x), odd.append(y), bits.append(z)
                two = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "text_hash": batch.column("text_hash").slice(a, b - a), "n_shingles": pa.array(n, pa.int64()),
                    "set_a": pa.array(two[:, 0]), "set_b": pa.array(two[:, 1]),
                    "bands": pa.array(bands, pa.list_(pa.int64())), "odd": pa.array(odd, pa.list_(pa.int64())),
                    "bits": pa.array(bits, pa.list_(pa.int64())),
                })

    return keyed(docs).mapInArrow(released(sketch), SKETCHES)


def sieved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches, sizes and bitmaps allow the threshold, with the ones in their sketches' XOR."""
    own = classes.select("id", "odd", "n_shingles", "bits")
    both = pairs.join(own.toDF("a", "odd_a", "n_a", "bits_a"), "a").join(own.toDF("b", "odd_b", "n_b", "bits_b"), "b")
    ones = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter(may_link("n_a", "n_b", "bits_a", "bits_b")).withColumn("ones", ones).filter(F.col("ones") <= most_ones(SIEVE)).select("a", "b", "ones")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= 75 * union; ``texts`` has id and text."""
    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            for a, b in slices(one, 4 << 20):
                keep = []
                left, right = (shingle_sets(split_words(x.slice(a, b - a), lower=True)) for x in (one, two))
                for s, t in zip(left, right, strict=True):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * common >= int(100 * THRESHOLD) * (len(s) + len(t) - common))
                yield batch.slice(a, b - a).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(released(check), "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, root (a class's number) and component (its smallest document id) of each row of
    ``docs``, the last two null where there is none; materialised."""
    rows = materialize(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = rows.filter("doc_id is not null and n_shingles > 0")
    of_set = materialize(known.groupBy("set_a", "set_b").agg(F.min("row").alias("id"), F.min("doc_id").alias("first"), F.count("*").alias("n")), "sets")
    classes = rows.join(of_set.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "doc_id", "text_hash", "n_shingles", "bands", "odd", "bits")
    classes = materialize(classes, "classes")

    # buckets with two classes at least, each member with the bucket's centre, and the texts of such classes
    members = classes.select("id", F.explode("bands").alias("bucket"))
    many = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "bucket")).alias("centre")).filter("n > 1")
    buckets = materialize(members.join(many, "bucket").select("bucket", "id", "centre"), "buckets")
    wanted = classes.select("id", "doc_id", "text_hash").join(buckets.select("id").distinct(), "id", "left_semi")
    texts = keyed(docs).join(wanted, ["doc_id", "text_hash"]).select("id", "text")
    texts = materialize(texts if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty() else texts.dropDuplicates(["id"]), "texts")

    star = buckets.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    star = materialize(sieved(star, classes), "star")
    # round 1: each class with its nearest candidate; round 2: the other star pairs between components; round 3: the rest
    ends = star.select(F.col("a").alias("v"), "a", "b", "ones").unionByName(star.select(F.col("b").alias("v"), "a", "b", "ones"))
    near = materialize(ends.groupBy("v").agg(F.min_by(F.struct("a", "b"), F.struct("ones", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "pairs-1")
    label = materialize(components(confirmed(near, texts)), "labels-1")  # classes that have a link: id, component
    pairs = materialize(across(star, label).join(near, ["a", "b"], "left_anti"), "pairs-2")
    label = materialize(components(confirmed(pairs, texts), label), "labels-2")
    split = split_classes(buckets, label)
    pairs = materialize(rare_pairs(split, texts).join(near.unionByName(pairs), ["a", "b"], "left_anti"), "pairs-3")
    label = materialize(components(confirmed(bounded(pairs, classes), texts), label), "labels-3")

    # a component's id is the smallest document id of its classes
    own = of_set.join(label, "id", "left").select("set_a", "set_b", "n", "first", F.coalesce("component", "id").alias("root"))
    own = materialize(own, "classes-of")
    best = materialize(own.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("m")), "components")
    own = materialize(looked_up(own, best, ["root"], "m").select("set_a", "set_b", "n", "root", "component"), "class-components")
    found = looked_up(rows.select("row", "doc_id", "text_hash", "n_shingles", "set_a", "set_b"), own, ["set_a", "set_b"], "n")
    there = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return materialize(found.select("row", "doc_id", "text_hash", "n_shingles", F.when(there, F.col("root")).alias("root"), F.when(there, F.col("component")).alias("component")), "grouped")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    component = F.coalesce("component", "doc_id")
    return grouped(docs).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; an end without a label is its own."""
    both = pairs.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def split_classes(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """(id, c): the classes of buckets that hold two components at least, with their component."""
    m = materialize(buckets.join(label.toDF("id", "c"), "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c")), "labelled-buckets")
    split = m.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
    return materialize(m.join(split, "bucket", "left_semi").select("id", "c").distinct(), "split")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that the lossless bound on bitmaps lets through."""
    own = classes.select("id", "n_shingles", "bits")
    both = pairs.join(own.toDF("a", "n_a", "bits_a"), "a").join(own.toDF("b", "n_b", "bits_b"), "b")
    return both.filter(may_link("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")


def rare_pairs(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components: all that are at the threshold or above, and some others.

    Each set is ordered by how many of the classes have a shingle, the rarest first. Of two sets of n <= m shingles with
    7 * overlap >= 3 * (n + m), which is a similarity of 0.75, the first shingle in common stands at a place p < n / 7 + 1
    of the smaller and q <= m / 4 of the larger, and the overlap is at most n - p and m - q. So a larger set seeks n only
    up to (4 * m - 7 * q) / 3, and as sizes in steps of ``STEP`` are part of the join's key, sets that miss the threshold
    by what each has alone do not meet. Shingles of one class alone are counted but never joined.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts_of(batch)
            for a, b in slices(text, 2 << 20):
                sets = list(shingle_sets(split_words(text.slice(a, b - a), lower=True)))
                n = [len(s) for s in sets]
                row = pa.array(np.repeat(np.arange(b - a), n))
                part = batch.slice(a, b - a)
                yield pa.record_batch({"id": part.column("id").take(row), "c": part.column("c").take(row), "n": pa.array(np.repeat(n, n).astype(np.int64)), "shingle": pa.array(np.concatenate(sets).view(np.int64))})

    every = materialize(texts.join(split, "id").select("id", "c", "text").mapInArrow(released(shingles), "id long, c long, n long, shingle long"), "shingles")
    common = every.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("id")  # one document's shingles
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1
    placed = every.join(common, "shingle").withColumn("at", place).filter("4 * at <= n")
    step = lambda n: F.floor(F.log(n) / float(np.log(STEP)))
    placed = materialize(placed.select("shingle", "id", "c", "n", "at"), "rare")
    small = placed.filter("7 * at <= n").select("shingle", step(F.col("n")).alias("step"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    low, high = F.ceil(F.col("n") * 3 / 4), F.least("n", F.floor((4 * F.col("n") - 7 * F.col("at")) / 3))
    large = placed.withColumn("low", low).withColumn("high", high).filter("low <= high")
    large = large.select("shingle", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("step"), F.col("id").alias("b"), F.col("c").alias("cb"), "low", "high", F.col("n").alias("nb"))
    met = small.join(large, ["shingle", "step"]).filter("ca <> cb and na between low and high and 7 * (na - pa) >= 3 * (na + nb)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, one row of each group of near-duplicates: one with the smallest document id.

    Rows with a null id or without words stay. Of rows equal in id and text the one whose columns have the least hash stays.
    """
    rows = grouped(docs).filter("doc_id is not null")
    first = rows.filter("doc_id = component").groupBy("root").agg(F.min("row").alias("row"))
    alone = rows.filter("component is null").select("doc_id", "text_hash", F.lit(True).alias("keep"), F.lit(1).alias("rows"))
    ruled = rows.filter("component is not null").join(first.select("row", F.lit(True).alias("keep")), "row", "left")
    ruled = ruled.groupBy("doc_id", "text_hash").agg(F.coalesce(F.max("keep"), F.lit(False)).alias("keep"), F.count("*").cast("int").alias("rows"))
    ruled = materialize(ruled.unionByName(alone), "ruled")
    keys = [F.col("_of.doc_id").cast("long").alias("doc_id"), F.xxhash64("_of.text").alias("text_hash")]
    left = docs.select(F.struct("*").alias("_of")).select("_of", *keys).join(ruled.filter("not keep").select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
    equal = ruled.filter("keep and rows > 1").select("doc_id", "text_hash")
    if not equal.isEmpty():  # of equal rows one stays
        one = left.join(equal, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.min_by("_of", F.xxhash64("_of")).alias("_of"))
        left = left.join(equal, ["doc_id", "text_hash"], "left_anti").unionByName(one.select(left.columns))
    return left.select("_of.*")
