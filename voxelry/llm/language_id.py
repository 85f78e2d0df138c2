"""Language identification by Bayesian fusion of four kinds of evidence.

The text's likelihood comes from hashed byte trigrams of its words, one multinomial for each language that any document
declares by a code of two or three letters, and a flat one for ``und``, no language; it is tempered to ``EVIDENCE``
trigrams, since trigrams of one text are not independent. The declared language (a markup attribute or a column) and the
address suffix count by how often documents that the text alone puts in a language declare it or have it. The host's prior is smoothed towards its domain's, and that towards the
corpus's: (count + K * parent's share) / (all + K). All these counts are grouped aggregations over every document; only
the trigram model is fitted on a sample, ``TRAIN_ROWS`` expected rows of each declared language, chosen by a hash of id
and text.

A document is kept if the posterior of its best language is at least ``CONFIDENCE`` and that language is wanted.

Cases: null and empty texts and texts without letters are ``und`` and not kept; a null declaration, host or suffix is no
evidence, nor is a declaration that is no code; equal rows are judged alike, each its own row; an empty table, or one that
declares no language, gives no language but ``und``; texts above ``SLICE`` bytes are read in parts, whose trigrams do not
reach across; other columns are left out, or kept whole by ``kept_rows``, which judges each row by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.shared import least_frequent, materialize
from voxelry.llm.text import cut_long, released, slices, spread, texts_of

BUCKETS, TRAIN_ROWS, EVIDENCE, K, CONFIDENCE = 1 << 16, 2000, 200, 20.0, 0.5
#: Bytes of text whose trigrams are in memory at once.
SLICE = 1 << 18
_letter = np.full(256, 32, np.uint8)
_letter[97:123], _letter[128:] = np.arange(97, 123), np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each trigram with two letters at least, over lower-cased texts."""
    low = pc.utf8_lower(texts).cast(pa.large_binary())
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.full(int(sizes.sum()) + 2 * len(texts), 32, np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes + 2)
    inner = np.ones(len(data), bool)
    ends = np.cumsum(sizes + 2)
    inner[ends - sizes - 2] = inner[ends - 1] = False
    data[inner] = _letter[np.frombuffer(b"".join(low.to_pylist()), np.uint8)]
    x = data.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(16)
    spaces = (data == 32).astype(np.uint8)
    use = (row[:-2] == row[2:]) & (spaces[:-2] + spaces[1:-1] + spaces[2:] < 2)
    return code[use].astype(np.int64), row[:-2][use]


@dataclass
class Model:
    """Log shares of the buckets in each language: ``base`` for a bucket that its sample lacks, and what the others add
    to it, bucket after bucket. Its size is that of the sample's distinct trigrams by language."""

    base: np.ndarray
    start: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def sums(self, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Log likelihoods of each row's trigrams, a column for each language and ``und`` last."""
        width, n = len(self.base), np.bincount(row, minlength=rows)
        lengths = self.start[bucket + 1] - self.start[bucket]
        at = spread(self.start[bucket], lengths)
        out = np.bincount(np.repeat(row, lengths) * width + self.language[at], weights=self.more[at], minlength=rows * width)
        return np.column_stack([out[: rows * width].reshape(rows, width) + n[:, None] * self.base, -n * np.log(BUCKETS)])


def fit(rows: DataFrame, languages: int) -> Model:
    """The model of ``rows`` (text, k: the language's number)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = cut_long(texts_of(batch), SLICE)
            codes = batch.column("k").to_numpy(zero_copy_only=False)[of]
            for a, b in slices(texts, SLICE):
                bucket, row = trigrams(texts.slice(a, b - a))
                keys, n = np.unique(bucket * languages + codes[a:b][row], return_counts=True)
                yield pa.record_batch({"key": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = rows.mapInArrow(released(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    bucket, language = key // max(languages, 1), key % max(languages, 1)
    total = np.bincount(language, weights=n, minlength=languages) + 0.5 * BUCKETS
    start = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    return Model(np.log(0.5 / total)[:languages], start, language.astype(np.int32), np.log((n + 0.5) / 0.5).astype(np.float32))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def joined(rows: DataFrame, found: DataFrame, key: str, value: str, most: int = 10_000) -> DataFrame:
    """``rows`` with the ``value`` that ``found`` (key, value, n: how many rows have the key) has for their key, else null.

    The at most ``most`` commonest keys are broadcast and their rows then dealt out evenly, so that none fills a task.
    """
    found = materialize(found, f"by-{key}")
    limit = least_frequent(found, most)
    hot = found.filter(F.col("n") >= limit).select(F.col(key).alias("_hot"), F.col(value).alias("_value"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    cold = found.filter(F.col("n") < limit).select(F.col(key).alias("_cold"), F.col(value).alias("_other"))
    if not cold.isEmpty():
        even = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))
        out = out.withColumn("_sought", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(even))
        out = out.join(cold, F.col("_sought") == F.col("_cold"), "left").drop("_sought", "_cold").withColumn("_value", F.coalesce("_value", "_other")).drop("_other")
    return out.withColumnRenamed("_value", value).drop("_hot")


def judged(docs: DataFrame, text: str, declared: str | None, host: Column | str | None, keep: Column, key: str, whole: bool, train_rows: int) -> DataFrame:
    """of (``keep`` of each row), language, posterior and text_language; ``whole``: ``keep`` holds the text, so that
    rows are scored again and not written with their scores."""
    spark = docs.sparkSession
    host = F.col(host) if isinstance(host, str) else host if host is not None else F.lit(None).cast("string")
    said = F.lower(F.regexp_extract(F.col(declared), "^([A-Za-z]{2,3})(?![A-Za-z])", 1)) if declared else F.lit(None).cast("string")
    rows = docs.select(keep.alias("of"), F.xxhash64(key, text, F.lit("sample")).alias("draw"), F.col(text).alias("text"), F.when(said != "", said).alias("said"), F.when(host != "", host).alias("host"))
    # codes of two or three letters: 18,278 rows at most
    counts = sorted(rows.filter("said is not null").groupBy("said").agg(F.count("*").alias("n")).collect())
    languages, width = [r.said for r in counts], len(counts) + 1
    number = spark.createDataFrame([(r.said, i, min(1.0, train_rows / r.n)) for i, r in enumerate(counts)], "said string, k long, share double")
    sample = rows.select("draw", "text", "said").join(F.broadcast(number), "said").filter(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "k")
    shared = spark.sparkContext.broadcast(fit(sample, width - 1))
    kind = rows.schema["of"].dataType.simpleString()
    # where what is kept holds the text, it is sent to Python once
    sent = rows.select("of", "said", "host") if whole else rows.drop("draw")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if whole:
                batch = batch.append_column("text", pc.struct_field(batch.column("of"), text))
            texts, of = cut_long(texts_of(batch), SLICE)
            n, sums = np.zeros(len(batch), np.int64), np.zeros((len(batch), width))
            for a, b in slices(texts, SLICE):
                bucket, row = trigrams(texts.slice(a, b - a))
                first, here = of[a], of[b - 1] - of[a] + 1
                row = of[a:b][row] - first
                n[first : first + here] += np.bincount(row, minlength=here)
                sums[first : first + here] += model.sums(bucket, row, here)
            sums *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
            best = np.where(n > 0, sums.argmax(axis=1), width - 1)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(sums.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in ("of", "said", "host")), pa.array(n), pa.array(best), scores], names=["of", "said", "host", "n", "best", "scores"])

    scored = sent.mapInArrow(released(score), f"of {kind}, said string, host string, n long, best long, scores array<double>")
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host"))
    scored = scored.withColumn("domain", domain).withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    if whole:
        seen = materialize(scored.select("said", "host", "domain", "suffix", "best"), "language-evidence")
    else:
        seen = scored = materialize(scored, "language-scores")

    def by(column: str) -> DataFrame:
        """How many rows with each value the text alone puts in each language: column, own (an array), n."""
        each = seen.filter(F.col(column).isNotNull()).groupBy(column, "best").agg(F.count("*").alias("m"))
        table = each.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("best", "m"))).alias("of"), F.sum("m").alias("n"))  # a row for each language
        own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("of", i.cast("long")), F.lit(0)).cast("double"))
        return table.select(column, own.alias("own"), "n")

    def known(column: str | None = None) -> list[float]:
        """Rows of each language, those with a value in the column alone."""
        found = {r.best: float(r.m) for r in (seen.filter(F.col(column).isNotNull()) if column else seen).groupBy("best").agg(F.count("*").alias("m")).collect()}
        return [found.get(i, 0.0) for i in range(width)]

    array = lambda values: F.from_json(F.lit(str(list(values))), "array<double>")
    every = [x + 1 for x in known()]
    root = array(x / sum(every) for x in every)

    def smoothed(count: Column, n: Column, parent: Column) -> Column:
        return F.zip_with(count, parent, lambda c, p: (c + K * p) / (n + K))

    domains = by("domain").select("domain", smoothed(F.col("own"), F.col("n"), root).alias("parent"))
    hosts = by("host").join(seen.filter("host is not null").select("host", "domain").distinct(), "host").join(domains, "domain")
    prior = hosts.select("host", smoothed(F.col("own"), F.col("n"), F.col("parent")).alias("prior"), "n")

    def evidence(column: str) -> DataFrame:
        """P(value | language) for each value of a column, smoothed by the value's share in the corpus."""
        per = known(column)
        share = F.col("n") / F.lit(max(sum(per), 1.0))
        return by(column).select(column, F.zip_with("own", array(per), lambda c, m: (c + K * share) / (m + K)).alias(f"by_{column}"), "n")

    fused = joined(joined(joined(scored, prior, "host", "prior"), evidence("said"), "said", "by_said"), evidence("suffix"), "suffix", "by_suffix")
    flat = F.array_repeat(F.lit(1.0), width)
    log = lambda c: F.transform(F.coalesce(c, flat), lambda x: F.log(x))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    fused = fused.withColumn("logs", add(add(F.col("scores"), log(F.coalesce("prior", root))), add(log(F.col("by_said")), log(F.col("by_suffix")))))
    names = F.from_json(F.lit(json.dumps([*languages, "und"])), "array<string>")
    most = F.array_max("logs")
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("logs")))
    language = F.when(F.col("n") > 0, F.element_at(names, F.array_position("logs", most).cast("int"))).otherwise("und")
    return fused.select("of", language.alias("language"), F.when(F.col("n") > 0, posterior).otherwise(1.0).alias("posterior"), F.element_at(names, (F.col("best") + 1).cast("int")).alias("text_language"))


def is_kept(wanted: list[str] | None, confidence: float) -> Column:
    return (F.col("language") != "und" if wanted is None else F.col("language").isin(wanted)) & (F.col("posterior") >= confidence)


def language_id(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: Column | str | None = "source", key: str = "doc_id", wanted: list[str] | None = None, confidence: float = CONFIDENCE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``key``, language, posterior, text_language and kept of each row of ``docs``."""
    found = judged(docs, text, declared, host, F.col(key), key, False, train_rows)
    return found.withColumn("kept", is_kept(wanted, confidence)).withColumnRenamed("of", key)


def kept_rows(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: Column | str | None = "source", key: str = "doc_id", wanted: list[str] | None = None, confidence: float = CONFIDENCE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with all columns, without the rows whose language is not wanted or not sure enough."""
    return judged(docs, text, declared, host, F.struct("*"), key, True, train_rows).filter(is_kept(wanted, confidence)).select("of.*")
