"""Token ids in flat binary shards with 64-bit document offsets, written by Spark tasks and mapped into memory to read.

A shard is two files. ``shard-NNNNN.ids`` holds the ids as little-endian unsigned integers, 16 bits wide where the
vocabulary allows it, else 32. ``shard-NNNNN.idx`` holds int64 values: the number of documents n, n + 1 offsets into
the ids, n document ids, and n flags (0: the document id is null). Shards follow in ascending document order; the
manifest gives each shard's base, the number of ids in all shards before it, a prefix sum of the shards' sizes.

Cases: a null or empty text has the end id alone; null document ids come first; rows with equal ids are all kept, in
order of a hash of their text (equal rows: in any order); an empty table gives no shards and no rows; other columns are
left out. A shard is written under a name of its own attempt and then moved, so that tasks can be run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.llm.shared import shared_dir
from voxelry.llm.text import TOKEN_BYTES, slices, texts_of, word_encoder

WRITTEN = "shard int, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:05d}"


def id_width(tokenizer: str, end_id: int) -> str:
    """The narrower of two types that holds the end id and all ids of a tokenizer."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocab_size: int | None = None) -> list[dict]:
    """Write ``docs`` (doc_id, text) in ascending document order; returns the manifest, a row for each shard. Ids are as wide as
    a vocabulary of ``vocab_size`` wants, by default as the tokenizer wants; an id beyond that width is an error."""
    kind = id_width(tokenizer, end_id) if vocab_size is None else "<u2" if vocab_size <= 1 << 16 else "<u4"
    limit = int(np.iinfo(np.dtype(kind)).max)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, root = file_system(path)
        encoder, stream, at = word_encoder(tokenizer), None, 0
        offsets, ids, flags = [np.zeros(1, np.int64)], [], []
        tmp = f"{root}/_attempt-{attempt}-{shard_name(shard)}"
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, TOKEN_BYTES):
                tokens, starts = encoder.ids(texts.slice(a, b - a), end_id)
                if tokens.max(initial=0) > limit:
                    raise ValueError(f"token id {tokens.max()} does not fit {kind}")
                if stream is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{tmp}.ids")
                stream.write(tokens.astype(kind).tobytes())
                offsets.append(starts[1:] + at)
                at += len(tokens)
            docs_in = batch.column("doc_id")
            flags.append(docs_in.is_valid().to_numpy(zero_copy_only=False).astype("<i8"))
            ids.append(docs_in.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if stream is None:
            return
        stream.close()
        n = sum(map(len, ids))
        with store.open_output_stream(f"{tmp}.idx") as out:
            out.write(np.concatenate([[n], *offsets, *ids, *flags]).astype("<i8").tobytes())
        for x in (".ids", ".idx"):
            store.move(f"{tmp}{x}", f"{root}/{shard_name(shard)}{x}")
        yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    found = sorted(ordered.mapInArrow(write, WRITTEN).collect())
    base, manifest = 0, []
    for r in found:
        manifest.append({"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": base, "dtype": kind})
        base += r.n_tokens
    if manifest:
        spark.createDataFrame(manifest, "shard int, n_docs long, n_tokens long, base long, dtype string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


class Shard:
    """One shard to read: ids are mapped into memory where the store is a local folder, else read by range."""

    def __init__(self, path: str, shard: int, dtype: str):
        self.store, root = file_system(path)
        self.name, self.dtype = f"{root}/{shard_name(shard)}", np.dtype(dtype)
        with self.store.open_input_file(f"{self.name}.idx") as f:
            index = np.frombuffer(f.read(), "<i8")
        n = int(index[0])
        self.offsets, self.doc_ids, self.valid = index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :].astype(bool)
        local = isinstance(self.store, pafs.LocalFileSystem)
        self.ids = np.memmap(f"{self.name}.ids", self.dtype, "r") if local and self.offsets[-1] else None

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids of the shard's documents from a to before b, in one read."""
        first, end = int(self.offsets[a]), int(self.offsets[b])
        if self.ids is not None:
            return self.ids[first:end]
        with self.store.open_input_file(f"{self.name}.ids") as f:
            return np.frombuffer(f.read_at((end - first) * self.dtype.itemsize, first * self.dtype.itemsize), self.dtype)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of document i of the shard."""
        return self.span(i, i + 1)

    def ranges(self, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
        """Runs of documents with at most ``most`` ids, or one longer document."""
        at, n = 0, len(self.doc_ids)
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + most, side="right")) - 1)
            yield at, to
            at = to


def read_shards(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """A row for each document in the shards: doc_id, start over all shards, n_tokens, CRC-32 of its ids as uint32."""
    if not manifest:
        return spark.createDataFrame([], READ)
    parts = [(m["shard"], m["base"], m["dtype"]) for m in manifest]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                number, base, dtype = parts[k]
                shard = Shard(path, number, dtype)
                for a, b in shard.ranges():
                    raw = memoryview(shard.span(a, b).astype("<u4")).cast("B")
                    at = (4 * (shard.offsets[a : b + 1] - shard.offsets[a])).tolist()
                    crcs = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.record_batch({
                        "doc_id": pa.array(shard.doc_ids[a:b], pa.int64(), mask=~shard.valid[a:b]),
                        "start": pa.array(base + shard.offsets[a:b], pa.int64()),
                        "n_tokens": pa.array(np.diff(shard.offsets[a : b + 1]), pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, READ)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` (new under the shared folder by default), then read them back."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, tokenizer, end_id))
