"""Documents in chunks that several passes read without moving texts, and questions that chunks put to shards.

``chunked`` writes a table once, bucketed by chunk, so that grouping by chunk, and co-grouping with answers for each
chunk, needs no exchange of texts. A chunk is a few megabytes of one input partition's rows; only the packed messages
between chunks and shards are shuffled. A message is an Arrow table with zstd in a binary column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.shared import shared_dir
from voxelry.llm.text import trimmed

#: Bytes of text in a chunk, about; a single longer text is a chunk with it.
CHUNK_BYTES = 8 << 20
#: Chunks that one task reads one after the other.
TOGETHER = 4


def chunked(docs: DataFrame, columns: dict[str, Column], text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """A table (chunk, ``columns``) bucketed by chunk, and the bytes of all texts.

    A chunk's rows come from one input partition, by hash where the partition is larger than a chunk, so that writing
    shuffles nothing.
    """
    spark = docs.sparkSession
    rows = docs.select([c.alias(name) for name, c in columns.items()])
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length(text)).alias("bytes"))
    total, most = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    parts = max(1, -(-most // chunk_bytes))
    chunk = F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64(*columns), F.lit(parts))
    name, buckets = f"chunks_{uuid.uuid4().hex[:12]}", max(1, -(-total // (chunk_bytes * TOGETHER)))
    writer = rows.withColumn("chunk", chunk).write.option("compression", "zstd").option("path", shared_dir(spark, "chunks"))
    writer.bucketBy(int(min(buckets, 100_000)), "chunk").saveAsTable(name)
    return spark.table(name), int(total)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each group's Arrow table; freed memory goes back to the system after each."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        trimmed()
        return out

    return rows.groupBy(*keys).applyInArrow(run, schema)


def with_answers(chunks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each chunk's rows and those of ``answers`` for it. Answers for chunks without rows are left out."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        out = work(group, found)
        trimmed()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
