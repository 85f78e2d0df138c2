"""The folder that driver and executors share, tables written there to cut lineage, and joins whose hot keys are broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder, which only a local
    session may use: a cluster's executors would each write to a disk of their own, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxelry-checkpoint-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later reads survive lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_frequent(keys: DataFrame, most: int, count: str = "n") -> int:
    """A count that at most ``most`` rows reach, from a histogram by eighths of powers of two: no sort, one row a bin."""
    bins = keys.groupBy(F.floor(F.log2(count) * 8).alias("bin")).agg(F.count("*").alias("keys"), F.min(count).alias("least")).collect()
    limit, total = 1 << 62, 0
    for b in sorted(bins, key=lambda b: -b.bin):
        total += b["keys"]
        if total > most:
            break
        limit = b.least
    return limit


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], count: str, most: int = 10_000) -> DataFrame:
    """``rows`` left-joined with ``found``, which has a row for each key and in ``count`` how many rows have it.

    The at most ``most`` commonest keys are broadcast, so that no key, however common, meets in one task; all others
    are joined by a shuffle. Both tables are read twice and should be materialised.
    """
    limit = least_frequent(found, most, count)
    hot, cold = found.filter(F.col(count) >= limit).drop(count), found.filter(F.col(count) < limit).drop(count)
    many = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return many.unionByName(rest)
