"""Tables in the shared checkpoint folder, to cut lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where unset, under a temporary folder, which only a local session may use."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="voxelry-checkpoint-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/voxelry/{name}-{uuid.uuid4().hex[:12]}"


def unsent(df: DataFrame) -> DataFrame:
    """``df``, joined by merging and never through the driver. Spark guesses a table's size from its files, which for cells are
    many times smaller than their rows, and from columns that are not exploded yet; it would send such a table whole to all."""
    return df.hint("merge")


def checkpointed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write ``df`` under ``shared_path`` and read it back; joins with it are those of ``unsent``. With ``keys`` the rows come back
    dealt out by them as ``lattice.colocated`` does, so that what is grouped by them needs no exchange."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if not keys:
        df.write.parquet(path)
        return unsent(spark.read.schema(df.schema).parquet(path))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(many, *keys).write.bucketBy(many, *keys).option("path", path).saveAsTable(table)
    return unsent(spark.table(table))
