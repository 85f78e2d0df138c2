"""Result rows: readers with checked schemas, writers, and stores that grow run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = "subject string, K int, delta int, eps double, violations long, rounds int, t_s double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV with a header, in the given schema; ``N/A`` and empty fields are null."""
    return spark.read.schema(schema).option("nullValue", "N/A").csv(path, header=True, enforceSchema=False)


def timings(spark: SparkSession, path: str, schema: str, key: str = "subject_id") -> DataFrame:
    """Timing rows without those whose key begins with two underscores."""
    return read_csv(spark, path, schema).filter(~F.col(key).startswith("__"))


def read_records(spark: SparkSession, path: str, schema: str = EPSILON) -> DataFrame:
    """Records of a JSON document with a list ``records``, or of a CSV; ValueError if a column is missing."""
    wanted = [c.strip().split()[0] for c in schema.split(",")]
    if path.rstrip("/").endswith(".json"):
        found = spark.read.option("multiLine", True).schema(f"records array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>").json(path)
        return found.select(F.explode("records").alias("r")).select("r.*")
    there = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in wanted if c not in there]:
        raise ValueError(f"missing columns: {missing}")
    return spark.read.option("header", True).csv(path).select(*[F.col(c).try_cast(t).alias(c) for c, t in (x.strip().split() for x in schema.split(","))])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Add the rows of one configuration to a store."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def done_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a store holds so far; nothing if it does not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
