"""Result records as a stream: running sums by settings, repeated records dropped, state kept over restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.sources.store import shared_path

RECORD = "subject string, K int, delta int, eps double, violations long, rounds long"
KEYS = ("K", "delta", "eps")
SUMMARY = "K int, delta int, eps double, n_subjects long, viol_mean double, viol_std double, viol_min long, viol_max long, pass_rate double, rounds_mean double, rounds_std double, rounds_min long, rounds_max long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State outside the heap, of bounded memory for each executor: a row for each subject of each setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from whole sums, 0 for one value."""
    whole = [c.cast("decimal(19,0)") for c in (n, squares, total)]
    over = F.greatest(whole[0] * whole[1] - whole[2] * whole[2], F.lit(0)).cast("double")
    return F.when(n > 1, F.sqrt(over / (n * (n - 1)))).otherwise(0.0)


def running_summaries(records: DataFrame) -> DataFrame:
    """For each setting (K, delta, eps) with new records, its summary over all records so far, in update mode: a subject's first
    record of each setting counts, sums are kept by setting."""
    plain = records.select(F.coalesce("subject", F.lit("")).alias("subject"), *KEYS, F.coalesce("violations", F.lit(0)).alias("v"), F.coalesce("rounds", F.lit(0)).alias("r"))
    v, r = F.col("v"), F.col("r")
    sums = plain.dropDuplicates([*KEYS, "subject"]).groupBy(*KEYS).agg(
        F.count("*").alias("n_subjects"), F.sum("v").alias("_v"), F.sum(v * v).alias("_vv"), F.min("v").alias("viol_min"), F.max("v").alias("viol_max"), F.count_if(v == 0).alias("_passed"),
        F.sum("r").alias("_r"), F.sum(r * r).alias("_rr"), F.min("r").alias("rounds_min"), F.max("r").alias("rounds_max"))
    n = F.col("n_subjects")
    more = {f"{name}_mean": F.col(s) / n for name, s in (("viol", "_v"), ("rounds", "_r"))} | {f"{name}_std": deviation(n, F.col(s), F.col(s + s[1:])) for name, s in (("viol", "_v"), ("rounds", "_r"))}
    return sums.withColumns(more | {"pass_rate": F.col("_passed") / n}).select(*[c.split()[0] for c in SUMMARY.split(", ")])


def replayed(records: DataFrame, first: str) -> DataFrame:
    """The last summary of each setting after a stream over the rows of condition ``first``, then, restarted, over all rows.

    Summaries go to a table, a batch at a time; a setting's last one has the most subjects.
    """
    spark = records.sparkSession
    use_state_store(spark)
    base = shared_path(spark, "records")
    for rows in (records.filter(first), records):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = running_summaries(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    last = F.max_by(F.struct(*[c for c in found.columns if c not in (*KEYS, "batch")]), "n_subjects").alias("last")
    return found.groupBy(*KEYS).agg(last).select(*KEYS, "last.*")
