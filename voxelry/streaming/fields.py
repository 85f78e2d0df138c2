"""Fields over streams of images: the batch operators run on each micro-batch of whole images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelry.functions.scalar import quantised
from voxelry.operators import interpolate, verify


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (vol_id, embedding) from Parquet files that arrive in ``folder``."""
    return spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(folder).select(F.col("vec_id").alias("vol_id"), "embedding")


def images(rows: DataFrame, w: int = 8, h: int = 8) -> DataFrame:
    """Voxels of vectors read as w x h images; an image arrives whole in one row, so no state is needed."""
    out = rows.select("vol_id", F.posexplode("embedding").alias("i", "e"))
    return out.select("vol_id", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(1).alias("d"), (F.col("i") % w).cast("int").alias("x"), F.floor(F.col("i") / w).cast("int").alias("y"), F.lit(0).alias("z"), quantised(F.col("e"), -0.6, 1.2).alias("v"))


def checked(batch: DataFrame) -> DataFrame:
    """Violations of the 2-D field of a micro-batch's images."""
    return verify.well_composed(interpolate.field_2d(images(batch)), flat=True)


def run(stream: DataFrame, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = checked) -> StreamingQuery:
    """Write ``work`` of each micro-batch to ``sink``, once for each batch number: a batch run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
