"""Queries that go through files: what is written under the shared folder, in each format, is read back by its reader.

The SQL says what went in, so that a query is right only if writer and reader both are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import interpolate, labels
from voxelry.plans import experiments
from voxelry.plans.queries import QUERIES, SQL, _rows, _rows_sql, emb, query, volumes
from voxelry.sources import formats, hdf5, images, results, volumes as volume_files
from voxelry.sources.store import shared_path
from voxelry.streaming import records

__all__ = ["QUERIES", "SQL"]


@query(f"WITH {volumes(2)} SELECT vol_id || '_0000_0000' AS vol_id, x, y, v, (v / 255.0::DOUBLE > 0.5)::INT AS m FROM vox")
def png_files(spark, sf_dir):
    """Each image as a PNG tile, listed and read as gray images, and their masks."""
    folder = shared_path(spark, "png")
    tiles = images.tile_files(labels.tiles(emb(spark, sf_dir, 2), 8, 8), 8)
    images.write_files(tiles, folder).write.format("noop").mode("overwrite").save()
    gray = images.gray_images(spark, folder, "*.png")
    return images.masks(gray.withColumn("gray", F.col("v"))).select("vol_id", "x", "y", F.col("gray").alias("v"), F.col("v").alias("m"))


@query("SELECT lpad(vec_id::VARCHAR, 9, '0') || '.png' AS name FROM embeddings ORDER BY 1 LIMIT 7")
def listed_files(spark, sf_dir):
    """The first files by name of a folder without GIFs: the limit is the operator."""
    folder = shared_path(spark, "listed")
    name = F.concat(F.lpad(F.col("vol_id").cast("string"), 9, "0"), F.lit(".png"))
    tiles = images.tile_files(labels.tiles(emb(spark, sf_dir, 2), 8, 8), 8).select(F.concat(F.lpad(F.split("name", "_")[0], 9, "0"), F.lit(".png")).alias("name"), "content")
    images.write_files(tiles, folder).write.format("noop").mode("overwrite").save()
    return images.listed(spark, folder, most=7).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query(f"WITH {volumes(3)} SELECT vol_id::VARCHAR AS vol_id, x, y, z, v::DOUBLE AS v FROM vox")
def nifti_volumes(spark, sf_dir):
    folder = shared_path(spark, "nifti")
    images.write_files(volume_files.nifti_files(emb(spark, sf_dir, 3)), folder).write.format("noop").mode("overwrite").save()
    return volume_files.nifti(spark, folder, lead=False).select("vol_id", "x", "y", "z", "v")


@query(f"WITH {volumes(2)}, m AS (SELECT vol_id, x, y, v, min(v) OVER w AS a, max(v) OVER w AS b FROM vox WINDOW w AS (PARTITION BY vol_id)) SELECT vol_id::VARCHAR AS vol_id, 0 AS x, x AS y, y AS z, CASE WHEN b > a THEN (v - a) / (b - a)::DOUBLE ELSE 0 END AS v FROM m")
def nifti_leading_axis(spark, sf_dir):
    """Volumes whose last axis is the shortest are turned to begin with it, then brought to 0-1."""
    folder = shared_path(spark, "nifti")
    images.write_files(volume_files.nifti_files(emb(spark, sf_dir, 2)), folder).write.format("noop").mode("overwrite").save()
    return interpolate.min_max_normalised(volume_files.nifti(spark, folder)).select("vol_id", "x", "y", "z", "v")


@query(f"WITH {volumes(3)} SELECT vol_id::VARCHAR AS vol_id, x, y, z, v::DOUBLE AS v FROM vox WHERE z BETWEEN 1 AND 2")
def nifti_planes(spark, sf_dir):
    """Two planes of each volume through the data source, which reads no others."""
    folder = shared_path(spark, "nifti")
    images.write_files(volume_files.nifti_files(emb(spark, sf_dir, 3)), folder).write.format("noop").mode("overwrite").save()
    formats.register(spark)
    return spark.read.format("nifti_planes").load(folder).filter("z >= 1 and z < 3").select("vol_id", "x", "y", "z", "v")


@query(f"WITH {volumes(3)} SELECT vol_id::VARCHAR AS vol_id, 4 AS w, 4 AS h, 4 AS d, x, y, z, v::DOUBLE AS v, (v // 16 + 4294967296 * z)::BIGINT AS label FROM vox WHERE z >= 2")
def hdf5_pairs(spark, sf_dir):
    """The upper planes of gray volumes with their labels from HDF5 files in deflated chunks, by place."""
    folder = shared_path(spark, "hdf5")
    voxels = emb(spark, sf_dir, 3).withColumn("label", F.floor(F.col("v") / 16) + F.col("z").cast("long") * 4294967296)
    images.write_files(hdf5.hdf5_files(voxels), folder).write.format("noop").mode("overwrite").save()
    return hdf5.hdf5_pair(spark, folder).filter("z >= 2")


@query(f"WITH {volumes(3)} SELECT vol_id::VARCHAR AS vol_id, v // 16 AS label, count(*) AS n FROM vox GROUP BY ALL")
def hdf5_label_sizes(spark, sf_dir):
    """Voxels of each label in HDF5 label volumes."""
    folder = shared_path(spark, "hdf5")
    images.write_files(hdf5.hdf5_files(emb(spark, sf_dir, 3).withColumn("label", F.floor(F.col("v") / 16))), folder).write.format("noop").mode("overwrite").save()
    return hdf5.hdf5_labels(spark, folder).groupBy("vol_id", F.col("v").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {volumes(3)} SELECT vol_id::VARCHAR AS vol_id, ((ex * 7 + ey) * 7 + ez)::BIGINT AS place, lo::INT AS u FROM cells")
def raw_ranges(spark, sf_dir):
    """Lower ends of the cells' intervals through the raw sink, by ranges of places, and back."""
    folder = shared_path(spark, "raw")
    formats.write_raw_ranges(interpolate.interval_span(emb(spark, sf_dir, 3)).withColumn("u", F.col("lo")), folder)
    return formats.read_raw_ranges(spark, folder)


_records = "SELECT l_orderkey || '-' || l_partkey AS subject, l_linenumber::INT AS K, (l_suppkey % 2)::INT AS delta, l_tax::DOUBLE AS eps, (l_quantity::INT % 9)::BIGINT AS violations, (l_orderkey % 5)::BIGINT AS rounds FROM lineitem"


@query(f"""WITH r AS ({_records}), one AS (SELECT K, delta, eps, subject, any_value(violations) AS v, any_value(rounds) AS r FROM r GROUP BY ALL)
SELECT K, delta, eps, count(*) AS n_subjects, round(avg(v), 9) AS viol_mean, round(coalesce(stddev_samp(v), 0), 6) AS viol_std, min(v) AS viol_min, max(v) AS viol_max, round(avg((v = 0)::INT), 9) AS pass_rate,
round(avg(r), 9) AS rounds_mean, round(coalesce(stddev_samp(r), 0), 6) AS rounds_std, min(r) AS rounds_min, max(r) AS rounds_max FROM one GROUP BY K, delta, eps""")
def streamed_records(spark, sf_dir):
    """Records as a stream that is stopped halfway and started again with all of them: the running summaries' last state."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = t.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("subject"), F.col("l_linenumber").cast("int").alias("K"), (F.col("l_suppkey") % 2).cast("int").alias("delta"), F.col("l_tax").cast("double").alias("eps"), (F.col("l_quantity").cast("int") % 9).cast("long").alias("violations"), (F.col("l_orderkey") % 5).cast("long").alias("rounds"))
    return records.replayed(rows, "rounds < 2").withColumns({c: F.round(c, 6 if "std" in c else 9) for c in ("viol_mean", "viol_std", "pass_rate", "rounds_mean", "rounds_std")})


@query(f"WITH {volumes(2)} SELECT vol_id::VARCHAR AS vol_id, count(*) AS n, sum(greatest(lo, least(0, hi)) * (ex * 15 + ey + 1))::BIGINT AS placed FROM cells GROUP BY vol_id")
def raw_files(spark, sf_dir):
    """Fields as flat integers in row-major order, read back and summed by place."""
    folder = shared_path(spark, "raw")
    volume_files.write_raw(interpolate.field_2d(emb(spark, sf_dir, 2)), folder).write.format("noop").mode("overwrite").save()
    placed = F.aggregate(F.transform("values", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda t, v: t + v)
    return volume_files.read_raw(spark, folder).select("vol_id", "n", placed.alias("placed"))


_metrics = "vol_id long, method string, level double, bad long"


@query(f"WITH {_rows_sql} SELECT vol_id, method, level, bad FROM rows")
def csv_rows(spark, sf_dir):
    path = shared_path(spark, "csv")
    results.write_csv(_rows(spark, sf_dir).select("vol_id", "method", "level", "bad"), path)
    return results.read_csv(spark, path, _metrics)


@query(f"WITH {_rows_sql} SELECT vol_id, method, level, bad FROM rows")
def json_rows(spark, sf_dir):
    path = shared_path(spark, "json")
    results.write_json(_rows(spark, sf_dir).select("vol_id", "method", "level", "bad"), path)
    return spark.read.schema(_metrics).json(path)


@query("SELECT c_name AS subject, 2 AS \"K\", 1 AS delta, 0.5::DOUBLE AS eps, c_custkey % 5 AS violations, (c_custkey % 3)::INT AS rounds, c_custkey / 4.0::DOUBLE AS t_s FROM customer")
def record_files(spark, sf_dir):
    """Records of a sweep from a CSV with all columns."""
    path = shared_path(spark, "records")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.col("c_name").alias("subject"), F.lit(2).alias("K"), F.lit(1).alias("delta"), F.lit(0.5).alias("eps"), (F.col("c_custkey") % 5).alias("violations"), (F.col("c_custkey") % 3).cast("int").alias("rounds"), (F.col("c_custkey") / 4).alias("t_s"))
    results.write_csv(rows, path)
    return results.read_records(spark, path)


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey / 2.0::DOUBLE END AS t, c_name AS subject_id FROM customer WHERE c_custkey % 7 <> 0")
def timing_rows(spark, sf_dir):
    """Timings by subject, without rows whose key begins with two underscores; N/A is null."""
    path = shared_path(spark, "timings")
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.when(key % 7 == 0, F.concat(F.lit("__"), "c_name")).otherwise(F.col("c_name")).alias("subject_id"), F.when(key % 10 == 0, "N/A").otherwise((key / 2).cast("string")).alias("t"))
    results.write_csv(rows, path)
    return results.timings(spark, path, "subject_id string, t double")


@query("SELECT c_mktsegment AS segment, c_custkey AS key FROM customer WHERE c_custkey % 3 <> 1")
def resumed_store(spark, sf_dir):
    """A store that grew by two runs, the second one of what the first had not done."""
    path = shared_path(spark, "store")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"))
    schema = "key long, segment string"
    results.append(experiments.still_to_do(c.filter("key % 3 = 0"), results.done_rows(spark, path, schema), ["key"]), path, "segment")
    results.append(experiments.still_to_do(c.filter("key % 3 <> 1"), results.done_rows(spark, path, schema), ["key"]), path, "segment")
    return results.done_rows(spark, path, schema).select("segment", "key")


@query(f"WITH {volumes(2)} SELECT vol_id, ex, ey, mean AS u FROM cells")
def cached_fields(spark, sf_dir):
    """Fields from a cache that held some of the images before; the others are computed and added."""
    path, voxels = shared_path(spark, "cache"), emb(spark, sf_dir, 2)
    experiments.cached(voxels.filter("vol_id % 3 = 0"), interpolate.linear, path)
    return experiments.cached(voxels, interpolate.linear, path).select("vol_id", "ex", "ey", "u")
