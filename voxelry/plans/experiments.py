"""Experiments: fields by several methods, their metrics, comparisons, sweeps with resumption."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators import decompose, interpolate, topology, verify
from voxelry.sources.store import checkpointed


def fields(voxels: DataFrame, methods: list[str]) -> DataFrame:
    """(CELL, method, u) of each method, u as double."""
    parts = [interpolate.method(m)(voxels).withColumn("method", F.lit(m)).withColumn("u", F.col("u").cast("double")) for m in methods]
    return reduce(DataFrame.unionByName, parts)


def correctness(voxels: DataFrame, methods: list[str]) -> DataFrame:
    """A row for each volume and method: blocks, violations, errors and whether the field is well-composed."""
    parts = [verify.well_composed(interpolate.method(m)(voxels), flat=True).withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, parts)


def topology_rows(masks: DataFrame, methods: list[str], thresholds: list[float]) -> DataFrame:
    """Topology of each method's field of binary images (v in 0, 1), at one half and over the thresholds."""
    found = fields(masks, methods)
    reference = topology.euler_in_blocks(masks.withColumn("on", F.col("v") == 1), ["vol_id"], ("x", "y", "z"), flat=True).withColumnRenamed("chi", "ref_chi")
    return topology.bundle(found, reference, 0.5, thresholds, flat=True)


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of options: a few short lists, so a product is what is asked for."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Configurations without a result row."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def sweep(voxels: DataFrame, subjects: str, configs: list[tuple[int, int, float]], small: bool = False) -> DataFrame:
    """(subject, K, delta, eps, violations, rounds) of the injection rounds for each (K, delta, eps); ``small`` as in
    ``decompose.injected``: then all come from one pass, and a field that several tolerances end at is checked once."""
    row = [F.concat(F.lit(subjects), "vol_id").alias("subject"), F.col("bdry_violations").alias("violations"), "rounds"]
    if small:
        settings = [(k, delta, [e for *s, e in configs if s == [k, delta]]) for k, delta in dict.fromkeys(c[:2] for c in configs)]
        keys = ("vol_id", "k", "delta", "rounds", "ends")
        checked = verify.whole_checked(decompose.swept(voxels, settings), "bounds", keys).select(*keys, "bdry_violations")
        of = F.array(*[F.struct(F.lit(k).alias("K"), F.lit(delta).alias("delta"), F.lit(1 << i).cast("long").alias("bit"), F.lit(float(e)).alias("eps")) for k, delta, eps in settings for i, e in enumerate(eps)])
        ended = F.filter(of, lambda c: (c["K"] == F.col("k")) & (c["delta"] == F.col("delta")) & (F.col("ends").bitwiseAND(c["bit"]) > 0))
        return checked.select(*row, F.explode(ended).alias("_c")).select("subject", "_c.K", "_c.delta", "_c.eps", "violations", "rounds")
    parts, found = [], {}
    for k, delta, eps in configs:
        # fields are integers, so a change is below eps if it is below the next integer
        key = k, delta, math.ceil(eps)
        if key not in found:
            field, took = decompose.injected(voxels, k, delta, eps=key[2])
            bad = decompose.checked(field, decompose.bounds_of(decompose.slabs(voxels, k, delta))).select("vol_id", "bdry_violations")
            found[key] = checkpointed(took.join(bad, "vol_id", "left").na.fill(0, ["bdry_violations"]), "sweep")
        parts.append(found[key].select(row[0], F.lit(k).alias("K"), F.lit(delta).alias("delta"), F.lit(float(eps)).alias("eps"), *row[1:]))
    return reduce(DataFrame.unionByName, parts)


def slab_rows(voxels: DataFrame, k: int, delta: int = 1, max_rounds: int = 8, small: bool = False) -> DataFrame:
    """A row for each volume in K slabs: rounds, violations at the bounds, planes a slab, its half, the widest intervals
    on the bounds' planes, and the halo's share of a slab in percent."""
    parts = decompose.slabs(voxels, k, delta)
    field, took = decompose.injected(voxels, k, delta, max_rounds=max_rounds, small=small)
    bad = decompose.checked(field, decompose.bounds_of(parts), small).select("vol_id", "bdry_violations")
    width = decompose.plane_width(interpolate.interval_span(voxels), parts)
    sizes = voxels.select("vol_id", "d").distinct().withColumn("D_sub", F.floor(F.col("d") / k).cast("int"))
    rows = sizes.join(took, "vol_id").join(bad, "vol_id", "left").join(width, "vol_id", "left").na.fill(0, ["bdry_violations"])
    share = F.when(F.col("D_sub") > 0, F.bround(delta / F.col("D_sub") * 100, 1)).otherwise(0.0)
    return rows.select(
        "vol_id", F.lit(k).alias("K"), F.lit(delta).alias("delta"), "rounds", "bdry_violations", (F.col("bdry_violations") == 0).alias("dwc_ok"), "D_sub", F.floor(F.col("D_sub") / 2).cast("int").alias("sigma_cover"),
        F.bround("plane_width_med", 1).alias("plane_width_med"), F.bround("plane_width_max", 1).alias("plane_width_max"), share.alias("rho_pct"))


def cached(df: DataFrame, compute, path: str, key: str = "vol_id") -> DataFrame:
    """Rows of ``compute(df)`` for the keys of ``df``: those stored under ``path`` are read, the others are computed
    and added to the store. Rows stored for a volume of another size are an error."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  only a missing store is a miss
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    sizes = [c for c in ("w", "h", "d") if stored is not None and c in stored.columns and c in df.columns]
    if sizes:
        was = stored.select(key, *[F.col(c).alias(f"_{c}") for c in sizes]).distinct()
        other = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"_{c}") for c in sizes])
        if bad := df.select(key, *sizes).distinct().join(was, key).filter(other).limit(1).collect():
            raise ValueError(f"stored for another size: {bad[0].asDict()}")
    missing = df if stored is None else df.join(stored.select(key).distinct(), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(df.select(key).distinct(), key, "left_semi")
