"""Voxel tables from the driver's tables and from formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions.scalar import quantised
from voxelry.operators.lattice import VOXEL, colocated
from voxelry.sources.store import unsent

SHAPES = {"emb2d": (8, 8, 1), "emb3d": (4, 4, 4)}


def embeddings(spark: SparkSession, sf_dir: str, kind: str = "emb2d") -> DataFrame:
    """Each vector of 64 as an 8x8 image or a 4x4x4 volume. Vectors are dealt out before they become voxels, 64 times
    fewer rows, and stay together, so that no operator behind needs an exchange."""
    w, h, d = SHAPES[kind]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vol_id"), "embedding")
    rows = colocated(rows)
    out = rows.select("vol_id", F.posexplode("embedding").alias("i", "e"))
    i = F.col("i")
    return unsent(out.select("vol_id", *[F.lit(n).alias(c) for n, c in ((w, "w"), (h, "h"), (d, "d"))], (i % w).cast("int").alias("x"), (F.floor(i / w) % h).cast("int").alias("y"), F.floor(i / (w * h)).cast("int").alias("z"), quantised(F.col("e"), -0.6, 1.2).alias("v")))


def dense(points: DataFrame, keys: DataFrame, sizes: tuple[Column, Column, Column]) -> DataFrame:
    """All voxels of the volumes in ``keys`` (vol_id), with those of ``points`` (vol_id, x, y, z, v) filled in, else 0."""
    w, h, d = sizes
    lattice = keys.select("vol_id", w.cast("int").alias("w"), h.cast("int").alias("h"), d.cast("int").alias("d"))
    for c, n in (("x", "w"), ("y", "h"), ("z", "d")):
        lattice = lattice.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return unsent(lattice).join(points, ["vol_id", "x", "y", "z"], "left").select(*VOXEL, F.coalesce("v", F.lit(0)).alias("v"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One volume of counts over quantity (50), discount (11) and tax (9)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax")
    at = t.groupBy((F.col("l_quantity") - 1).cast("int").alias("x"), F.rint(F.col("l_discount") * 100).cast("int").alias("y"), F.rint(F.col("l_tax") * 100).cast("int").alias("z")).agg(F.count("*").cast("int").alias("v"))
    return dense(at.withColumn("vol_id", F.lit(0).cast("long")), spark.range(1).withColumnRenamed("id", "vol_id"), (F.lit(50), F.lit(11), F.lit(9)))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, vol_id): types numbered in order; a handful of rows."""
    from pyspark.sql import Window

    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return types.withColumn("vol_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))


def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of counts over user and hour for each event type; the width comes from the data."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type").join(F.broadcast(event_types(spark, sf_dir)), "event_type")
    at = e.groupBy("vol_id", F.col("user_id").cast("int").alias("x"), F.hour("ts").alias("y")).agg(F.count("*").cast("int").alias("v")).withColumn("z", F.lit(0))
    width = e.agg((F.max("user_id") + 1).alias("n"))
    keys = event_types(spark, sf_dir).select("vol_id").crossJoin(F.broadcast(width))
    return dense(at, keys, (F.col("n"), F.lit(24), F.lit(1)))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label image over user and hour: 1 + the commonest event type there, the first by name of several; 0: none."""
    images = event_images(spark, sf_dir)
    best = images.groupBy("w", "h", "d", "x", "y", "z").agg(F.max(F.struct("v", -F.col("vol_id"))).alias("b"))
    value = F.when(F.col("b.v") > 0, 1 - F.col("b.col2")).otherwise(0)
    return best.select(F.lit(0).cast("long").alias("vol_id"), "w", "h", "d", "x", "y", "z", value.cast("int").alias("v"))


def formula(spark: SparkSession, vol_id: int, size: tuple[int, int, int], value: Column) -> DataFrame:
    """One volume whose voxels are an expression of x, y and z."""
    w, h, d = size
    i = F.col("id")
    at = spark.range(w * h * d).select(F.lit(vol_id).cast("long").alias("vol_id"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(d).alias("d"), F.floor(i / (h * d)).cast("int").alias("x"), (F.floor(i / d) % h).cast("int").alias("y"), (i % d).cast("int").alias("z"))
    return at.withColumn("v", value.cast("int"))


def shapes() -> dict[str, tuple[tuple[int, int, int], Column]]:
    """Binary images of known topology by name: size (x, y, z) and expression."""
    x, y = F.col("x"), F.col("y")
    r2 = (x - 32) * (x - 32) + (y - 32) * (y - 32)
    two = lambda cx: (x - cx) * (x - cx) + (y - 32) * (y - 32) < 225
    # sizes and places are fixed values
    return {
        "disk": ((64, 64, 1), r2 < 400),
        "ring": ((64, 64, 1), (r2 > 144) & (r2 < 625)),
        "two_disks": ((96, 64, 1), two(22) | two(70)),
        "line": ((64, 32, 1), (y == 16) & x.between(5, 58)),
        "cross_gap": ((32, 32, 1), (((y == 16) & x.between(4, 27)) | ((x == 16) & y.between(4, 27))) & ~((x == 16) & (y == 16))),
        "diagonal": ((32, 24, 1), x == y),
    }


def membranes(size: tuple[int, int, int] = (64, 64, 32)) -> dict[str, tuple[tuple[int, int, int], Column]]:
    """Thin walls by name: a grid, a grid that drifts with depth, a cylinder's shell, and rows and columns at random."""
    import numpy as np

    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rng, walls = np.random.default_rng(42), F.lit(False)  # 24 planes of six rows and six columns
    for plane in range(24):
        rows, columns = (rng.integers(4, 44, 6).tolist() for _ in range(2))
        walls = walls | ((z == plane) & (y.isin(rows) | x.isin(columns)))
    # sizes, periods and radii are fixed values
    r2 = (x - 24) * (x - 24) + (y - 24) * (y - 24)
    return {
        "grid": (size, (x % 8 == 0) | (y % 8 == 0)),
        "drifting": (size, (x % 8 == z % 8) | (y % 8 == z % 8)),
        "cylinder": ((48, 48, 32), r2.between(100, 144)),
        "random": ((48, 48, 24), walls),
    }


def ramp(side: int = 48) -> Column:
    """Levels that rise with depth to just below 200."""
    return F.floor(F.col("z") / side * 200)


def bell(side: int = 48, top: int = 220) -> Column:
    """Levels that fall off from the middle like a Gaussian a sixth of the side wide, mirrored at the faces and cut off at
    four times its width; the highest is ``top``."""
    middle, width = side // 2, side // 6
    total = F.lit(1.0)
    for c in ("x", "y", "z"):
        part = F.lit(0.0)
        for centre in (middle, -1 - middle, 2 * side - 1 - middle):
            far = F.col(c) - centre
            part = part + F.when(F.abs(far) <= 4 * width, F.exp(-far * far / (2.0 * width * width))).otherwise(0.0)
        total = total * part
    return F.floor(total * top)


def blobs(spark: SparkSession, size: tuple[int, int, int], n: int = 5, seed: int = 0, vol_id: int = 0, noise: float = 0.05) -> DataFrame:
    """Gaussian blobs with noise, 0-255: centres and widths from a seeded generator on the driver (n rows), the voxels
    from expressions."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres, widths = rng.uniform(0, 1, (n, 3)) * np.array(size), rng.uniform(0.08, 0.2, n) * max(size)
    total = F.lit(0.0)
    for (cx, cy, cz), s in zip(centres, widths, strict=True):
        d2 = F.pow(F.col("x") - float(cx), F.lit(2)) + F.pow(F.col("y") - float(cy), F.lit(2)) + (F.pow(F.col("z") - float(cz), F.lit(2)) if size[2] > 1 else 0)
        total = total + F.exp(-d2 / (2 * float(s) ** 2))
    jitter = F.pmod(F.xxhash64("x", "y", "z", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) * noise
    rows = formula(spark, vol_id, size, F.lit(0)).withColumn("v", total + jitter)
    from voxelry.operators.interpolate import min_max_normalised

    return min_max_normalised(rows).withColumn("v", F.floor(F.col("v") * 255).cast("int"))
