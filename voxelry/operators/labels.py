"""Label images: membranes, tiles, crops and gates."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators.lattice import VOXEL, neighbours


def membrane(labels: DataFrame) -> DataFrame:
    """Voxels (VOXEL, v, m): m is true where one of the six (in an image four) neighbours has another label."""
    bounds = tuple(F.col(n) - 1 for n in ("w", "h", "d"))
    around = neighbours(labels.select(*VOXEL, "v"), ("x", "y", "z"), bounds).groupBy(*VOXEL).agg(F.max(F.when(F.col("_self"), F.col("v"))).alias("v"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return around.select(*VOXEL, "v", (F.col("_lo") != F.col("_hi")).alias("m"))


def tiles(voxels: DataFrame, size: int, stride: int) -> DataFrame:
    """Each voxel once for every full tile of size x size that holds it: tile columns tx, ty and places px, py."""
    out = voxels
    for c, t, p, n in (("x", "tx", "px", "w"), ("y", "ty", "py", "h")):
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int")
        high = F.least(F.floor(F.col(c) / stride), F.floor((F.col(n) - size) / stride)).cast("int")
        out = out.filter(F.col(n) >= size).withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
        out = out.withColumn(t, F.explode(F.sequence("_low", "_high"))).withColumn(p, (F.col(c) - F.col(t) * stride).cast("int")).drop("_low", "_high")
    return out


def crop(voxels: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int], pad: int = 0) -> DataFrame:
    """The part of each volume from ``low`` on, ``pad`` wider on each side, clamped to it, as volumes of their own.

    off_x, off_y, off_z hold how far the wanted part begins within the padded one.
    """
    out = voxels
    for c, n, a, s in zip(("x", "y", "z"), ("w", "h", "d"), low, size, strict=True):
        first, last = F.greatest(F.lit(0), F.lit(a - pad)), F.least(F.col(n), F.lit(a + s + pad))
        out = out.withColumn("_first", first).withColumn("_last", last).filter((F.col(c) >= F.col("_first")) & (F.col(c) < F.col("_last")))
        out = out.withColumn(c, F.col(c) - F.col("_first")).withColumn(n, F.col("_last") - F.col("_first")).withColumn(f"off_{c}", F.lit(a) - F.col("_first")).drop("_first", "_last")
    return out


def transposed(voxels: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """Axes renamed: the new x, y, z are the old ones named in ``order``."""
    size = {"x": "w", "y": "h", "z": "d"}
    rest = [c for c in voxels.columns if c not in VOXEL]
    return voxels.select("vol_id", *[F.col(size[o]).alias(n) for o, n in zip(order, ("w", "h", "d"), strict=True)], *[F.col(o).alias(n) for o, n in zip(order, ("x", "y", "z"), strict=True)], *rest)


def foreground(masks: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """(vol_id, fg_rate) of the volumes whose share of mask voxels lies between the bounds."""
    rate = masks.groupBy("vol_id").agg(F.avg(F.col("m").cast("int")).alias("fg_rate"))
    return rate.filter(F.col("fg_rate").between(low, high))


def not_empty(masks: DataFrame) -> DataFrame:
    """(vol_id, n_on) of the volumes with any mask voxel."""
    return masks.groupBy("vol_id").agg(F.count_if("m").alias("n_on")).filter("n_on > 0")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for a seed whatever the partitioning: those with the least hashes."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return rows.orderBy(order, key).limit(n)


def integral(masks: DataFrame) -> DataFrame:
    """(VOXEL, total): how many mask voxels lie at or before each voxel along all three axes: sums along one line after the
    other, so that a window holds one line. ``masks`` has all voxels."""
    out = masks.select(*VOXEL, F.col("m").cast("long").alias("total"))
    for axis in ("z", "y", "x"):
        line = Window.partitionBy("vol_id", *[a for a in ("x", "y", "z") if a != axis]).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("total", F.sum("total").over(line))
    return out


def box_sums(masks: DataFrame, corners: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Corners (vol_id, attempt, x0, y0, z0) with n_on and n: mask voxels and voxels of the box there, as far as it lies in the
    volume. Eight values of the integral volume give a box's sum, so a voxel is read once, whatever the number of boxes."""
    sizes = masks.select("vol_id", "w", "h", "d").distinct()
    at = corners.join(sizes, "vol_id")
    ends, n = [], F.lit(1)
    for c, e, s in zip(("x", "y", "z"), ("w", "h", "d"), size, strict=True):
        low, high = F.greatest(F.col(f"{c}0"), F.lit(0)), F.least(F.col(f"{c}0") + s, F.col(e))
        ends.append((low - 1, high - 1))
        n = n * F.greatest(high - low, F.lit(0))
    at = at.withColumn("n", n.cast("long")).filter("n > 0")
    looks = [F.struct(*[ends[i][b].cast("int").alias(c) for i, (c, b) in enumerate(zip(("x", "y", "z"), bits, strict=True))], F.lit(1 if sum(bits) % 2 else -1).alias("sign")) for bits in product((0, 1), repeat=3)]
    key = ["vol_id", "attempt", "x0", "y0", "z0", "n"]
    wanted = at.select(*key, F.explode(F.array(*looks)).alias("_l")).select(*key, "_l.*")
    found = wanted.join(integral(masks).select("vol_id", "x", "y", "z", "total"), ["vol_id", "x", "y", "z"], "left")
    return found.groupBy(*key).agg(F.coalesce(F.sum(F.col("sign") * F.col("total")), F.lit(0)).alias("n_on"))


def patches(masks: DataFrame, corners: DataFrame, size: tuple[int, int, int], wanted: int, low: float = 0.01, high: float = 0.30) -> DataFrame:
    """The first ``wanted`` of the corners (vol_id, attempt, x0, y0, z0) whose patch has a fitting share of mask voxels.

    Corners come from a seeded generator, a bounded number of attempts.
    """
    rate = box_sums(masks, corners, size).select("vol_id", "attempt", "x0", "y0", "z0", (F.col("n_on") / F.col("n")).alias("fg_rate"))
    return rate.filter(F.col("fg_rate").between(low, high)).orderBy("vol_id", "attempt").limit(wanted)
