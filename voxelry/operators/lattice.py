"""Voxel and cell tables, and the scatter that all local operators are made of.

Voxels: (vol_id, w, h, d, x, y, z, v); cells of the doubled grid: (vol_id, w, h, d, ex, ey, ez, ...), with w, h, d those
of the voxel grid. Sizes stand on the rows, so no operator joins a table of sizes. Volumes that are small and many are
dealt out by ``colocated`` once; as all later keys begin with vol_id, Spark then needs no further exchange. A volume
too large for a task stays spread, and each operator's aggregation shuffles what its partial sums leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLUME = ("vol_id", "w", "h", "d")
CELL = (*VOLUME, "ex", "ey", "ez")
VOXEL = (*VOLUME, "x", "y", "z")


def colocated(df: DataFrame, *keys: str) -> DataFrame:
    """All rows of a volume, or of a group by other keys, in one partition, of as many as the session's shuffles have.

    Their number is given, as adaptive execution would merge partitions until they have some bytes, and what is done with a
    volume takes far longer than its bytes do elsewhere: a few tasks would be left of many.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ("vol_id",)))


def spread(df: DataFrame, axes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each lattice point between the bounds (both included) along each new axis."""
    for name, (low, high) in axes.items():
        df = df.withColumn(name, F.explode(F.sequence(low, high)))
    return df


def to_cells(voxels: DataFrame, below: int = 1, above: int = 1) -> DataFrame:
    """Each voxel once for every cell of its neighbourhood in the doubled grid."""
    axes = {}
    for e, c, n in (("ex", "x", "w"), ("ey", "y", "h"), ("ez", "z", "d")):
        axes[e] = (F.greatest(2 * F.col(c) - below, F.lit(0)), F.least(2 * F.col(c) + above, 2 * F.col(n) - 2))
    return spread(voxels, axes)


def neighbours(cells: DataFrame, names: tuple[str, str, str] = ("ex", "ey", "ez"), bounds: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Each point once for itself (``_self``) and once for each of its six neighbours within bounds."""
    bounds = bounds or tuple(2 * F.col(n) - 2 for n in ("w", "h", "d"))
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    to = F.explode(F.array(*[F.struct(*[(F.col(n) + s).alias(n) for n, s in zip(names, step, strict=True)], F.lit(step == (0, 0, 0)).alias("_self")) for step in steps]))
    out = cells.withColumn("_to", to)
    for n in (*names, "_self"):
        out = out.withColumn(n, F.col(f"_to.{n}"))
    inside = F.lit(True)
    for n, b in zip(names, bounds, strict=True):
        inside = inside & (F.col(n) >= 0) & (F.col(n) <= b)
    return out.drop("_to").filter(inside)
