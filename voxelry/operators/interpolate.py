"""Interpolations onto the doubled grid, normalisations, and the closed form of the 2-D well-composed field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.scalar import snap
from voxelry.operators.lattice import CELL, VOLUME, neighbours, to_cells


def interval_span(voxels: DataFrame) -> DataFrame:
    """Each cell's interval: from the least to the greatest of the voxels at its corners."""
    return to_cells(voxels).groupBy(*CELL).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def stencils(voxels: DataFrame) -> DataFrame:
    """Interval, mean and median of each cell's corners in one aggregation."""
    return to_cells(voxels).groupBy(*CELL).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.median("v").alias("median"))


def nearest(voxels: DataFrame) -> DataFrame:
    """Order-0 interpolation; a cell half-way takes the upper voxel. No aggregation: each cell has one source."""
    return to_cells(voxels, above=0).select(*CELL, F.col("v").alias("u"))


def linear(voxels: DataFrame) -> DataFrame:
    """Order-1 interpolation at half steps: the mean of the corners."""
    return to_cells(voxels).groupBy(*CELL).agg(F.avg("v").alias("u"))


def zoomed(voxels: DataFrame, order: int, low: float = 0, high: float = 255) -> DataFrame:
    """Interpolation of order 0 or 1, clipped."""
    if order not in (0, 1):
        raise ValueError("order must be 0 or 1")
    out = (nearest, linear)[order](voxels)
    return out.withColumn("u", snap(F.col("u").cast("double"), F.lit(float(low)), F.lit(float(high))))


def corner_median(voxels: DataFrame) -> DataFrame:
    """Median of the corners: the mean of the middle two for an even number."""
    return to_cells(voxels).groupBy(*CELL).agg(F.median("v").alias("u"))


def border_level(voxels: DataFrame) -> DataFrame:
    """(vol_id, l_inf): the median over the six faces; a voxel on several faces counts for each."""
    faces = sum(((F.col(c) == e).cast("int") for c, n in (("x", "w"), ("y", "h"), ("z", "d")) for e in (F.lit(0), F.col(n) - 1)), F.lit(0))
    on = voxels.withColumn("_faces", faces).filter("_faces > 0")
    return on.groupBy("vol_id").agg(F.percentile("v", 0.5, F.col("_faces")).alias("l_inf"))


def with_border_level(cells: DataFrame, voxels: DataFrame, l_inf: str | float = "border_median") -> DataFrame:
    """Add l_inf to each row: the border's median, 0 for ``zero``, or a number."""
    if l_inf == "border_median":
        return cells.join(border_level(voxels), "vol_id")
    return cells.withColumn("l_inf", F.lit(0.0 if l_inf == "zero" else float(l_inf)))


def padded(cells: DataFrame) -> DataFrame:
    """The cells (lo, hi, l_inf) with a border of one cell at l_inf all around: coordinates run from -1 to the size."""
    sizes = cells.select(*VOLUME, "l_inf").distinct()
    for e, n in (("ex", "w"), ("ey", "h"), ("ez", "d")):
        sizes = sizes.withColumn(e, F.explode(F.sequence(F.lit(-1), 2 * F.col(n) - 1)))
    rim = F.lit(False)
    for e, n in (("ex", "w"), ("ey", "h"), ("ez", "d")):
        rim = rim | F.col(e).isin(-1) | (F.col(e) == 2 * F.col(n) - 1)
    rim_rows = sizes.filter(rim).select(*CELL, F.rint("l_inf").alias("lo"), F.rint("l_inf").alias("hi"), "l_inf")
    return cells.select(*CELL, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "l_inf").unionByName(rim_rows)


def field_2d(voxels: DataFrame, l_inf: str | float = "zero") -> DataFrame:
    """Well-composed field of 2-D images: every cell touches the border level, so it is that level snapped to the span."""
    cells = with_border_level(interval_span(voxels), voxels, l_inf)
    return cells.select(*CELL, snap(F.rint("l_inf"), F.col("lo"), F.col("hi")).cast("int").alias("u"))


def self_dual_correction(cells: DataFrame, rounds: int = 1) -> DataFrame:
    """Clip cells of dimension 1 and more to the range of their six neighbours, the cell itself standing in beyond the
    grid; all at once in each round."""
    for _ in range(rounds):
        at = [F.col(e) for e in ("ex", "ey", "ez")]
        edge = F.lit(False)
        for e, n in zip(at, ("w", "h", "d"), strict=True):
            edge = edge | (e == 0) | (e == 2 * F.col(n) - 2)
        around = neighbours(cells.withColumn("_edge", edge)).groupBy(*CELL).agg(
            F.max(F.when(F.col("_self"), F.col("u"))).alias("_u"), F.max(F.when(F.col("_self"), F.col("_edge"))).alias("_edge"), F.min(F.when(~F.col("_self"), F.col("u"))).alias("_lo"), F.max(F.when(~F.col("_self"), F.col("u"))).alias("_hi"))
        low = F.when(F.col("_edge"), F.least("_lo", "_u")).otherwise(F.col("_lo"))
        high = F.when(F.col("_edge"), F.greatest("_hi", "_u")).otherwise(F.col("_hi"))
        kind = at[0] % 2 + at[1] % 2 + at[2] % 2
        cells = around.select(*CELL, F.when(kind > 0, snap(F.col("_u"), low, high)).otherwise(F.col("_u")).alias("u"))
    return cells


def immerse(voxels: DataFrame, rounds: int = 1) -> DataFrame:
    """The older immersion: voxels at even cells, medians elsewhere, then the self-dual correction."""
    return self_dual_correction(corner_median(voxels), rounds)


def exact_percentiles(rows: DataFrame, key: str, column: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """(key, p array<double>): percentiles by linear interpolation between ranks, from two passes of bins.

    The first pass counts equal steps between a key's extremes; the second counts the values within the steps that hold a
    wanted rank. No buffer holds a key's values, and a window holds its steps, or the distinct values of one step.
    """
    v = F.col(column).cast("double")
    rows = rows.filter(F.col(column).isNotNull()).select(key, v.alias("_v"))
    ends = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    step = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = rows.join(ends, key).select(key, "_n", "_v", step.cast("int").alias("_bin"))
    counted = placed.groupBy(key, "_n", "_bin").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(key).orderBy("_bin")) - F.col("_k")
    place = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    held = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))
    wanted = counted.withColumn("_before", before).withColumn("_ranks", held).filter("size(_ranks) > 0").select(key, "_bin", "_before", "_ranks")
    values = placed.join(wanted, [key, "_bin"]).groupBy(key, "_n", "_bin", "_before", "_ranks", "_v").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(key, "_bin").orderBy("_v")) + F.col("_before")
    values = values.withColumn("_upto", upto)
    mine = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_k")) & (r < F.col("_upto")))
    found = values.select(key, "_n", "_v", F.explode(mine).alias("_rank")).groupBy(key, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return found.select(key, F.array(*[between(p) for p in place]).alias("p"))


def percentile_normalised(voxels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """0-255 between two percentiles of the positive voxels, floored; voxels at 0 and volumes of zeros stay 0."""
    cut = exact_percentiles(voxels.filter("v > 0"), "vol_id", "v", [low, high]).withColumnRenamed("p", "_p")
    out = voxels.join(cut, "vol_id", "left")
    share = (F.col("v") - F.col("_p")[0]) / (F.col("_p")[1] - F.col("_p")[0] + 1e-9)
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255)
    return out.withColumn("v", F.when(F.col("v") > 0, level).otherwise(0).cast("int")).drop("_p")


def min_max_normalised(voxels: DataFrame) -> DataFrame:
    """0-1 between a volume's extremes; constant volumes become 0."""
    ends = voxels.groupBy("vol_id").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    return voxels.join(ends, "vol_id").withColumn("v", F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(0.0)).drop("_low", "_high")


def thresholded(voxels: DataFrame, limit: Column | float) -> DataFrame:
    """Mask column ``m``: above the limit."""
    return voxels.withColumn("m", F.col("v") > limit)


def label_upsampled(voxels: DataFrame) -> DataFrame:
    """Masks on the doubled grid: nearest voxel, then at least one half."""
    return nearest(voxels).withColumn("u", (F.col("u") >= 0.5).cast("int"))


#: The four methods by name; each maps voxels to a field (CELL, u).
METHODS = {
    "nearest": nearest,
    "linear": linear,
    "field_border": lambda v: field_2d(v, "border_median"),
    "field_zero": lambda v: field_2d(v, "zero"),
}


def method(name: str):
    """An interpolation by name; ValueError if there is none of that name."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; there are {sorted(METHODS)}")
    return METHODS[name]


def register(name: str, f) -> None:
    """Add an interpolation of one's own: voxels to (CELL, u)."""
    METHODS[name] = f
