"""Components, Euler numbers and what follows from them, per volume and any further keys such as a threshold."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.operators.blocks import components_by_level, half_steps, measured_by_level, near_pairs, stars, united
from voxelry.sources.store import checkpointed


def thresholded(field: DataFrame, thresholds: list[float]) -> DataFrame:
    """Mask rows (keys of the field, thr) of the points at or above each threshold: all thresholds in one job."""
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("u") >= t)
    return field.withColumn("thr", F.explode(passed))


def parts_of(points: DataFrame, keys: list[str], names: tuple[str, str, str], flat: bool, *sums: Column) -> DataFrame:
    """Vertices, edges, faces and cubes (n: their dimension) all of whose corners are points, with ``sums`` over the corners.

    A point is scattered to every cube part that it can be a corner of; a part counts if all its corners are there.
    """
    axes = (0, 1) if flat else (0, 1, 2)
    targets = []
    for n in range(len(axes) + 1):
        for span in combinations(axes, n):
            for bits in product((0, 1), repeat=n):
                step = [0, 0, 0]
                for a, b in zip(span, bits, strict=True):
                    step[a] = b
                targets.append((sum(1 << a for a in span), n, step))
    to = F.explode(F.array(*[F.struct(F.lit(kind).alias("part"), F.lit(n).alias("n"), *[(F.col(c) - s).alias(f"p{i}") for i, (c, s) in enumerate(zip(names, step, strict=True))]) for kind, n, step in targets]))
    rows = points.withColumn("_t", to).select(*[c for c in points.columns if c not in ("n", "part", "p0", "p1", "p2")], "_t.*")
    parts = rows.groupBy(*keys, "part", "n", "p0", "p1", "p2").agg(F.count("*").alias("corners"), *sums)
    return parts.filter(F.col("corners") == F.pow(F.lit(2), F.col("n")))


def euler(mask: DataFrame, keys: list[str], names: tuple[str, str, str] = ("ex", "ey", "ez"), flat: bool = False) -> DataFrame:
    """Per key chi = vertices - edges + faces - cubes of the points of ``mask``, its rows being the points."""
    whole = parts_of(mask.select(*keys, *names), keys, names, flat)
    return whole.groupBy(*keys).agg(F.sum(F.when(F.col("n") % 2 == 0, 1).otherwise(-1)).alias("chi"))


def levelled(field: DataFrame, thresholds: list[float]) -> DataFrame:
    """Adds level: how many of the thresholds, in rising order, u reaches."""
    return field.withColumn("level", sum((F.coalesce((F.col("u") >= float(t)).cast("int"), F.lit(0)) for t in thresholds), F.lit(0)))


def euler_in_blocks(mask: DataFrame, keys: list[str], names: tuple[str, str, str] = ("ex", "ey", "ez"), flat: bool = False) -> DataFrame:
    """Per key chi of the rows whose column ``on`` holds, as by ``euler``, 0 where none does; in blocks, as ``counts``."""
    return measured_by_level(mask.withColumn("level", F.col("on").cast("int")), keys, 1, {}, names, flat=flat).select(*keys, "chi")


def label(points: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """A root for each of distinct lattice points (n x 3): the smallest row of its component."""
    if not len(points):
        return np.arange(0)
    return united(np.arange(len(points)), *near_pairs(points.astype(np.int64), np.zeros(len(points), np.int64), steps))


def components(mask: DataFrame, keys: list[str], connectivity: int | dict[str, int], names: tuple[str, str, str] = ("ex", "ey", "ez"), edge: int | None = None) -> DataFrame:
    """Per key the number of components of the points of ``mask``: b0, or a column for each named connectivity.

    Blocks (``edge`` points wide) are labelled by themselves, and only labels that touch across their faces are joined.
    """
    wanted = {"b0": connectivity} if isinstance(connectivity, int) else connectivity
    return components_by_level(mask.withColumn("level", F.lit(1)), keys, 1, wanted, names, edge).drop("level")


def large_components(mask: DataFrame, connectivity: int, names: tuple[str, str, str] = ("ex", "ey", "ez"), sizes: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """(vol_id, point, root) for volumes too large for a task: star contraction over the edges, by (vol_id, point).

    Neighbours come from scattering each point to itself and to its steps, not from a self-join over all pairs.
    """
    w, h, d = sizes or tuple(2 * F.col(c) - 1 for c in ("w", "h", "d"))
    code = lambda s: ((F.col(names[0]).cast("long") + s[0] + 1) * (h + 2) + F.col(names[1]) + s[1] + 1) * (d + 2) + F.col(names[2]) + s[2] + 1
    own = checkpointed(mask.select("vol_id", code((0, 0, 0)).alias("point"), F.array(*[code(s) for s in half_steps(connectivity)]).alias("near")), "points")
    edges = own.select("vol_id", F.col("point").alias("v"), F.explode("near").alias("u")).join(own.select("vol_id", F.col("point").alias("u")), ["vol_id", "u"], "left_semi")
    found = own.join(stars(edges, ["vol_id"]).select("vol_id", F.col("u").alias("point"), F.col("v").alias("root")), ["vol_id", "point"], "left")
    return found.select("vol_id", "point", F.coalesce("root", "point").alias("root"))


def cross_metrics(b0_low: Column, b0_high: Column, chi: Column, ref_chi: Column) -> dict[str, Column]:
    """cc, cc_zero, b0_consistency, chi_sign_flip and beta1 (of mixed adjacency) as columns."""
    return {
        "cc": F.abs(b0_low - b0_high),
        "cc_zero": (b0_low == b0_high).cast("int"),
        "b0_consistency": F.when(b0_low > 0, F.bround(b0_high / b0_low, 6)).otherwise(1.0),
        "chi_sign_flip": ((ref_chi != 0) & (ref_chi * chi < 0)).cast("int"),
        "beta1_proxy": F.greatest(F.lit(0), b0_high - chi),
    }


def profile(field: DataFrame, thresholds: list[float], flat: bool = False, keys: tuple[str, ...] = ("vol_id",), edge: int | None = None) -> DataFrame:
    """``counts`` with a column binary: whether all of the key's values are 0 or 1."""
    low, high = (4, 8) if flat else (6, 26)
    steps = sorted({float(t) for t in thresholds})
    found = measured_by_level(levelled(field, steps), list(keys), len(steps), {"b0_low": low, "b0_high": high}, edge=edge, flat=flat, mark=F.col("u").isin(0, 1))
    thr = F.element_at(F.array(*[F.lit(t) for t in steps]), F.col("level"))
    return found.select(*keys, thr.alias("thr"), "b0_low", "b0_high", "chi", F.col("mark").alias("binary"))


def counts(field: DataFrame, thresholds: list[float], flat: bool = False, keys: tuple[str, ...] = ("vol_id",), edge: int | None = None) -> DataFrame:
    """Per key and threshold b0 under both adjacencies and chi; keys whose mask is empty have zeros.

    All thresholds are read from one merge tree, and all columns from one pass over the field.
    """
    return profile(field, thresholds, flat, keys, edge).drop("binary")


def stability(counted: DataFrame, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    """Threshold stability index: population standard deviation, over the thresholds, of b0 under the wider adjacency."""
    return counted.groupBy(*keys).agg(F.stddev_pop("b0_high").alias("tsi"))


def betti(counted: DataFrame, flat: bool = False) -> DataFrame:
    """Adds b0 and b1 to rows of ``counts``: components under the narrower adjacency, and holes, -1 (unknown) in 3-D."""
    holes = F.greatest(F.lit(0), F.col("b0_low") - F.col("chi")) if flat else F.lit(-1).cast("long")
    return counted.withColumns({"b0": F.col("b0_low"), "b1": holes})


def is_binary(field: DataFrame, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    return field.groupBy(*keys).agg(F.bool_and(F.col("u").isin(0, 1)).cast("int").alias("is_binary"))


def bundle(field: DataFrame, reference: DataFrame, threshold: float, thresholds: list[float], flat: bool = False, keys: tuple[str, ...] = ("vol_id", "method")) -> DataFrame:
    """All topology metrics of each field against (vol_id, ref_chi) of the original mask: a row for each key."""
    counted = profile(field, sorted({threshold, *thresholds}), flat, keys)
    there, wanted = F.col("thr") == threshold, F.col("thr").isin([float(t) for t in thresholds])
    at = counted.groupBy(*keys).agg(*[F.max(F.when(there, F.col(c))).alias(c) for c in ("b0_low", "b0_high", "chi")], F.stddev_pop(F.when(wanted, F.col("b0_high"))).alias("tsi"), F.bool_and("binary").cast("int").alias("is_binary"))
    at = at.join(reference, "vol_id").select(*keys, "b0_low", "b0_high", "chi", "ref_chi", "tsi", "is_binary")
    return at.withColumns(cross_metrics(F.col("b0_low"), F.col("b0_high"), F.col("chi"), F.col("ref_chi")))
