"""Well-composedness and other checks of fields, as blocks that cells are scattered to."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.functions.scalar import span_gap
from voxelry.operators.lattice import CELL, VOLUME, neighbours
from voxelry.sources.store import unsent

AXES = ("ex", "ey", "ez")
#: Planes of face blocks by the axes they span, and the body block.
PLANES = {"xy": (0, 1), "xz": (0, 2), "yz": (1, 2), "xyz": (0, 1, 2)}


def block_corners(field: DataFrame, planes: tuple[str, ...] = ("xy", "xz", "yz", "xyz")) -> DataFrame:
    """A row for each block of 2x2 (2x2x2) cells at step one: its plane, anchor and corner values c0, c1, ...

    Corner k of a block lies one step along each of the block's axes whose bit is set in k. Blocks that would leave the
    grid have no row; a 2-D image (d = 1) has xy blocks alone.
    """
    targets = []
    for plane in planes:
        axes = PLANES[plane]
        for bits in product((0, 1), repeat=len(axes)):
            step = [0, 0, 0]
            for a, b in zip(axes, bits, strict=True):
                step[a] = b
            targets.append((plane, sum(b << i for i, b in enumerate(bits)), step))
    structs = [F.struct(F.lit(p).alias("plane"), F.lit(k).alias("corner"), *[(F.col(e) - s).alias(f"a{e}") for e, s in zip(AXES, step, strict=True)]) for p, k, step in targets]
    out = field.select(*CELL, "u", F.explode(F.array(*structs)).alias("_b")).select(*VOLUME, "u", "_b.*")
    inside = F.lit(True)
    for i, (e, n) in enumerate(zip(AXES, ("w", "h", "d"), strict=True)):
        spans = [p for p in planes if i in PLANES[p]]
        limit = 2 * F.col(n) - 2 - F.col("plane").isin(spans).cast("int") if spans else 2 * F.col(n) - 2
        inside = inside & (F.col(f"a{e}") >= 0) & (F.col(f"a{e}") <= limit)
    corners = max(len(PLANES[p]) for p in planes)
    values = [F.max(F.when(F.col("corner") == k, F.col("u"))).alias(f"c{k}") for k in range(1 << corners)]
    return out.filter(inside).groupBy(*VOLUME, "plane", "aex", "aey", "aez").agg(*values)


def face_gap(c: list[Column] | None = None) -> Column:
    """Gap between the two diagonals' intervals of a face block, by default of its columns; above 0 in a violating one."""
    c = c or [F.col(f"c{k}") for k in range(4)]
    return span_gap((c[0], c[3]), (c[1], c[2]))


def body_gap(c: list[Column] | None = None) -> Column:
    """The widest gap between a space diagonal's interval and the span of the other six corners."""
    c = c or [F.col(f"c{k}") for k in range(8)]
    gaps = [span_gap((c[k], c[7 - k]), [x for i, x in enumerate(c) if i not in (k, 7 - k)]) for k in range(4)]
    return F.greatest(*gaps)


def blocks(field: DataFrame, flat: bool = False) -> DataFrame:
    """Blocks of a field with their gap; ``flat`` for 2-D images, which have xy blocks alone."""
    found = block_corners(field, ("xy",) if flat else ("xy", "xz", "yz", "xyz"))
    gap = face_gap() if flat else F.when(F.col("plane") == "xyz", body_gap()).otherwise(face_gap())
    return found.withColumn("gap", gap)


def well_composed(field: DataFrame, flat: bool = False) -> DataFrame:
    """Per volume n_blocks, n_violations, max_abs_error (over face blocks), violation_rate and dwc_ok."""
    face = F.col("plane") != "xyz"
    out = blocks(field, flat).groupBy("vol_id").agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("gap") > 0).alias("n_violations"),
        F.coalesce(F.max(F.when(face & (F.col("gap") > 0), F.col("gap"))), F.lit(0)).cast("double").alias("max_abs_error"),
        F.count_if(F.col("gap").isNull()).alias("skipped"))
    return out.withColumn("violation_rate", F.col("n_violations") / F.col("n_blocks")).withColumn("dwc_ok", F.col("n_violations") == 0)


def violating_cells(field: DataFrame, flat: bool = False, most: int | None = None) -> DataFrame:
    """Distinct cells in violating blocks; ``most`` keeps the first of each volume in row-major order."""
    bad = blocks(field, flat).filter("gap > 0")
    steps = []
    for plane, axes in PLANES.items():
        for bits in product((0, 1), repeat=len(axes)):
            step = [0, 0, 0]
            for a, b in zip(axes, bits, strict=True):
                step[a] = b
            steps.append((plane, step))
    to = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), *[(F.col(f"a{e}") + s).alias(e) for e, s in zip(AXES, step, strict=True)]) for p, step in steps]), lambda t: t.p == F.col("plane"))
    out = bad.withColumn("_c", F.explode(to)).select(*VOLUME, "_c.ex", "_c.ey", "_c.ez").distinct()
    if most is None:
        return out
    from pyspark.sql import Window

    return out.withColumn("_n", F.row_number().over(Window.partitionBy("vol_id").orderBy("ex", "ey", "ez"))).filter(F.col("_n") <= most).drop("_n")


def boundary_violations(field: DataFrame, bounds: DataFrame) -> DataFrame:
    """Violating xz and yz blocks at planes 2z-1 and 2z of the slab bounds (vol_id, zb), per volume."""
    planes = bounds.select("vol_id", F.explode(F.array(2 * F.col("zb") - 1, 2 * F.col("zb"))).alias("aez"))
    found = block_corners(field, ("xz", "yz")).join(planes, ["vol_id", "aez"], "left_semi")
    counted = found.groupBy("vol_id").agg(F.count_if(face_gap() > 0).alias("bdry_violations"))
    return bounds.select("vol_id").distinct().join(counted, "vol_id", "left").select("vol_id", F.coalesce("bdry_violations", F.lit(0)).alias("bdry_violations"))


def whole_blocks(fields: DataFrame, *more: str) -> DataFrame:
    """A row for each cell of small volumes whose field is in one row each (``propagate.whole``), with the gaps of the blocks
    that it is the anchor of (xy, xz, yz, xyz; null where there is none) and its plane ez: a block's corners are looked up in the
    row, and nothing is grouped or shuffled."""
    sizes = {f"_n{i}": 2 * F.col(n) - 1 for i, n in enumerate(("w", "h", "d"))}
    rows = fields.select(*VOLUME, *more, *[c.alias(n) for n, c in sizes.items()], F.col("u").alias("_all"), F.posexplode("u").alias("_at", "_0"))
    nx, ny, at = F.col("_n0"), F.col("_n1"), F.col("_at")
    rows = rows.withColumns({"ex": F.expr("int(_at div _n1 % _n0)"), "ey": at % ny, "ez": F.expr("int(_at div (_n0 * _n1))")})
    # corner k is a step further along each axis whose bit is set in k
    rows = rows.withColumns({f"_{k}": F.get("_all", at + (k & 1) * ny + (k >> 1 & 1) + (k >> 2) * nx * ny) for k in range(1, 8)})
    out = {}
    for plane, axes in PLANES.items():
        inside = reduce(lambda x, y: x & y, [F.col(AXES[i]) < F.col(f"_n{i}") - 1 for i in axes])
        corners = [F.col(f"_{sum(1 << a for i, a in enumerate(axes) if k >> i & 1)}") for k in range(1 << len(axes))]
        out[plane] = F.when(inside, body_gap(corners) if plane == "xyz" else face_gap(corners))
    return rows.select(*VOLUME, *more, "ez", *[g.alias(p) for p, g in out.items()])


def whole_checked(fields: DataFrame, bounds: DataFrame | str | None = None, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    """Per small volume (``propagate.whole``) n_cells, n_blocks, n_violations and, with slab bounds (vol_id, zb), or the name of a column
    with each row's as an array, bdry_violations. ``keys`` tell the rows of ``fields`` apart."""
    if isinstance(bounds, str):
        fields = fields.withColumn("_planes", F.flatten(F.transform(bounds, lambda zb: F.array(2 * zb - 1, 2 * zb))))
    elif bounds is not None:
        planes = bounds.groupBy("vol_id").agg(F.flatten(F.collect_list(F.array(2 * F.col("zb") - 1, 2 * F.col("zb")))).alias("_planes"))
        fields = fields.join(planes, "vol_id", "left")
    there = lambda p: F.col(p).isNotNull().cast("int")
    bad = lambda p: F.coalesce((F.col(p) > 0).cast("int"), F.lit(0))
    of_blocks = lambda f, planes: F.sum(reduce(lambda a, b: a + b, [f(p) for p in planes])).cast("long")
    sums = [F.count("*").alias("n_cells"), of_blocks(there, PLANES).alias("n_blocks"), of_blocks(bad, PLANES).alias("n_violations")]
    if bounds is not None:
        sums.append(F.coalesce(F.sum(F.when(F.array_contains("_planes", F.col("ez")), bad("xz") + bad("yz"))), F.lit(0)).alias("bdry_violations"))
    return unsent(whole_blocks(fields, *["_planes"][: bounds is not None], *[k for k in keys if k not in VOLUME]).groupBy(*keys).agg(*sums))


def self_dual(field: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per volume the number of cells of dimension 1 and more outside the range of their neighbours."""
    around = neighbours(field).groupBy(*CELL).agg(F.max(F.when(F.col("_self"), F.col("u"))).alias("u"), F.min(F.when(~F.col("_self"), F.col("u"))).alias("lo"), F.max(F.when(~F.col("_self"), F.col("u"))).alias("hi"))
    kind = F.col("ex") % 2 + F.col("ey") % 2 + F.col("ez") % 2
    bad = (kind > 0) & ((F.col("u") < F.col("lo") - tolerance) | (F.col("u") > F.col("hi") + tolerance))
    return around.groupBy("vol_id").agg(F.count_if(bad).alias("n_outside"))


def voxel_error(field: DataFrame, voxels: DataFrame) -> DataFrame:
    """Per volume the greatest difference between a voxel and its cell."""
    at = voxels.select("vol_id", (2 * F.col("x")).alias("ex"), (2 * F.col("y")).alias("ey"), (2 * F.col("z")).alias("ez"), "v")
    return field.join(at, ["vol_id", "ex", "ey", "ez"]).groupBy("vol_id").agg(F.max(F.abs(F.col("u") - F.col("v"))).alias("max_error"))


def within_span(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Per volume the number of cells whose value leaves their interval."""
    both = field.select("vol_id", "ex", "ey", "ez", "u").join(cells.select("vol_id", "ex", "ey", "ez", "lo", "hi"), ["vol_id", "ex", "ey", "ez"])
    return both.groupBy("vol_id").agg(F.count_if((F.col("u") < F.col("lo")) | (F.col("u") > F.col("hi"))).alias("n_outside"), F.count("*").alias("n_cells"))


def whole_differing(a: DataFrame, b: DataFrame, bounds: DataFrame) -> DataFrame:
    """``differing`` for small volumes whose fields are in one row each (``propagate.whole``), joined by volume."""
    near = bounds.groupBy("vol_id").agg(F.flatten(F.collect_list(F.array(*[2 * F.col("zb") + i for i in range(-2, 3)]))).alias("_planes"))
    both = a.join(b.select("vol_id", F.col("u").alias("_b")), "vol_id").join(near, "vol_id", "left")
    cells = both.select("vol_id", "w", "h", "_b", "_planes", F.posexplode("u").alias("_at", "_u"))
    gap = F.abs(F.col("_u") - F.col("_b")[F.col("_at")])
    ez = F.floor(F.col("_at") / ((2 * F.col("w") - 1) * (2 * F.col("h") - 1))).cast("int")
    close = F.max(F.when(F.array_contains("_planes", ez), gap))
    return unsent(cells.groupBy("vol_id").agg(F.count_if(gap > 0).alias("cells_differ"), F.max(gap).alias("max_diff"), F.coalesce(close, F.max(gap)).alias("max_diff_bounds")))


def whole_beside(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of small volumes, with u from their volume's row (``propagate.whole``), joined by volume alone: both are dealt out so."""
    nx, ny = 2 * F.col("w") - 1, 2 * F.col("h") - 1
    both = cells.join(fields.select("vol_id", F.col("u").alias("_u")), "vol_id")
    return both.withColumn("u", F.get("_u", ((F.col("ez") * nx + F.col("ex")) * ny + F.col("ey")).cast("int"))).drop("_u")


def shape_checks(voxels: DataFrame) -> DataFrame:
    """Per volume how its rows differ from a whole lattice of its size: n_rows, n_wanted, n_outside, n_twice, n_null, ok."""
    inside = F.lit(True)
    for c, n in (("x", "w"), ("y", "h"), ("z", "d")):
        inside = inside & F.col(c).between(0, F.col(n) - 1)
    per = voxels.groupBy("vol_id", "w", "h", "d", "x", "y", "z").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))
    out = per.groupBy("vol_id").agg(
        F.sum("n").alias("n_rows"), F.max(F.col("w").cast("long") * F.col("h") * F.col("d")).alias("n_wanted"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outside"),
        F.count_if(F.col("n") > 1).alias("n_twice"), F.sum("nulls").alias("n_null"))
    fine = (F.col("n_rows") == F.col("n_wanted")) & (F.col("n_outside") == 0) & (F.col("n_twice") == 0) & (F.col("n_null") == 0)
    return out.withColumn("ok", fine)


def validated(voxels: DataFrame, integers: bool = True) -> DataFrame:
    """``voxels`` unchanged; ValueError if a column lacks, levels are no integers, or a volume is not a whole lattice."""
    if missing := [c for c in (*VOLUME, "x", "y", "z", "v") if c not in voxels.columns]:
        raise ValueError(f"missing columns: {missing}")
    kind = voxels.schema["v"].dataType.simpleString()
    if integers and kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"levels are {kind}, not integers")
    if bad := shape_checks(voxels).filter("not ok").limit(1).collect():
        raise ValueError(f"not a whole volume: {bad[0].asDict()}")
    return voxels


def differing(a: DataFrame, b: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Per volume how many cells of two fields differ, and by how much at most; with slab bounds (vol_id, zb) also by how much at
    most on the planes up to two away from one (max_diff_bounds, of all planes where a volume has no bounds)."""
    both = a.select("vol_id", "ex", "ey", "ez", F.col("u").alias("ua")).join(b.select("vol_id", "ex", "ey", "ez", F.col("u").alias("ub")), ["vol_id", "ex", "ey", "ez"])
    gap = F.abs(F.col("ua") - F.col("ub"))
    sums = [F.count_if(gap > 0).alias("cells_differ"), F.max(gap).alias("max_diff")]
    if bounds is None:
        return both.groupBy("vol_id").agg(*sums)
    planes = bounds.select("vol_id", F.explode(F.array(*[2 * F.col("zb") + i for i in range(-2, 3)])).alias("ez")).distinct().withColumn("_near", F.lit(True))
    near = both.join(planes, ["vol_id", "ez"], "left")
    return near.groupBy("vol_id").agg(*sums, F.coalesce(F.max(F.when(F.col("_near"), gap)), F.max(gap)).alias("max_diff_bounds"))
