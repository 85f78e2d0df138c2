import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.operators import decompose, interpolate, labels, propagate, topology, verify
from voxelry.plans import experiments
from voxelry.plans.queries import EPS_GRID
from voxelry.sources import raster


def dense(df, names=("ex", "ey", "ez"), value="u"):
    pdf = df.toPandas()
    out = np.full(tuple(pdf[n].max() + 1 for n in names), np.nan)
    out[tuple(pdf[n] for n in names)] = pdf[value]
    return out


def noise(shape, seed=0, top=256):
    return np.random.default_rng(seed).integers(0, top, shape)


GOLDEN = [[9, 11, 15], [7, 1, 13], [3, 5, 3]]


def test_sizes_and_spans(voxels):
    v = noise((3, 4, 5))
    cells = interpolate.interval_span(voxels(v0=v))
    assert cells.count() == 5 * 7 * 9
    low, high = propagate.dense_span(v)
    assert (dense(cells, value="lo") == low).all() and (dense(cells, value="hi") == high).all()
    assert cells.filter("lo > hi").count() == 0


def test_linear_and_nearest_on_a_small_image(voxels):
    df = voxels(v0=GOLDEN)
    mean, near = dense(interpolate.linear(df))[..., 0], dense(interpolate.nearest(df))[..., 0]
    assert mean[0, 1] == 10 and mean[1, 1] == 7 and mean[2, 2] == 1
    assert near[1, 1] == 1 and near[0, 1] == 11 and near[4, 4] == 3


def test_one_pixel_image(voxels):
    df = voxels(v0=[[7]])
    assert interpolate.field_2d(df).select("u").first().u == 7


def test_closed_form_is_the_propagated_field(voxels):
    df = voxels(v0=noise((5, 6), 1), v1=noise((5, 6), 2), v2=GOLDEN + [])
    for l_inf in ("zero", "border_median", 90):
        a = interpolate.field_2d(df, l_inf)
        b = propagate.propagated(df, l_inf)
        worst = verify.differing(a, b).agg(F.max("cells_differ")).first()[0]
        assert worst == 0


@pytest.mark.parametrize("l_inf", ["zero", "border_median"])
def test_gray_volumes_are_well_composed(voxels, l_inf):
    df = voxels(v0=noise((4, 5, 6), 3), v1=noise((5, 5, 5), 4), v2=noise((4, 4, 7), 5, 2) * 255)
    field = propagate.propagated(df, l_inf)
    rows = {r.vol_id: r for r in verify.well_composed(field).collect()}
    assert all(r.n_violations == 0 and r.dwc_ok for r in rows.values())
    w, h, d = 7, 9, 11
    faces = (w - 1) * (h - 1) * d + (w - 1) * h * (d - 1) + w * (h - 1) * (d - 1)
    assert rows[0].n_blocks == faces + (w - 1) * (h - 1) * (d - 1)
    assert verify.within_span(field, interpolate.interval_span(df)).agg(F.sum("n_outside")).first()[0] == 0
    assert verify.voxel_error(field, df).agg(F.max("max_error")).first()[0] == 0


def test_self_duality_with_the_border_median(voxels):
    v = noise((5, 4, 4), 6)
    a, b = (dense(propagate.propagated(voxels(v0=x), "border_median")) for x in (v, 255 - v))
    assert np.abs(a - (255 - b)).max() <= 1


def test_checkerboard_violates(voxels):
    cells = [F.lit(2).alias(c) if c in "wh" else F.col(c) for c in ("vol_id", "w", "h", "d")]
    board = voxels(v0=[[1, 0, 1], [0, 1, 0], [1, 0, 1]]).select(*cells, F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"), F.col("v").alias("u"))
    row = verify.well_composed(board, flat=True).first()
    assert (row.n_blocks, row.n_violations, row.max_abs_error, row.dwc_ok) == (4, 4, 1, False)
    assert verify.violating_cells(board, flat=True).count() == 9
    assert verify.violating_cells(board, flat=True, most=3).count() == 3


@pytest.mark.parametrize("seed", range(6))
def test_small_and_large_grids_close_alike(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, (2, 20, 256)[seed % 3], (4, 3, 5))
    low, high = propagate.dense_span(v)
    seeds = None
    if seed > 2:
        seeds = np.where(rng.random(low.shape) < 0.1, rng.integers(low, high + 1), -1)
    assert (propagate.close_levels(low, high, 7, seeds) == propagate.close_levels(low, high, 7, seeds, small=0)).all()


def queue_field(low, high, l_inf, seeds=None):
    """One cell at a time from a first-in first-out queue for each level, over a padded grid held in dictionaries."""
    import collections

    span = {tuple(i): (int(low[tuple(i)]), int(high[tuple(i)])) for i in np.ndindex(low.shape)}
    rim = {i for i in np.ndindex(tuple(n + 2 for n in low.shape))}
    span = {tuple(c - 1 for c in i): span.get(tuple(c - 1 for c in i), (l_inf, l_inf)) for i in rim}
    queues, seen, out, level = collections.defaultdict(collections.deque), set(), {}, l_inf

    def put(cell, value):
        if cell in span and cell not in seen:
            seen.add(cell)
            queues[value].append(cell)

    put((-1, -1, -1), l_inf)
    for i in np.ndindex(low.shape) if seeds is not None else ():
        if seeds[i] >= 0:
            put(i, int(seeds[i]))
    while any(queues.values()):
        level = min((v for v in queues if queues[v]), key=lambda v: (abs(v - level), -v))
        cell = queues[level].popleft()
        out[cell] = level
        for axis in range(3):
            for d in (-1, 1):
                near = tuple(c + d * (a == axis) for a, c in enumerate(cell))
                if near in span:
                    put(near, max(span[near][0], min(level, span[near][1])))
    return np.array([out[i] for i in np.ndindex(low.shape)]).reshape(low.shape)


@pytest.mark.parametrize("seed", range(6))
def test_field_against_a_queue(seed):
    rng = np.random.default_rng(seed)
    low, high = propagate.dense_span(rng.integers(0, (2, 20, 256)[seed % 3], (3, 4, 3)))
    seeds = np.where(rng.random(low.shape) < 0.1, rng.integers(low, high + 1), -1) if seed > 2 else None
    for small in (0, 4096):
        assert (propagate.close_levels(low, high, (0, 7, 90)[seed % 3], seeds, small) == queue_field(low, high, (0, 7, 90)[seed % 3], seeds)).all()


def test_sweep_and_fill(voxels):
    v = noise((4, 4, 4), 11, 2) * 200
    swept = propagate.propagated(voxels(v0=v), "zero", ascending=True)
    closed = dense(propagate.propagated(voxels(v0=v), "zero"))
    found = dense(swept)
    assert (found[~np.isnan(found)] == closed[~np.isnan(found)]).all()
    cells = interpolate.interval_span(voxels(v0=v)).join(swept.select("vol_id", "ex", "ey", "ez", "u"), ["vol_id", "ex", "ey", "ez"])
    filled = propagate.gap_filled(cells, 3)
    assert filled.filter("u is null or u < lo or u > hi").count() == 0 and filled.count() == 7**3


def test_volumes_are_validated(voxels):
    df = voxels(v0=noise((3, 3, 3)))
    assert verify.validated(df) is df
    for bad in (df.drop("z"), df.filter("x > 0"), df.unionByName(df.limit(1)), df.withColumn("x", F.col("x") + 1), df.withColumn("v", F.col("v").cast("double")), df.withColumn("v", F.when(F.col("x") > 0, F.col("v")))):
        with pytest.raises(ValueError):
            verify.validated(bad)


def test_sample_is_the_same_however_dealt(voxels):
    df = voxels(v0=noise((20, 20))).withColumn("key", F.col("x") * 20 + F.col("y"))
    one, two = ({r.key for r in labels.sampled(d, "key", 30, 5).collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 30 and one != {r.key for r in labels.sampled(df, "key", 30, 6).collect()}


def test_bell_and_random_walls(spark):
    side = 16
    bell = dense(raster.formula(spark, 0, (side,) * 3, raster.bell(side, 220)), ("x", "y", "z"), "v")
    assert bell.max() == bell[8, 8, 8] == 220 and (bell[:, 8, 8] == bell[8, :, 8]).all()
    size, value = raster.membranes()["random"]
    walls = dense(raster.formula(spark, 0, size, value), ("x", "y", "z"), "v")
    assert walls.shape == (48, 48, 24) and all(1 <= (walls[:, :, z].mean(axis=0) == 1).sum() <= 6 for z in range(24))


def test_slab_bounds_are_checked(voxels):
    with pytest.raises(ValueError):
        decompose.inject_each(voxels(v0=noise((3, 3, 4))), 2, 1, shift=2)


def test_determinism(voxels):
    df = voxels(v0=noise((4, 4, 4), 9))
    assert (dense(propagate.propagated(df)) == dense(propagate.propagated(df))).all()


def test_border_level_counts_edges_twice(voxels):
    v = noise((3, 4, 5), 7)
    faces = np.concatenate([f.ravel() for f in (v[0], v[-1], v[:, 0], v[:, -1], v[:, :, 0], v[:, :, -1])])
    assert interpolate.border_level(voxels(v0=v)).first().l_inf == np.median(faces)


def test_padding(voxels):
    df = voxels(v0=GOLDEN)
    cells = interpolate.padded(interpolate.with_border_level(interpolate.interval_span(df), df, 4))
    assert cells.count() == 7 * 7 * 3 and cells.filter("ex = -1 and lo = 4 and hi = 4").count() == 21


def test_percentile_normalisation(voxels):
    v = noise((8, 8), 8)
    v[0] = 0
    got = dense(interpolate.percentile_normalised(voxels(v0=v)), ("x", "y", "z"), "v")[..., 0]
    p1, p99 = np.percentile(v[v > 0], [1, 99])
    want = np.where(v > 0, np.floor(np.clip((v - p1) / (p99 - p1 + 1e-9), 0, 1) * 255), 0)
    assert (got == want).all()
    assert interpolate.percentile_normalised(voxels(v0=np.zeros((3, 3), int))).agg(F.max("v")).first()[0] == 0


def test_methods_by_name(voxels):
    assert interpolate.method("field_zero")(voxels(v0=GOLDEN)).count() == 25
    with pytest.raises(ValueError):
        interpolate.method("none")


@pytest.mark.parametrize("mask, low, high, chi", [
    (np.pad(np.ones((10, 10), int), 5), 1, 1, 1),
    (np.eye(4, dtype=int), 4, 1, 4),
    (np.pad(np.ones((3, 3), int), 1) - np.pad(np.ones((1, 1), int), 2), 1, 1, 0),
])
def test_known_topology_2d(voxels, mask, low, high, chi):
    on = voxels(v0=mask).filter("v = 1")
    row = topology.components(on, ["vol_id"], {"a": 4, "b": 8}, ("x", "y", "z")).first()
    assert (row.a, row.b) == (low, high)
    assert topology.euler(on, ["vol_id"], ("x", "y", "z"), flat=True).first().chi == chi


def test_known_topology_3d(voxels):
    a = np.zeros((9, 9, 9), int)
    a[1:4, 1:4, 1:4] = 1
    a[4:6, 4:6, 4:6] = 1  # meets the first cube at a corner
    on = voxels(v0=a).filter("v = 1")
    row = topology.components(on, ["vol_id"], {"a": 6, "b": 18, "c": 26}, ("x", "y", "z")).first()
    assert (row.a, row.b, row.c) == (2, 2, 1)
    assert topology.euler(on, ["vol_id"], ("x", "y", "z")).first().chi == 2


def test_large_components_agree(voxels):
    df = voxels(v0=noise((12, 12, 1), 3, 2), v1=noise((12, 12, 1), 4, 2)).filter("v = 1")
    small = {r.vol_id: r.b0 for r in topology.components(df, ["vol_id"], 8, ("x", "y", "z")).collect()}
    large = topology.large_components(df, 8, ("x", "y", "z"), (F.col("w"), F.col("h"), F.col("d")))
    assert {r.vol_id: r.n for r in large.filter("point = root").groupBy("vol_id").agg(F.count("*").alias("n")).collect()} == small


def test_shapes_have_their_topology(spark):
    want = {"disk": (1, 1), "ring": (1, 0), "two_disks": (2, 2), "line": (1, 1), "cross_gap": (4, 4), "diagonal": (24, 24)}
    for k, (name, (size, value)) in enumerate(raster.shapes().items()):
        on = raster.formula(spark, k, size, value).filter("v = 1")
        b0 = topology.components(on, ["vol_id"], 4, ("x", "y", "z")).first().b0
        assert (b0, topology.euler(on, ["vol_id"], ("x", "y", "z"), flat=True).first().chi) == want[name], name


def test_constant_block_is_stable(voxels):
    field = interpolate.linear(voxels(v0=np.full((8, 8), 200))).withColumn("u", F.col("u") / 255)
    assert topology.stability(topology.counts(field, [0.1, 0.4, 0.7], flat=True)).first().tsi == 0


def test_membrane_tiles_crop(voxels):
    v = np.zeros((6, 6), int)
    v[3:] = 1
    m = dense(labels.membrane(voxels(v0=v)), ("x", "y", "z"), "m")[..., 0]
    assert (m == ((np.arange(6) == 2) | (np.arange(6) == 3))[:, None]).all()
    assert labels.tiles(voxels(v0=v), 4, 2).count() == 4 * 16
    c = labels.crop(voxels(v0=v), (0, 2, 0), (3, 2, 1), 1)
    assert c.agg(F.max("w"), F.max("h"), F.max("off_x"), F.max("off_y")).first() == (4, 4, 0, 1)
    assert labels.transposed(voxels(v0=noise((2, 3, 4))), ("z", "x", "y")).select("w", "h", "d").first() == (4, 2, 3)


def test_slabs_cover_and_agree(voxels):
    df = voxels(v0=noise((4, 4, 7), 1), v1=noise((4, 4, 7), 2, 2) * 255)
    parts = decompose.slabs(df, 3, 1).filter("vol_id = 0").orderBy("k").collect()
    assert [(p.z0, p.z1, p.z0e, p.z1e) for p in parts] == [(0, 3, 0, 4), (3, 5, 2, 6), (5, 7, 4, 7)]
    for k in (1, 2, 4):
        field, rounds = decompose.inject(df, k)
        assert field.count() == 2 * 7 * 7 * 13 and rounds >= 1
        bad = verify.boundary_violations(field, decompose.bounds_of(decompose.slabs(df, k)))
        assert bad.agg(F.coalesce(F.sum("bdry_violations"), F.lit(0))).first()[0] == 0
        if k == 1:
            assert verify.differing(field, propagate.propagated(df, "zero")).agg(F.sum("cells_differ")).first()[0] == 0
    with pytest.raises(ValueError):
        decompose.inject(df, 2, 0)


def test_each_volume_has_its_own_rounds(voxels):
    values = {"v0": np.zeros((4, 4, 4), int), "v1": noise((4, 4, 4), 1)}
    found = {tuple(r)[:1] + tuple(r)[-1:] for r in experiments.sweep(voxels(**values), "v", [(4, 1, 1.0)]).select("subject", "rounds").collect()}
    alone = {(name, decompose.inject(voxels(**{name: v}), 4, eps=1.0)[1]) for name, v in values.items()}
    assert found == alone and ("v0", 1) in found and max(r for _, r in found) > 1
    assert {k for k, _, _ in EPS_GRID} == {2, 4} and {d for _, d, _ in EPS_GRID} == {1, 2} and {e for _, _, e in EPS_GRID} == {0.1, 0.5, 1.0, 2.0}


def test_order_is_total(voxels):
    field = propagate.ordered(interpolate.field_2d(voxels(v0=GOLDEN)))
    assert sorted(r.f_ord for r in field.collect()) == list(range(25))
