"""Volumes in blocks against whole volumes, exact percentiles, box sums, and the data sources."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelry.functions import timing
from voxelry.operators import blocks, decompose, fronts, interpolate, labels, propagate, stats, topology, verify
from voxelry.plans import experiments
from voxelry.sources import formats, raster, volumes
from voxelry.sources.store import checkpointed
from voxelry.streaming import records


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def noise(voxels):
    rng = np.random.default_rng(0)
    return voxels(v1=rng.integers(0, 256, (12, 9, 14)), v2=rng.integers(0, 40, (5, 5, 5)), v3=rng.integers(0, 256, (1, 3, 2)), v4=np.full((6, 6, 6), 7))


@pytest.mark.parametrize("l_inf", ["zero", "border_median", 100])
def test_front_over_blocks(noise, l_inf):
    columns = ("vol_id", "w", "h", "d", "ex", "ey", "ez", "u")
    assert rows_of(fronts.propagated_in_blocks(noise, l_inf, 8), *columns) == rows_of(propagate.propagated(noise, l_inf), *columns)


def test_front_from_seeds(spark, voxels):
    v = np.random.default_rng(1).integers(0, 256, (6, 7, 5))
    low, high = propagate.dense_span(v)
    seeds = np.full(low.shape, -1)
    seeds[::2, ::3, 4] = v[::1, ::1, 2][: seeds[::2, ::3, 4].shape[0], : seeds[::2, ::3, 4].shape[1]]
    pins = [(1, 6, 7, 5, *map(int, at), int(seeds[tuple(at)])) for at in np.argwhere(seeds >= 0)] + [(1, 6, 7, 5, 1, 1, 1, None)]
    df = spark.createDataFrame(pins, "vol_id long, w int, h int, d int, ex int, ey int, ez int, u int")
    low[seeds >= 0] = high[seeds >= 0] = seeds[seeds >= 0]
    want = propagate.close_levels(low, high, 0, seeds)
    got = {(r.ex, r.ey, r.ez): r.u for r in fronts.propagated_in_blocks(voxels(v1=v), "zero", 4, df).collect()}
    assert got == {tuple(map(int, at)): int(want[tuple(at)]) for at in np.argwhere(want > -1)}
    with pytest.raises(ValueError, match="even"):
        fronts.propagated_in_blocks(voxels(v1=v), "zero", 5)


@pytest.mark.parametrize("flat", [True, False])
def test_merge_trees_by_block(spark, voxels, flat):
    rng = np.random.default_rng(2)
    shapes = [(30, 17), (5, 40)] if flat else [(12, 9, 11), (5, 5, 13)]
    df = voxels(v1=rng.integers(0, 100, shapes[0]), v2=rng.integers(0, 100, shapes[1])).selectExpr("vol_id", "w", "h", "d", "x AS ex", "y AS ey", "z AS ez", "v / 100 AS u")
    low, high = (4, 8) if flat else (6, 26)
    found = [rows_of(topology.counts(df, [0.3, 0.5, 0.55, 0.7, 2.0], flat, edge=e), "vol_id", "thr", "b0_low", "b0_high", "chi") for e in (None, 4, 7)]
    assert found[0] == found[1] == found[2]
    for vol, thr, b0_low, b0_high, chi in found[0]:  # each threshold by itself
        on = df.filter((F.col("vol_id") == vol) & (F.col("u") >= thr)).cache()
        alone = {c: topology.components(on, ["vol_id"], c).first() for c in (low, high)}
        assert [b0_low, b0_high] == [alone[c].b0 if alone[c] else 0 for c in (low, high)]
        euler = topology.euler(on, ["vol_id"], flat=flat).first()
        assert chi == (euler.chi if euler else 0)


def test_components_of_a_large_volume(spark):
    """Stripes of ten million places: bars three apart along two axes, cut into two by a plane that is left out."""
    n = 216
    z, y, x = F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / n**2)
    on = spark.range(n**3).select(F.lit(1).alias("vol_id"), x.cast("int").alias("ex"), y.cast("int").alias("ey"), z.cast("int").alias("ez")).filter("ex % 3 = 0 and ey % 3 = 0 and ez <> 100")
    row = topology.components(on, ["vol_id"], {"low": 6, "high": 26}).first()
    assert (row.low, row.high) == (2 * 72**2, 2 * 72**2)


def test_stability_of_known_images(voxels):
    bars = np.zeros((16, 16))
    bars[3:13, 2:7] = bars[3:13, 9:14] = 1.0
    bars[7:9, 7:9] = 0.3
    df = voxels(v1=np.full((31, 31), 200), v2=(bars * 255).astype(int)).selectExpr("vol_id", "w", "h", "d", "x AS ex", "y AS ey", "z AS ez", "v / 255 AS u")
    nine = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
    field = interpolate.linear(voxels(v2=(bars * 1000).astype(int))).withColumn("u", F.col("u") / 1000)
    assert {r.vol_id: r.tsi for r in topology.stability(topology.counts(df, nine, flat=True)).collect()}[1] == 0
    assert topology.stability(topology.counts(field, nine, flat=True)).first().tsi > 0


def test_stability_takes_the_wider_adjacency(spark):
    counted = spark.createDataFrame([(1, 0.3, 5, 1), (1, 0.4, 1, 3)], "vol_id long, thr double, b0_low long, b0_high long")
    assert topology.stability(counted).first().tsi == 1.0


def test_every_plane_at_every_halo(voxels):
    v = np.random.default_rng(3).integers(0, 256, (4, 4, 9))
    df = voxels(v1=v)
    got = {r.delta: r for r in decompose.step_by_delta(df, 3, [0, 1, 2, 3]).collect()}
    assert {r.n_cells for r in got.values()} == {7 * 7 * 17}
    assert all(0 <= r.bdry_violations <= r.n_violations for r in got.values())
    with pytest.raises(Exception, match="halo above"):
        decompose.round_zero(df, decompose.slabs(df, 3, 0)).collect()


def test_epsilon_summary_has_sample_stds(spark):
    rows = spark.createDataFrame([("a", 0.1, 1, 2), ("b", 0.1, 3, 2), ("a", 0.5, 4, 1)], "subject string, eps double, violations long, rounds long")
    got = {r.eps: (round(r.viol_std, 9), r.rounds_std) for r in stats.per_epsilon(rows).collect()}
    assert got == {0.1: (round(2**0.5, 9), 0.0), 0.5: (0.0, 0.0)}


def test_deep_holes(spark):
    cells = [(1, 6, 1, 1, e, 0, 0, 0, 9, 5 if e == 0 else None) for e in range(11)] + [(2, 1, 1, 1, 0, 0, 0, 3, 9, None)]
    df = spark.createDataFrame(cells, "vol_id long, w int, h int, d int, ex int, ey int, ez int, lo int, hi int, u int")
    got = {(r.vol_id, r.ex): r.u for r in propagate.gap_filled(df, None).collect()}
    assert got == {**{(1, e): 5 for e in range(11)}, (2, 0): 3}
    assert sum(r.u == 0 for r in propagate.gap_filled(df, 4).collect()) == 6


def test_ranks_over_ranges(spark, noise):
    field = propagate.propagated(noise, "zero")
    got = propagate.ordered(field).collect()
    for vol in (1, 2, 3, 4):
        rows = sorted((r.f_ord, r.u, r.ex, r.ey, r.ez) for r in got if r.vol_id == vol)
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_exact_percentiles(spark, bins):
    rng = np.random.default_rng(4)
    values = {1: rng.normal(size=301), 2: [5.0], 3: [1.0] * 50 + [1e9], 4: rng.integers(0, 4, 77).astype(float), 5: [-2.0, 7.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [(1, None)], "k long, v double")
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {r.k: r.p for r in interpolate.exact_percentiles(df, "k", "v", shares, bins).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert np.allclose(got[k], np.percentile(v, [100 * s for s in shares]), rtol=1e-12)


def test_box_sums(spark, voxels):
    m = np.random.default_rng(5).random((9, 7, 6)) < 0.3
    masks = voxels(v1=m.astype(int)).withColumn("m", F.col("v") > 0)
    corners = [(1, i, *c) for i, c in enumerate([(0, 0, 0), (3, 2, 1), (-2, 5, 4), (8, 6, 5), (20, 0, 0)])]
    got = {r.attempt: (r.n_on, r.n) for r in labels.box_sums(masks, spark.createDataFrame(corners, "vol_id long, attempt int, x0 int, y0 int, z0 int"), (4, 3, 2)).collect()}
    want = {i: m[max(x, 0) : max(x + 4, 0), max(y, 0) : y + 3, z : z + 2] for _, i, x, y, z in corners}
    assert got == {i: (int(p.sum()), p.size) for i, p in want.items() if p.size}


def test_nifti_planes(spark, tmp_path):
    v = np.random.default_rng(6).integers(0, 256, (5, 4, 12), np.uint8)
    import gzip

    (tmp_path / "a.nii").write_bytes(volumes.write_nifti(v))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volumes.write_nifti(v[:, :, :3])))
    formats.register(spark)
    for size in (1 << 20, 60):
        df = spark.read.format("nifti_planes").option("part_bytes", size).load(f"file://{tmp_path}")
        got = {(r.vol_id, r.x, r.y, r.z): r.v for r in df.filter("z >= 2 and z < 5").collect()}
        assert got == {(n, x, y, z): float(a[x, y, z]) for n, a in (("a", v), ("b", v[:, :, :3])) for x in range(5) for y in range(4) for z in range(2, min(5, a.shape[2]))}
    reader = formats.NiftiReader(f"file://{tmp_path}", 60)
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    assert len(list(reader.pushFilters([GreaterThan(("z",), 1), LessThanOrEqual(("z",), 6)]))) == 2
    assert [p.pieces for p in reader.partitions() if p.pieces[0][0].endswith("a.nii")] == [[(f"{tmp_path}/a.nii", 2, 5)], [(f"{tmp_path}/a.nii", 5, 7)]]


def test_raw_sink_commits_whole_or_not(spark, voxels, tmp_path):
    field = interpolate.interval_span(voxels(v1=np.arange(60).reshape(3, 4, 5), v2=np.arange(8).reshape(2, 2, 2))).withColumn("u", F.col("hi"))
    uri = f"file://{tmp_path}/raw"
    formats.write_raw_ranges(field, uri)
    got = {(r.vol_id, r.place): r.u for r in formats.read_raw_ranges(spark, uri).collect()}
    want = {(str(r.vol_id), (r.ex * (2 * r.h - 1) + r.ey) * (2 * r.d - 1) + r.ez): r.u for r in field.collect()}
    assert got == want and (tmp_path / "raw/1.txt").read_text().startswith("width = 5\nheight = 7\n")
    assert not (tmp_path / "raw/_tmp").exists()
    bad = field.withColumn("u", F.when((F.col("vol_id") == 2) & (F.col("ex") == 2), F.raise_error("lost")).otherwise(F.col("u")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        formats.write_raw_ranges(bad, f"file://{tmp_path}/bad")
    assert not list(tmp_path.glob("bad/**/*.bin"))


def test_records_after_a_restart(spark):
    rows = [(f"s{i % 7}", 2, i % 2, 0.1, i % 3, i % 4) for i in range(40)] + [(None, 4, 1, 0.5, None, 2)]
    df = spark.createDataFrame(rows, records.RECORD).dropDuplicates(["subject", "K", "delta"])
    got = {(r.K, r.delta, r.eps): tuple(r)[3:] for r in records.replayed(df, "rounds < 2").collect()}
    want = stats.per_epsilon(df.na.fill({"subject": "", "violations": 0}), ("K", "delta", "eps")).select(*got_columns())
    for r in want.collect():
        assert np.allclose(got[r.K, r.delta, r.eps], tuple(r)[3:])
    assert len(got) == 3


def got_columns():
    return [c.split()[0] for c in records.SUMMARY.split(", ")]


def test_runs_of_groups(spark):
    import pyarrow as pa

    df = spark.range(1000).selectExpr("nullif(id % 13, 5) AS k", "cast(id % 3 AS string) AS s", "id")
    work = lambda t, code: pa.table({"n": pa.array(np.bincount(np.unique(code, return_inverse=True)[1]), pa.int64())})
    for least in (1, 50, 10_000):
        assert sorted(r.n for r in blocks.by_runs(df, ["k", "s"], work, "n long", least).collect()) == sorted(r["count"] for r in df.groupBy("k", "s").count().collect())


def test_timed():
    ran = []
    out = timing.timed(lambda: ran.append(1), 3, 2)
    assert len(ran) == 5 and len(out["all_times"]) == 3 and out["std_s"] >= 0 and timing.timed(lambda: None, 1, 0)["std_s"] == 0
    with pytest.raises(ValueError):
        timing.timed(lambda: None, 0)


def test_stored_for_another_size(voxels, tmp_path):
    path = f"file://{tmp_path}/store"
    experiments.cached(voxels(v1=np.zeros((2, 2), int)), interpolate.linear, path)
    assert experiments.cached(voxels(v1=np.zeros((2, 2), int)), interpolate.linear, path).count() == 9
    with pytest.raises(ValueError, match="another size"):
        experiments.cached(voxels(v1=np.zeros((2, 3), int)), interpolate.linear, path)


def test_rule_of_thin_slabs(spark):
    columns = "K int, delta int, dwc_ok boolean, D_sub int, sigma_cover int, rho_pct double, plane_width_med double"
    rows = [(2, 1, True, 40, 20, 2.5, 1.0), (2, 1, True, 40, 20, 2.5, 1.0), (4, 1, False, 20, 10, 5.0, 1.0), (8, 1, True, 10, 5, 10.0, 1.0)]
    table = stats.slab_table(spark.createDataFrame(rows, columns))
    assert {r.K: r.thin_right for r in table.collect()} == {2: True, 4: True, 8: False}
    assert tuple(stats.rule_accuracy(table).first()) == (2, 3)


def broadcasts(df) -> int:
    """How many tables a plan would send through the driver."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_lattices_and_stored_tables_are_never_broadcast(spark):
    points = spark.range(40).selectExpr("0L as vol_id", "id as x", "0 as y", "0 as z", "1 as v")
    images = raster.dense(points, spark.range(1).selectExpr("id as vol_id"), (F.lit(50), F.lit(1), F.lit(1)))
    assert broadcasts(images.filter("v > 0")) == 0 and images.filter("v > 0").count() == 40
    table = checkpointed(spark.range(100).selectExpr("id as k", "1 as a"), "alike")
    assert broadcasts(table.join(table.groupBy("k").agg(F.sum("a").alias("b")), "k")) == 0
    assert broadcasts(table.join(spark.range(100).selectExpr("id as k").filter("k > 0").join(table, "k"), "k")) == 0


def test_small_volumes_are_checked_in_their_rows(noise):
    parts = decompose.slabs(noise, 3, 1)
    bounds = decompose.bounds_of(parts)
    packed = decompose.slab_fields(noise, parts, None, 0, 0)
    columns = ["vol_id", "n_cells", "n_blocks", "n_violations", "bdry_violations"]
    assert rows_of(decompose.checked(packed, bounds, small=True), *columns) == rows_of(decompose.checked(packed, bounds), *columns)
    assert packed.count() == parts.count()  # what is stored and shuffled is a row for each slab, not for each cell
    whole, cells = propagate.whole(packed), propagate.cells_of(packed)
    other = propagate.propagated_whole(noise, "zero")
    columns = ["vol_id", "cells_differ", "max_diff", "max_diff_bounds"]
    assert rows_of(verify.whole_differing(whole, other, bounds), *columns) == rows_of(verify.differing(cells, propagate.cells_of(other), bounds), *columns)


@pytest.mark.parametrize("l_inf", [0, 90, 300])
def test_grids_that_close_in_step_are_those_that_close_alone(l_inf):
    rng = np.random.default_rng(3)
    for size, top, share in (((4, 4, 4), 256, 0.0), ((3, 5, 2), 256, 0.2), ((5, 4, 6), 3, 0.1), ((4, 4, 4), 9000, 0.4), ((1, 2, 5), 256, 0.3)):
        low, high = propagate.dense_span(rng.integers(0, top, (9, *size)), 1)
        seeds = np.where(rng.random(low.shape) < share, rng.integers(0, top, low.shape), -1)
        waits = seeds >= 0
        rim = np.ones(low.shape[1:], bool)
        rim[1:-1, 1:-1, 1:-1] = False
        volume = np.arange(9)[::-1]  # grid i is of volume 8 - i
        at = np.where(waits, seeds, np.clip(l_inf, low[volume], high[volume]))
        got = propagate.closed_in_step(low, high, volume, at, waits | rim, ~(waits | rim), l_inf)
        for i, k in enumerate(volume):
            low_i, high_i = (np.where(waits[i], seeds[i], a[k]) for a in (low, high))
            assert (got[i] == propagate.close_levels(low_i, high_i, l_inf, seeds[i])).all()


@pytest.mark.parametrize("k, delta, eps, most, shift, one_plane", [(2, 1, 0.5, 8, 0, False), (3, 2, 3.0, 8, 0, False), (2, 1, 0.5, 1, 1, True), (1, 1, 0.5, 8, 0, False)])
def test_rounds_of_small_volumes_are_in_one_task(noise, k, delta, eps, most, shift, one_plane):
    found = [decompose.injected(noise, k, delta, 0, most, eps, shift, one_plane, small) for small in (False, True)]
    (field, took), (small, small_took) = found
    assert rows_of(propagate.cells_of(small), "vol_id", "w", "h", "d", "ex", "ey", "ez", "u") == rows_of(propagate.cells_of(field), "vol_id", "w", "h", "d", "ex", "ey", "ez", "u")
    assert rows_of(small_took, "vol_id", "rounds", "converged") == rows_of(took, "vol_id", "rounds", "converged")
    assert small.count() == 4


def test_sweep_of_small_volumes_is_one_pass(spark, noise, monkeypatch):
    configs = [(2, 1, 0.5), (2, 1, 40.0), (3, 2, 0.5)]
    columns = ["subject", "K", "delta", "eps", "violations", "rounds"]
    want = rows_of(experiments.sweep(noise, "v", configs), *columns)
    stored = []
    for module in (decompose, experiments):
        monkeypatch.setattr(module, "checkpointed", lambda df, name, *keys: stored.append(name) or checkpointed(df, name, *keys))
    got = experiments.sweep(noise, "v", configs, small=True)
    assert rows_of(got, *columns) == want and len(want) == 12
    # no round is stored and read again, and no setting has a pass of its own
    assert not stored and got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(ValueError, match="halo"):
        experiments.sweep(noise, "v", [(2, 0, 0.5)], small=True)


def test_small_slabs_of_one_shape_and_place_close_in_one_call(monkeypatch):
    rng = np.random.default_rng(4)
    parts = []
    for vol_id in range(6):
        size, (k, z0, z1, z0e, z1e) = [((4, 3, 5), (0, 0, 3, 0, 4)), ((4, 3, 5), (1, 3, 5, 2, 5)), ((2, 3, 5), (0, 0, 3, 0, 4))][vol_id // 2]
        same = dict(zip(("w", "h", "d"), size, strict=True)) | {"vol_id": vol_id, "k": k, "n": 2, "z0": z0, "z1": z1, "z0e": z0e, "z1e": z1e}
        at = np.argwhere(np.ones((*size[:2], z1e - z0e))) + [0, 0, z0e]
        parts += [{**same, "x": x, "y": y, "z": z, "v": int(rng.integers(0, 256)), "u": None} for x, y, z in at.tolist()]
        if vol_id % 2:  # the plane at the bound is pinned; such rows have but their slab
            parts += [{"vol_id": vol_id, "k": k, "x": x, "y": y, "z": 6, "u": int(rng.integers(0, 256))} for x in range(2 * size[0] - 1) for y in range(2 * size[1] - 1)]
    kind = pa.schema([(n, pa.int64() if n == "vol_id" else pa.int32()) for n in ("vol_id", "w", "h", "d", "x", "y", "z", "v", "k", "n", "z0", "z1", "z0e", "z1e", "u")])
    table = pa.Table.from_pylist(sorted(parts, key=lambda r: (r["vol_id"], r["x"])), kind)
    calls = []
    monkeypatch.setattr(decompose, "closed_in_step", lambda low, *more: calls.append(len(low)) or propagate.closed_in_step(low, *more))
    rows = lambda: sorted(decompose.closed_slabs(table, blocks.groups(table, ["vol_id", "k"]), 0).to_pylist(), key=lambda r: r["vol_id"])
    in_step = rows()
    assert calls == [2, 2, 2] and [(r["first"], len(r["u"])) for r in in_step] == [(0, 7 * 5 * 6)] * 2 + [(6, 7 * 5 * 3)] * 2 + [(0, 3 * 5 * 6)] * 2
    monkeypatch.setattr(decompose, "SMALL", 0)
    assert rows() == in_step and len(calls) == 3


def test_bounds_stand_on_the_rows(noise):
    parts = decompose.slabs(noise, 3, 1)
    bounds = decompose.bounds_of(parts)
    whole = propagate.whole(decompose.slab_fields(noise, parts, None, 0, 0)).withColumn("u", F.transform("u", lambda _, i: i * 7919 % 251))  # far from well-composed
    rows = whole.join(bounds.groupBy("vol_id").agg(F.collect_list("zb").alias("zb")), "vol_id").select(*whole.columns, "zb", F.lit(5).alias("k"))
    columns = ["vol_id", "n_cells", "n_blocks", "n_violations", "bdry_violations"]
    want = rows_of(verify.whole_checked(whole, bounds), *columns)
    assert rows_of(verify.whole_checked(rows, "zb", ("vol_id", "k")), *columns) == want and max(r[-1] for r in want) > 0


def test_gaps_of_volumes_dealt_out_are_filled_alike(noise):
    open_ = interpolate.interval_span(noise).withColumn("u", F.when((F.col("ex") + F.col("ey") + F.col("ez")) % 9 == 0, F.col("hi")))
    columns = ["vol_id", "ex", "ey", "ez", "u"]
    dealt = propagate.gap_filled(open_, None, ("vol_id",))
    assert rows_of(dealt, *columns) == rows_of(propagate.gap_filled(open_, None), *columns)


def test_state_of_records_is_kept_without_python(spark):
    plan = records.running_summaries(spark.createDataFrame([], records.RECORD))._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "Python" not in plan and "Pandas" not in plan


def test_blocks_of_small_volumes_close_in_one_task(spark, noise):
    columns = ["vol_id", "w", "h", "d", "ex", "ey", "ez", "u"]
    at = noise.filter("z % 2 = 0 and x > 0").select("vol_id", "w", "h", "d", (2 * F.col("x")).alias("ex"), F.col("y").alias("ey"), F.lit(0).alias("ez"), F.when(F.col("z") == 0, F.col("v")).alias("u"))
    at = at.unionByName(at.withColumn("vol_id", F.lit(99).cast("long")))  # of no volume
    for seeds in (None, at):
        found = [fronts.propagated_in_blocks(noise, 30, 4, seeds, 4, n) for n in (fronts.TOGETHER, 729, 0)]  # all, some, none in one task
        plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
        assert "InPandas" not in plan and plan.count("MapInArrow") == 1  # no call for each block
        assert rows_of(found[0], *columns) == rows_of(found[1], *columns) == rows_of(found[2], *columns)


def test_topology_from_one_pass_over_a_field(spark, voxels):
    rng = np.random.default_rng(7)
    df = voxels(v1=rng.integers(0, 101, (6, 5, 9)), v2=np.zeros((4, 4, 4), int), v3=100 * rng.integers(0, 2, (3, 7, 2)))
    df = df.selectExpr("vol_id", "w", "h", "d", "x AS ex", "y AS ey", "z AS ez", "v / 100 AS u", "'own' AS method").withColumn("on", F.col("u") >= 0.5)
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    ref = topology.euler_in_blocks(df, ["vol_id"]).withColumnRenamed("chi", "ref_chi")
    got = topology.bundle(df.mapInPandas(counted, df.schema), ref, 0.5, [0.3, 0.5, 0.7]).collect()
    assert seen.value == df.count()
    alone = {r.vol_id: r.chi for r in topology.euler(df.filter("on"), ["vol_id"]).collect()}
    assert {r.vol_id: (r.chi, r.ref_chi, r.is_binary) for r in got} == {v: (alone.get(v, 0), alone.get(v, 0), int(v > 1)) for v in (1, 2, 3)}
