import json

import numpy as np
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from voxelry.operators import interpolate, labels, verify
from voxelry.plans import experiments
from voxelry.sources import hdf5, images, raster, results, volumes
from voxelry.streaming import fields


def test_png_round_trip(spark, tmp_path):
    g = np.arange(12).reshape(3, 4) * 20
    (tmp_path / "b.png").write_bytes(images.png(g))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    pdf = images.gray_images(spark, str(tmp_path)).toPandas()
    assert len(pdf) == 12 and set(pdf.vol_id) == {"b"}
    assert (pdf.sort_values(["x", "y"]).v.to_numpy() == g.ravel()).all()
    assert images.masks(images.gray_images(spark, str(tmp_path))).agg(F.sum("v")).first()[0] == (g / 255 > 0.5).sum()
    assert images.listed(spark, str(tmp_path), most=1).count() == 1


def test_png_files_are_read_once(spark, tmp_path):
    from tests.conftest import SF
    from voxelry.plans.files import QUERIES

    plan = QUERIES["png_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
    for i in range(40):
        (tmp_path / f"{i}.png").write_bytes(images.png(np.full((2, 3), i)))
    got = images.gray_images(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 4  # not one for every few files
    assert {(r.vol_id, r.w, r.h, r.d, r.x, r.y, r.z, r.v) for r in got.collect()} == {(str(i), 2, 3, 1, x, y, 0, i) for i in range(40) for x in range(2) for y in range(3)}


def test_tile_files(spark, voxels, tmp_path):
    tiles = labels.tiles(voxels(v0=np.arange(16).reshape(4, 4)), 2, 2)
    rows = images.tile_files(tiles, 2).orderBy("name").collect()
    assert [r.name for r in rows] == ["0_0000_0000.png", "0_0000_0001.png", "0_0001_0000.png", "0_0001_0001.png"]
    (tmp_path / "t.png").write_bytes(bytes(rows[1].content))
    assert sorted(r.v for r in images.gray_images(spark, str(tmp_path)).collect()) == [2, 3, 6, 7]


def test_nifti(spark, tmp_path):
    v = np.random.default_rng(0).integers(0, 255, (3, 4, 2)).astype(np.uint8)
    (tmp_path / "s1_flair.nii").write_bytes(volumes.write_nifti(v))
    (tmp_path / "s2_flair.nii").write_bytes(b"broken")
    pdf = volumes.nifti(spark, str(tmp_path), lead=False).toPandas()
    assert (pdf.sort_values(["x", "y", "z"]).v.to_numpy() == v.ravel()).all() and set(pdf.vol_id) == {"s1_flair"}
    turned = volumes.nifti(spark, str(tmp_path)).agg(F.max("w"), F.max("h"), F.max("d")).first()
    assert tuple(turned) == (2, 3, 4)
    files = spark.createDataFrame([("a", "x/a_t1.nii"), ("a", "x/a_flair.nii.gz"), ("b", "x/b_t1.nii"), ("c", "x/c.txt")], "subject string, path string")
    assert {(r.subject, r.path) for r in volumes.resolved(files, [r"_flair\.nii", r"_t1\.nii"]).collect()} == {("a", "x/a_flair.nii.gz"), ("b", "x/b_t1.nii")}


def test_raw_file(spark, voxels, tmp_path):
    field = interpolate.field_2d(voxels(v7=[[1, 2], [3, 4]]))
    assert volumes.write_raw(field, f"file://{tmp_path}/raw").collect()[0].n == 9
    assert np.fromfile(tmp_path / "raw/7.bin", "<i4")[0] == 1 and "width = 3" in (tmp_path / "raw/7.txt").read_text()


def test_records(spark, tmp_path):
    row = {"subject": "s", "K": 2, "delta": 1, "eps": 0.5, "violations": 0, "rounds": 2, "t_s": 1.5}
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"K_list": [2]}, "records": [row, row]}))
    assert results.read_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "r.csv").write_text(",".join(row) + "\n" + ",".join(map(str, row.values())) + "\n")
    assert results.read_records(spark, str(tmp_path / "r.csv")).first().eps == 0.5
    (tmp_path / "short.csv").write_text("subject,K\ns,2\n")
    with pytest.raises(ValueError):
        results.read_records(spark, str(tmp_path / "short.csv"))
    (tmp_path / "t.csv").write_text("subject_id,t\n__mean,1\na,N/A\n")
    assert results.timings(spark, str(tmp_path / "t.csv"), "subject_id string, t double").collect() == [("a", None)]


def test_resumption(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "k int, eps double, rounds int"
    assert results.done_rows(spark, store, schema).count() == 0
    grid = experiments.grid(spark, k=[2, 4], eps=[0.1, 0.5]).select(F.col("k").cast("int").alias("k"), "eps")
    results.append(grid.filter("k = 2").withColumn("rounds", F.lit(2)), store, "k")
    left = experiments.still_to_do(grid, results.done_rows(spark, store, schema), ["k", "eps"])
    assert sorted(tuple(r) for r in left.collect()) == [(4, 0.1), (4, 0.5)]


def test_cache(spark, voxels, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def compute(df):
        calls.append(df.select("vol_id").distinct().count())
        return interpolate.linear(df)

    one, two = voxels(v0=[[1, 2], [3, 4]]), voxels(v0=[[1, 2], [3, 4]], v1=[[5, 6], [7, 8]])
    assert experiments.cached(one, compute, path).count() == 9
    assert experiments.cached(two, compute, path).count() == 18 and calls == [1, 1]


def test_stream_equals_batch(spark, tmp_path):
    from tests.conftest import SF

    source = tmp_path / "in"
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(40).repartition(2).write.parquet(str(source))
    fields.run(fields.vectors(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("vol_id", "n_blocks", "n_violations")
    rows = spark.read.parquet(str(source)).select(F.col("vec_id").alias("vol_id"), "embedding")
    want = verify.well_composed(interpolate.field_2d(fields.images(rows)), flat=True).select("vol_id", "n_blocks", "n_violations")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40


def test_blobs(spark):
    v = raster.blobs(spark, (16, 16, 1), seed=3)
    assert tuple(v.agg(F.min("v"), F.max("v"), F.count("*")).first()) == (0, 255, 256)
    assert all(raster.formula(spark, 0, size, value).filter("v = 1").count() for size, value in raster.membranes().values())


def test_hdf5_read_by_planes(spark, tmp_path):
    rng = np.random.default_rng(5)
    gray, marks = rng.integers(0, 255, (23, 11, 9)).astype(np.float32), rng.integers(0, 2**62, (23, 11, 9)).astype(np.uint64)
    raw = hdf5.write_hdf5({"/volumes/raw": gray, "/volumes/labels/neuron_ids": marks, "other": marks[:2]}, (2, 3, 4))  # 144 chunks, a tree of two levels
    (tmp_path / "one.hdf").write_bytes(raw)
    (tmp_path / "flat.h5").write_bytes(hdf5.write_hdf5({"/volumes/raw": gray.astype(np.int16), "/volumes/labels/neuron_ids": marks}))
    (tmp_path / "note.txt").write_text("no volume")
    got = hdf5.hdf5_pair(spark, f"file://{tmp_path}").toPandas().sort_values(["vol_id", "z", "y", "x"])
    for _, own in got.groupby("vol_id"):
        assert (own.v.to_numpy() == gray.ravel()).all() and (own.label.to_numpy() == marks.ravel().astype(np.int64)).all()
    hdf5.register(spark)
    planes = spark.read.format("hdf5_planes").option("part_bytes", 2000).load(f"file://{tmp_path}/one.hdf").filter("z > 6 and z <= 9").toPandas()
    assert set(planes.z) == {7, 8, 9} and planes.v.sum() == gray[7:10].sum()
    reader = hdf5.Hdf5Reader(f"file://{tmp_path}/one.hdf", 2000, "/volumes/raw", None, "double")
    assert [p.pieces[0][1] % 2 for p in reader.partitions()] == [0] * len(reader.partitions()) and len(reader.partitions()) > 3


def test_hdf5_reads_no_other_chunks(spark, tmp_path):
    gray = np.random.default_rng(6).integers(0, 255, (40, 8, 8)).astype(np.uint8)
    raw = bytearray(hdf5.write_hdf5({"raw": gray}, (2, 8, 8)))
    (tmp_path / "whole.h5").write_bytes(bytes(raw))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "whole.h5")) as f:
        file = hdf5.Hdf5(f)
        data = file.dataset("raw")
        for offsets, size, _, address in list(file.chunks(data, data.address, 0, 40)):
            if offsets[0] != 12:
                raw[address : address + size] = bytes(size)
    (tmp_path / "holes.h5").write_bytes(bytes(raw))
    read = spark.read.format("hdf5_planes").option("dataset", "raw")
    hdf5.register(spark)
    assert read.load(f"file://{tmp_path}/holes.h5").filter("z >= 12 and z < 14").agg(F.sum("v")).first()[0] == gray[12:14].sum()
    with pytest.raises(Exception, match="Error -3|incorrect header"):
        read.load(f"file://{tmp_path}/holes.h5").agg(F.sum("v")).collect()


def test_hdf5_refuses(tmp_path):
    good = hdf5.write_hdf5({"a/b": np.zeros((2, 2, 2), np.uint8)})
    cases = {"no dataset c": (good, "a/c", "no c"), "text": (b"no HDF5 " * 20, "a/b", "not an HDF5"), "newer": (good[:8] + b"\x02" + good[9:], "a/b", "superblock 2"), "group": (good, "a", "no dataset"), "empty": (b"", "a/b", "not an HDF5")}
    for name, (raw, path, said) in cases.items():
        (tmp_path / name).write_bytes(raw)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f, pytest.raises(ValueError, match=said):
            hdf5.Hdf5(f).dataset(path)
    with pytest.raises(ValueError, match="eight names"):
        hdf5.write_hdf5({f"g{i}": np.zeros((1, 1, 1)) for i in range(9)})
    with pytest.raises(ValueError, match="filter 32000"):
        hdf5.unfiltered(b"", hdf5.Stored((1, 1, 1), np.dtype("u1"), (1, 1, 1), 0, [(32000, ())], b""), 0)
    assert hdf5.parse_filters(b"\x02\x02\x02\0\0\0\x01\0\x04\0\0\0\x01\0\0\0\x01\0\x06\0\0\0") == [(2, (4,)), (1, (6,))]


def test_hdf5_places_never_written(tmp_path):
    (tmp_path / "f").write_bytes(hdf5.write_hdf5({"a": np.ones((4, 2, 2), np.int16)}, (2, 2, 2)))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        file = hdf5.Hdf5(f)
        data = file.dataset("a")
        data.address, data.fill = hdf5.NOWHERE, b"\x07\0"
        assert (file.window(data, (1, 3), (0, 1)) == np.full((2, 1, 2), 7)).all()
