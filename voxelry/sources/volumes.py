"""Volume files: NIfTI-1, and flat integer files with a text of their sizes. HDF5 is in ``hdf5``."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: NIfTI-1 data type codes and their NumPy types: values of the format.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
VOXELS = "vol_id string, w int, h int, d int, x int, y int, z int, v double"


def parse_nifti(raw: bytes) -> np.ndarray:
    """The volume of a NIfTI-1 file as (x, y, z), scaled by its slope and intercept; ValueError if it is none."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < 352:
        raise ValueError("shorter than a header")
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:346] not in (b"n+", b"ni"):
        raise ValueError("not a NIfTI-1 file")
    n, *size = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    offset, slope, intercept = struct.unpack(order + "3f", raw[108:120])
    shape = tuple(size[:3]) if n >= 3 else (*size[:n], *([1] * (3 - n)))
    v = np.frombuffer(raw, np.dtype(NIFTI_TYPES[code]).newbyteorder(order), int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    return v * slope + intercept if slope and (slope, intercept) != (1.0, 0.0) else v


def write_nifti(v: np.ndarray) -> bytes:
    """A NIfTI-1 file of an unsigned byte or 4-byte float volume."""
    code = {"uint8": 2, "float32": 16}[str(v.dtype)]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *v.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, code, v.dtype.itemsize * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + v.tobytes(order="F")


def nifti_files(voxels: DataFrame) -> DataFrame:
    """(name, content) of each volume (v 0-255) as a NIfTI-1 file; a file is one task's group."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(tuple(int(pdf[c].iloc[0]) for c in ("w", "h", "d")), np.uint8)
        v[pdf["x"], pdf["y"], pdf["z"]] = pdf["v"]
        return pd.DataFrame({"name": [f"{pdf['vol_id'].iloc[0]}.nii"], "content": [write_nifti(v)]})

    return voxels.groupBy("vol_id").applyInPandas(encode, "name string, content binary")


def read_raw(spark: SparkSession, uri: str) -> DataFrame:
    """(vol_id string, n, values array<int>) of the files of ``write_raw``, in row-major order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(uri).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [np.frombuffer(c, "<i4") for c in frame["content"]]
            yield pd.DataFrame({"vol_id": [p.rsplit("/", 1)[-1][:-4] for p in frame["path"]], "n": [len(v) for v in values], "values": values})

    return files.mapInPandas(read, "vol_id string, n long, values array<int>")


def rows_of(v: np.ndarray, vol_id: str, planes: int = 16) -> Iterator[pd.DataFrame]:
    """A volume's voxels, some planes at a time."""
    w, h, d = v.shape
    for z in range(0, d, planes):
        part = v[:, :, z : z + planes]
        x, y, k = (a.ravel() for a in np.indices(part.shape, dtype=np.int32))
        yield pd.DataFrame({"vol_id": vol_id, "w": np.int32(w), "h": np.int32(h), "d": np.int32(d), "x": x, "y": y, "z": k + np.int32(z), "v": part.ravel().astype(float)})


def nifti(spark: SparkSession, folder: str, pattern: str = "*.nii*", lead: bool = True, strict: bool = False) -> DataFrame:
    """(VOXELS) of all files; with ``lead`` a volume whose last axis is shorter than its first is turned to begin with
    it. A file that does not parse is left out, or fails the job if ``strict``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    v = parse_nifti(content)
                except (ValueError, KeyError, OSError, EOFError):
                    if strict:
                        raise
                    continue
                if lead and v.shape[-1] < v.shape[0]:
                    v = v.transpose(2, 0, 1)
                yield from rows_of(v, path.rsplit("/", 1)[-1].split(".nii")[0])

    return files.mapInPandas(read, VOXELS)


def resolved(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The first file of each subject: by the order of the patterns (regular expressions), then by path."""
    rank = F.lit(len(patterns))
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("path").rlike(p), i).otherwise(rank)
    ranked = files.withColumn("rank", rank).filter(F.col("rank") < len(patterns))
    first = F.row_number().over(Window.partitionBy("subject").orderBy("rank", "path"))
    return ranked.withColumn("_n", first).filter("_n = 1").drop("_n")


def label_file(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str | None:
    """The first of the file names that is in the folder."""
    there = {r.path.rsplit("/", 1)[-1]: r.path for r in spark.read.format("binaryFile").load(folder).select("path").collect()}  # a folder's listing
    return next((there[n] for n in names if n in there), None)


def write_raw(field: DataFrame, uri: str) -> DataFrame:
    """Each volume's field as row-major little-endian int32 in ``<vol_id>.bin`` with sizes in ``<vol_id>.txt``; a row
    (vol_id, n) for each file written. A volume is one file, so one task's group."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        vol, (w, h, d) = pdf["vol_id"].iloc[0], (2 * int(pdf[c].iloc[0]) - 1 for c in ("w", "h", "d"))
        dense = np.zeros((w, h, d), "<i4")
        dense[pdf["ex"], pdf["ey"], pdf["ez"]] = pdf["u"]
        with store.open_output_stream(f"{root}/{vol}.bin") as out:
            out.write(dense.tobytes())
        with store.open_output_stream(f"{root}/{vol}.txt") as out:
            out.write(f"width = {w}\nheight = {h}\ndepth = {d}\ndtype = int32\norder = row-major\n".encode())
        return pd.DataFrame({"vol_id": [str(vol)], "n": [dense.size]})

    return field.groupBy("vol_id").applyInPandas(write, "vol_id string, n long")
