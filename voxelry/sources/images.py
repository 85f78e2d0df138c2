"""Image files as masks and voxels, and PNG tiles out. Spark's image reader decodes PNG, GIF and JPEG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

VOXELS = "vol_id string, w int, h int, d int, x int, y int, z int, v int"


def listed(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.gif", "*.png"), most: int | None = None) -> DataFrame:
    """Files of the first pattern that has any, by name; ``most`` of them."""
    for p in patterns:
        found = spark.read.format("binaryFile").option("pathGlobFilter", p).load(folder).select("path").orderBy("path")
        if not found.isEmpty():
            return found if most is None else found.limit(most)
    return spark.createDataFrame([], "path string")


def gray_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(VOXELS) of gray levels 0-255; colours by luma (299, 587, 114 thousandths), files that do not decode left out.

    x runs along the height and y along the width, as rows and columns of the picture.
    """
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select("image.*")
    # many small files make a partition of every few, and a task costs more than they do
    files = files.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def gray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            height, width, channels, data, origin = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("height", "width", "nChannels", "data", "origin"))
            levels = [np.zeros(0, np.int16)]
            for n, raw in zip(channels, data, strict=True):
                p = np.frombuffer(raw, np.uint8)
                if n > 1:
                    p = p.reshape(-1, n).astype(np.int64)
                    p = (p[:, 2] * 299 + p[:, 1] * 587 + p[:, 0] * 114 + 500) // 1000
                levels.append(p.astype(np.int16))
            ends = np.cumsum([len(p) for p in levels]).astype(np.int32)
            name = [o.rsplit("/", 1)[-1].rsplit(".", 1)[0] for o in origin]
            yield pa.record_batch([pa.array(name, pa.string()), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(levels)))], names=["vol_id", "w", "h", "g"])

    at = F.col("_at")
    voxels = files.mapInArrow(gray, "vol_id string, w int, h int, g array<short>").select("vol_id", "w", "h", F.posexplode("g").alias("_at", "_v"))
    return voxels.select("vol_id", "w", "h", F.lit(1).alias("d"), F.expr("int(_at div h)").alias("x"), (at % F.col("h")).alias("y"), F.lit(0).alias("z"), F.col("_v").cast("int").alias("v"))


def masks(images: DataFrame, share: float = 0.5) -> DataFrame:
    """Binary voxels: gray / 255 above ``share``."""
    return images.withColumn("v", (F.col("v") / 255 > share).cast("int"))


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG of a 2-D array."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_files(rows: DataFrame, uri: str) -> DataFrame:
    """Write rows (name, content) as files under ``uri``; a row (name, n_bytes) for each."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": frame["name"], "n_bytes": frame["content"].map(len)})

    return rows.select("name", "content").mapInPandas(write, "name string, n_bytes long")


def tile_files(tiles: DataFrame, size: int) -> DataFrame:
    """(name, content) of each tile as PNG, from rows (vol_id, tx, ty, px, py, v); names count up with zeros in front."""

    @pandas_udf("binary")
    def encode(px: pd.Series, py: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(px, py, v, strict=True):
            g = np.zeros((size, size), np.uint8)
            g[np.asarray(a), np.asarray(b)] = np.asarray(c)
            out.append(png(g))
        return pd.Series(out)

    grouped = tiles.groupBy("vol_id", "tx", "ty").agg(F.collect_list(F.struct("px", "py", "v")).alias("t"))
    name = F.concat_ws("_", F.col("vol_id").cast("string"), F.lpad(F.col("tx").cast("string"), 4, "0"), F.lpad(F.col("ty").cast("string"), 4, "0"))
    return grouped.select(F.concat(name, F.lit(".png")).alias("name"), encode("t.px", "t.py", "t.v").alias("content"))
