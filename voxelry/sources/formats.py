"""Volume files as data sources of Spark: NIfTI read by runs of planes, raw volumes written by ranges with a commit.

``register(spark)`` names them ``nifti_planes`` and ``raw_volume`` for ``spark.read.format`` and ``df.write.format``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxelry.sources.volumes import NIFTI_TYPES, VOXELS, parse_nifti

#: Bytes of planes that a partition reads, about.
PART_BYTES = 32 << 20


def register(spark: SparkSession) -> None:
    """Name the sources; filters are offered to them from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NiftiPlanes, RawVolume):
        spark.dataSource.register(source)


@dataclass
class Planes(InputPartition):
    """Of each file its planes from one to before another; all of it where that is None."""

    pieces: list[tuple[str, int, int | None]]


class PlaneReader(DataSourceReader):
    """Deals out files of volumes by runs of planes and takes bounds of z; ``ends`` says which files are meant."""

    ends: tuple[str, ...] = ()

    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes, self.low, self.high = path, part_bytes, 0, None

    def runs(self, f: pa.NativeFile) -> tuple[int, int, int]:
        """(bytes of a plane, planes, planes that are stored together) of an open file."""
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of z are taken; Spark applies all filters again, since a bound may fall within a partition."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = int(f.value) + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self) -> list[Planes]:
        """Large files by runs of planes, which takes their headers; small ones together."""
        store, root = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        parts, small, held = [], [], 0
        for info in sorted(files, key=lambda i: i.path):
            if not info.is_file or not info.path.endswith(self.ends):
                continue
            if info.path.endswith(".gz") or info.size <= self.part_bytes:
                if small and held + info.size > self.part_bytes:
                    parts.append(Planes(small))
                    small, held = [], 0
                small.append((info.path, 0, None))
                held += info.size
                continue
            with store.open_input_file(info.path) as f:
                plane, depth, run = self.runs(f)
            step, end = max(1, self.part_bytes // max(1, plane * run)) * run, depth if self.high is None else min(depth, self.high)
            parts += [Planes([(info.path, z, min(z + step, end))]) for z in range(self.low // run * run, end, step)]
        return [*parts, Planes(small)] if small else parts


@dataclass
class Header:
    """What a NIfTI-1 file says of its volume."""

    shape: tuple[int, int, int]
    kind: np.dtype
    offset: int
    slope: float
    intercept: float

    @classmethod
    def read(cls, raw: bytes) -> Header:
        if len(raw) < 348:
            raise ValueError("shorter than a header")
        order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
        if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:346] not in (b"n+", b"ni"):
            raise ValueError("not a NIfTI-1 file")
        n, *size = struct.unpack(order + "8h", raw[40:56])
        code, (offset, slope, intercept) = struct.unpack(order + "h", raw[70:72])[0], struct.unpack(order + "3f", raw[108:120])
        return cls((*size[: min(n, 3)], *([1] * (3 - n))), np.dtype(NIFTI_TYPES[code]).newbyteorder(order), int(offset), slope, intercept)

    @property
    def plane_bytes(self) -> int:
        return self.shape[0] * self.shape[1] * self.kind.itemsize

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return v * self.slope + self.intercept if self.slope and (self.slope, self.intercept) != (1.0, 0.0) else v


class NiftiPlanes(DataSource):
    """Voxels of NIfTI-1 files under ``path``; of files that are not compressed only the planes asked for by z are read.

    Options: ``path``, a file or folder of a store that pyarrow knows, and ``part_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "nifti_planes"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class NiftiReader(PlaneReader):
    ends = (".nii", ".nii.gz")

    def runs(self, f: pa.NativeFile) -> tuple[int, int, int]:
        head = Header.read(f.read(348))
        return head.plane_bytes, head.shape[2], 1

    def read(self, part: Planes) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for path, low, high in part.pieces:
            name = path.rsplit("/", 1)[-1].split(".nii")[0]
            with store.open_input_file(path) as f:
                if path.endswith(".gz"):
                    whole = parse_nifti(f.read())
                    shape, plane = whole.shape, lambda z, whole=whole: whole[:, :, z]
                else:
                    head = Header.read(f.read(348))
                    shape = head.shape
                    plane = lambda z, head=head, f=f: head.scaled(np.frombuffer(f.read_at(head.plane_bytes, head.offset + z * head.plane_bytes), head.kind).reshape(head.shape[:2], order="F"))
                w, h, d = shape
                x, y = (a.ravel().astype(np.int32) for a in np.indices((w, h)))
                for z in range(max(low, self.low), min(d, *(v for v in (high, self.high) if v is not None), d)):
                    full = {c: pa.array(np.full(w * h, v, np.int32)) for c, v in (("w", w), ("h", h), ("d", d), ("z", z))}
                    yield pa.record_batch({"vol_id": pa.array([name] * (w * h)), "w": full["w"], "h": full["h"], "d": full["d"], "x": x, "y": y, "z": full["z"], "v": plane(z).ravel().astype(float)})


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (temporary path, volume, first flat index, sizes)."""

    files: list[tuple[str, str, int, tuple[int, int, int]]]


class RawVolume(DataSource):
    """Fields (vol_id, w, h, d, ex, ey, ez, u) as little-endian int32 in row-major order: ``<vol_id>/<first flat index>.bin``, and the
    sizes in ``<vol_id>.txt``. Files stand under temporary names until all tasks are done; then the commit moves them."""

    @classmethod
    def name(cls) -> str:
        return "raw_volume"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        if overwrite:
            raise ValueError("raw volumes are written to a new folder: use mode append")
        return RawWriter(self.options["path"], int(self.options.get("file_values", 1 << 22)))


class RawWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Runs of neighbouring places, as they come, in files of at most ``most`` values."""
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(self.path)
        context, number, files = TaskContext.get(), count(), []
        folder = f"{root}/_tmp/{context.partitionId()}-{context.taskAttemptId()}"
        held: list[np.ndarray] = []
        now: tuple[str, int, tuple[int, int, int]] | None = None  # volume, first place and sizes of what is held

        def flush() -> None:
            if held:
                store.create_dir(folder, recursive=True)
                name = f"{folder}/{next(number)}.bin"
                with store.open_output_stream(name) as out:
                    out.write(np.concatenate(held).astype("<i4").tobytes())
                files.append((name, *now))
                held.clear()

        for batch in iterator:
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "h", "d")], axis=1) * 2 - 1
            ex, ey, ez, u = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ex", "ey", "ez", "u"))
            flat, vol = (ex * sizes[:, 1] + ey) * sizes[:, 2] + ez, batch.column("vol_id").cast(pa.string())
            code = vol.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.append(True, (np.diff(flat) != 1) | (np.diff(code) != 0))) if len(flat) else []
            for a, b in zip(first, [*first[1:], len(flat)], strict=True):
                own = (vol[int(a)].as_py(), int(flat[a]), tuple(sizes[a].tolist()))
                size = sum(map(len, held))
                if held and (own[0] != now[0] or own[1] != now[1] + size or size >= self.most):
                    flush()
                if not held:
                    now = own
                held.append(u[a:b])
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        texts = {}
        for message in messages:
            for name, vol, start, size in message.files if message else ():
                store.create_dir(f"{root}/{vol}", recursive=True)
                store.move(name, f"{root}/{vol}/{start:012d}.bin")
                texts[vol] = size
        for vol, (w, h, d) in texts.items():
            with store.open_output_stream(f"{root}/{vol}.txt") as out:
                out.write(f"width = {w}\nheight = {h}\ndepth = {d}\ndtype = int32\norder = row-major\n".encode())
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing stays of attempts that failed or were lost."""
        store, root = pafs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/_tmp").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/_tmp")


def write_raw_ranges(field: DataFrame, uri: str) -> None:
    """Write fields by ranges of (volume, place): no group is a volume."""
    register(field.sparkSession)
    cells = field.select(F.col("vol_id").cast("string").alias("vol_id"), *[F.col(c).cast("int").alias(c) for c in ("w", "h", "d", "ex", "ey", "ez", "u")])
    keys = ["vol_id", "ex", "ey", "ez"]  # row-major
    cells.repartitionByRange(*keys).sortWithinPartitions(*keys).write.format("raw_volume").mode("append").save(uri)


def read_raw_ranges(spark: SparkSession, uri: str) -> DataFrame:
    """(vol_id string, place long, u int) of the files of ``write_raw_ranges``, a file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(uri).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                vol, start = re.search(r"([^/]+)/(\d+)\.bin$", path).groups()
                u = np.frombuffer(content.as_buffer(), "<i4")
                yield pa.record_batch({"vol_id": pa.array([vol] * len(u)), "place": np.arange(int(start), int(start) + len(u)), "u": u.astype(np.int32)})

    return files.mapInArrow(read, "vol_id string, place long, u int")
