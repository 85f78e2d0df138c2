"""HDF5 volumes as a data source of Spark, read by runs of planes without the HDF5 library.

It reads what common writers make by default: superblocks 0 and 1, groups with symbol tables, integer or floating point
datasets that are contiguous, compact or chunked with a version 1 B-tree, through the deflate, shuffle and checksum filters.
Anything else is a ValueError that names it. ``register(spark)`` names the source ``hdf5_planes``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from voxelry.sources.formats import PART_BYTES, PlaneReader, Planes
from voxelry.sources.volumes import VOXELS

#: Values of the format: its signature, the address of nothing, message kinds, filter numbers.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x1, 0x3, 0x5, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Entries that a writer's B-tree node and symbol node have room for.
NODE, LEAF = 64, 8


@dataclass
class Stored:
    """Where a dataset's values are: at one address, in the header, or in chunks that a B-tree finds."""

    shape: tuple[int, ...]
    kind: np.dtype
    chunk: tuple[int, ...] | None
    address: int
    filters: list[tuple[int, tuple[int, ...]]]
    fill: bytes
    inline: bytes | None = None


class Hdf5:
    """Objects of an open file; every read is a byte range."""

    def __init__(self, f: pa.NativeFile):
        self.f = f
        head = f.read_at(104, 0)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        if head[8] not in (0, 1) or head[13:15] != b"\x08\x08":
            raise ValueError(f"superblock {head[8]} with addresses of {head[13]} bytes is not read")
        own = 24 if head[8] == 0 else 28
        self.base = struct.unpack_from("<Q", head, own)[0]
        self.root = struct.unpack_from("<Q", head, own + 40)[0]

    def at(self, address: int, n: int) -> bytes:
        raw = self.f.read_at(n, self.base + address)
        if len(raw) < n:
            raise ValueError("the file is cut off")
        return raw

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        version, left, size = struct.unpack("<BxH4xI", self.at(address, 12))
        if version != 1:
            raise ValueError("object headers of version 2 are not read")
        blocks = [(address + 16, size)]
        for start, length in blocks:
            raw, place = self.at(start, length), 0
            while left and place + 8 <= length:
                kind, size, flags = struct.unpack_from("<HHB", raw, place)
                body = raw[place + 8 : place + 8 + size]
                place, left = place + 8 + size, left - 1
                if kind == CONTINUED:
                    blocks.append(struct.unpack_from("<QQ", body))
                elif flags & 2 and kind in (DATASPACE, DATATYPE, FILL, FILTERS):
                    raise ValueError("shared header messages are not read")
                else:
                    yield kind, body

    def node(self, address: int, key: int) -> tuple[int, int, bytes]:
        """(level, entries, keys and children by turns) of a B-tree's node."""
        head = self.at(address, 24)
        if head[:4] != b"TREE":
            raise ValueError("no B-tree where one should be")
        n = struct.unpack_from("<H", head, 6)[0]
        return head[5], n, self.at(address + 24, n * (key + 8) + key)

    def members(self, address: int) -> Iterator[tuple[str, int]]:
        """Names and header addresses in a group."""
        found = next((body for kind, body in self.messages(address) if kind == SYMBOLS), None)
        if found is None:
            raise ValueError("not a group with a symbol table")
        tree, heap = struct.unpack_from("<QQ", found)
        size, _, segment = struct.unpack_from("<QQQ", self.at(heap, 32), 8)
        names, todo = self.at(segment, size), [tree]
        while todo:
            level, n, raw = self.node(todo.pop(), 8)
            children = [struct.unpack_from("<Q", raw, 16 * i + 8)[0] for i in range(n)]
            if level:
                todo += children
                continue
            for child in children:
                entries = struct.unpack_from("<H", self.at(child, 8), 6)[0]
                raw_entries = self.at(child + 8, 40 * entries)
                for i in range(entries):
                    name, header = struct.unpack_from("<QQ", raw_entries, 40 * i)
                    yield names[name : names.index(b"\0", name)].decode(), header

    def dataset(self, path: str) -> Stored:
        """The dataset of a path; ValueError if there is none or it is of a form that is not read."""
        address = self.root
        for name in path.strip("/").split("/"):
            address = dict(self.members(address)).get(name)
            if address is None:
                raise ValueError(f"no {name} of {path}")
        shape, kind, chunk, where, filters, fill, inline = None, None, None, None, [], b"", None
        for message, body in self.messages(address):
            if message == DATASPACE:
                shape = struct.unpack_from(f"<{body[1]}Q", body, 8 if body[0] == 1 else 4)
            elif message == DATATYPE:
                size, form = struct.unpack_from("<I", body, 4)[0], body[0] & 15
                if form > 1:
                    raise ValueError(f"values of class {form} are no numbers")
                kind = np.dtype((">" if body[1] & 1 else "<") + ("f" if form else "i" if body[1] & 8 else "u") + str(size))
            elif message == FILL:
                there, start = (bool(body[1] & 32), 2) if body[0] == 3 else (len(body) > 4 and bool(body[3]), 4)
                fill = body[start + 4 : start + 4 + struct.unpack_from("<I", body, start)[0]] if there else b""
            elif message == FILTERS:
                filters = parse_filters(body)
            elif message == LAYOUT:
                if body[0] != 3:
                    raise ValueError(f"layouts of version {body[0]} are not read")
                if body[1] == 0:
                    where, inline = 0, body[4 : 4 + struct.unpack_from("<H", body, 2)[0]]
                elif body[1] == 1:
                    where = struct.unpack_from("<Q", body, 2)[0]
                else:
                    where, chunk = struct.unpack_from("<Q", body, 3)[0], struct.unpack_from(f"<{body[2] - 1}I", body, 11)
        if shape is None or kind is None or where is None:
            raise ValueError(f"{path} is no dataset")
        return Stored(shape, kind, chunk, where, filters, fill, inline)

    def chunks(self, data: Stored, address: int, low: int, high: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, bytes, filters left out, address) of the chunks that hold planes from ``low`` to before ``high``."""
        rank = len(data.shape)
        key = 16 + 8 * rank
        level, n, raw = self.node(address, key)
        for i in range(n):
            place = i * (key + 8)
            size, skipped, *offsets = struct.unpack_from(f"<II{rank}Q", raw, place)
            child, _, following = struct.unpack_from("<QQQ", raw, place + key)
            if offsets[0] >= high:
                break
            if level and following + data.chunk[0] > low:
                yield from self.chunks(data, child, low, high)
            elif not level and offsets[0] + data.chunk[0] > low:
                yield tuple(offsets), size, skipped, child

    def window(self, data: Stored, z: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
        """Planes and rows of a (z, y, x) dataset; only the chunks or bytes that hold them are read."""
        _, h, w = data.shape
        box = (z, y, (0, w))
        if data.chunk is None and (data.inline is not None or data.address != NOWHERE):
            row = w * data.kind.itemsize
            take = (lambda start, n: data.inline[start : start + n]) if data.inline is not None else (lambda start, n: self.at(data.address + start, n))
            parts = [take((k * h + y[0]) * row, (y[1] - y[0]) * row) for k in range(*z)]
            return np.frombuffer(b"".join(parts), data.kind).reshape([b - a for a, b in box])
        out = np.full([b - a for a, b in box], np.frombuffer(data.fill, data.kind)[0] if data.fill else 0, data.kind)
        if data.address == NOWHERE:
            return out
        for offsets, size, skipped, address in self.chunks(data, data.address, *z):
            cut = [(max(a, o), min(b, o + c)) for (a, b), o, c in zip(box, offsets, data.chunk, strict=True)]
            if all(a < b for a, b in cut):
                values = np.frombuffer(unfiltered(self.at(address, size), data, skipped), data.kind).reshape(data.chunk)
                out[tuple(slice(a - s, b - s) for (a, b), (s, _) in zip(cut, box, strict=True))] = values[tuple(slice(a - o, b - o) for (a, b), o in zip(cut, offsets, strict=True))]
        return out


def parse_filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    """(number, values) of each filter, in the order of writing."""
    version, n = body[0], body[1]
    place, out = 8 if version == 1 else 2, []
    for _ in range(n):
        number = struct.unpack_from("<H", body, place)[0]
        named = version == 1 or number >= 256
        name = struct.unpack_from("<H", body, place + 2)[0] if named else 0
        place += 4 if named else 2
        many = struct.unpack_from("<H", body, place + 2)[0]
        place += 4 + (name + -name % 8 if version == 1 else name)
        out.append((number, struct.unpack_from(f"<{many}I", body, place)))
        place += 4 * (many + (many % 2 if version == 1 else 0))
    return out


def unfiltered(raw: bytes, data: Stored, skipped: int) -> bytes:
    for i, (number, values) in reversed(list(enumerate(data.filters))):
        if skipped >> i & 1:
            continue
        if number == DEFLATE:
            raw = zlib.decompress(raw)
        elif number == SHUFFLE:
            size = values[0] if values else data.kind.itemsize
            raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
        elif number == CHECKSUM:
            raw = raw[:-4]
        else:
            raise ValueError(f"filter {number} is not read")
    return raw


class Hdf5Planes(DataSource):
    """Voxels of (z, y, x) datasets in the HDF5 files under ``path``; only the chunks of the planes asked for by z are read.

    Options: ``path``; ``dataset``; ``value``, long or double (unsigned 64-bit numbers beyond a long wrap); ``labels``, a second dataset
    of the same shape that comes along as a column label, by place and without a join; ``part_bytes``. A file without the
    datasets, or with datasets of other than three axes, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5_planes"

    def schema(self) -> str:
        value = self.options.get("value", "double")
        if value not in ("long", "double"):
            raise ValueError("value must be long or double")
        return VOXELS.replace("v double", f"v {value}") + (", label long" if "labels" in self.options else "")

    def reader(self, schema) -> Hdf5Reader:
        o = self.options
        return Hdf5Reader(o["path"], int(o.get("part_bytes", PART_BYTES)), o.get("dataset", "/volumes/raw"), o.get("labels"), o.get("value", "double"))


class Hdf5Reader(PlaneReader):
    ends = (".h5", ".hdf", ".hdf5")

    def __init__(self, path: str, part_bytes: int, dataset: str, labels: str | None, value: str):
        super().__init__(path, part_bytes)
        self.datasets, self.value = [dataset, *([labels] if labels else [])], value

    def opened(self, f: pa.NativeFile) -> tuple[Hdf5, list[Stored]]:
        file = Hdf5(f)
        found = [file.dataset(d) for d in self.datasets]
        if len(found[0].shape) != 3 or any(d.shape != found[0].shape for d in found):
            raise ValueError("datasets must have three axes, and labels the volume's shape")
        return file, found

    def runs(self, f: pa.NativeFile) -> tuple[int, int, int]:
        _, found = self.opened(f)
        depth, h, w = found[0].shape
        return h * w * sum(d.kind.itemsize for d in found), depth, found[0].chunk[0] if found[0].chunk else 1

    def read(self, part: Planes) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        for path, low, high in part.pieces:
            name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with store.open_input_file(path) as f:
                file, found = self.opened(f)
                d, h, w = found[0].shape
                run, rows, _ = found[0].chunk or (1, h, w)
                end = min(d, *(v for v in (high, self.high) if v is not None), d)
                start = max(low, self.low)
                for z in range(start // run * run, end, run):
                    for y in range(0, h, rows):
                        zs, ys = (max(z, start), min(z + run, end)), (y, min(y + rows, h))
                        yield self.batch(name, (w, h, d), zs, ys, [file.window(one, zs, ys) for one in found])

    def batch(self, name: str, size: tuple[int, int, int], z: tuple[int, int], y: tuple[int, int], values: list[np.ndarray]) -> pa.RecordBatch:
        n = values[0].size
        full = {c: np.full(n, s, np.int32) for c, s in zip("whd", size, strict=True)}
        k, j, i = (a.ravel().astype(np.int32) for a in np.indices(values[0].shape, dtype=np.int32))
        long = lambda a: a.ravel().astype(np.uint64 if a.dtype.kind == "u" else np.int64).view(np.int64)
        v = long(values[0]) if self.value == "long" and values[0].dtype.kind != "f" else values[0].ravel().astype(np.int64 if self.value == "long" else float)
        more = {"label": long(values[1])} if len(values) > 1 else {}
        return pa.record_batch({"vol_id": pa.array([name] * n), **full, "x": i, "y": j + np.int32(y[0]), "z": k + np.int32(z[0]), "v": v, **more})


def register(spark: SparkSession) -> None:
    """Name the source; filters are offered to it from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5Planes)


def hdf5_labels(spark: SparkSession, uri: str, dataset: str = "/volumes/labels/neuron_ids") -> DataFrame:
    """(vol_id string, w, h, d, x, y, z, v long) of the label volumes in a file or folder."""
    register(spark)
    return spark.read.format("hdf5_planes").option("dataset", dataset).option("value", "long").load(uri)


def hdf5_pair(spark: SparkSession, uri: str, raw: str = "/volumes/raw", labels: str = "/volumes/labels/neuron_ids") -> DataFrame:
    """(VOXELS, label long) of gray volumes and their labels in the same file, by place."""
    register(spark)
    return spark.read.format("hdf5_planes").option("dataset", raw).option("labels", labels).load(uri)


def write_hdf5(datasets: dict[str, np.ndarray], chunk: tuple[int, ...] | None = None) -> bytes:
    """A file with a dataset for each path: contiguous, or in shuffled and deflated chunks. A group holds at most eight names."""
    out = bytearray(96)

    def put(raw: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(raw)
        return len(out) - len(raw)

    def header(messages: list[tuple[int, bytes]]) -> int:
        bodies = [struct.pack("<HHB3x", kind, len(body) + -len(body) % 8, 0) + body + bytes(-len(body) % 8) for kind, body in messages]
        return put(struct.pack("<BxHII4x", 1, len(bodies), 1, sum(map(len, bodies))) + b"".join(bodies))

    def node(kind: int, level: int, keys: list[bytes], children: list[int], room: int) -> int:
        body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children, strict=False)) + keys[-1]
        return put((b"TREE" + struct.pack("<BBHQQ", kind, level, len(children), NOWHERE, NOWHERE) + body).ljust(24 + room * 8 + (room + 1) * len(keys[0]), b"\0"))

    def values(v: np.ndarray) -> int:
        size, v = v.dtype.itemsize, np.ascontiguousarray(v, v.dtype.newbyteorder("<"))
        if v.dtype.kind == "f":
            exponent, mantissa = {4: (8, 23), 8: (11, 52)}[size]
            kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, (1 << exponent - 1) - 1)
        else:
            kind = struct.pack("<BBBBIHH", 0x10, 8 * (v.dtype.kind == "i"), 0, 0, size, 0, 8 * size)
        messages = [(DATASPACE, struct.pack(f"<BBB5x{v.ndim}Q", 1, v.ndim, 0, *v.shape)), (DATATYPE, kind), (FILL, struct.pack("<BBBBI", 2, 2, 0, 1, 0))]
        if chunk is None:
            return header([*messages, (LAYOUT, struct.pack("<BBQQ", 3, 1, put(v.tobytes()), v.nbytes))])
        entries = []
        for place in np.ndindex(*[-(-n // c) for n, c in zip(v.shape, chunk, strict=True)]):
            start = [p * c for p, c in zip(place, chunk, strict=True)]
            part = np.zeros(chunk, v.dtype)
            own = v[tuple(slice(s, s + c) for s, c in zip(start, chunk, strict=True))]
            part[tuple(map(slice, own.shape))] = own
            raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, size).T.tobytes())
            entries.append((struct.pack(f"<II{v.ndim + 1}Q", len(raw), 0, *start, 0), put(raw)))
        end, level = struct.pack(f"<II{v.ndim + 1}Q", 0, 0, *[s + c for s, c in zip(start, chunk, strict=True)], 0), 0
        while level == 0 or len(entries) > 1:
            runs = [entries[i : i + NODE] for i in range(0, len(entries), NODE)]
            after = [run[0][0] for run in runs[1:]] + [end]
            entries = [(run[0][0], node(1, level, [*[k for k, _ in run], right], [c for _, c in run], NODE)) for run, right in zip(runs, after, strict=True)]
            level += 1
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", SHUFFLE, 0, 0, 1, size, 0) + struct.pack("<HHHHII", DEFLATE, 0, 0, 1, 6, 0)
        return header([*messages, (LAYOUT, struct.pack(f"<BBBQ{v.ndim + 1}I", 3, 2, v.ndim + 1, entries[0][1], *chunk, size)), (FILTERS, filters)])

    def group(inside: dict) -> int:
        if len(inside) > LEAF:
            raise ValueError("a group holds at most eight names")
        names, symbols = bytearray(8), b""
        for name in sorted(inside):
            address = group(inside[name]) if isinstance(inside[name], dict) else values(inside[name])
            symbols += struct.pack("<QQ24x", len(names), address)
            last = len(names)
            names += name.encode() + bytes(8 - len(name.encode()) % 8)
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, put(bytes(names))))
        leaf = put((b"SNOD" + struct.pack("<BxH", 1, len(inside)) + symbols).ljust(8 + 40 * LEAF, b"\0"))
        return header([(SYMBOLS, struct.pack("<QQ", node(0, 0, [bytes(8), struct.pack("<Q", last)], [leaf], 32), heap))])

    tree: dict = {}
    for path, v in datasets.items():
        *folders, name = path.strip("/").split("/")
        at = tree
        for folder in folders:
            at = at.setdefault(folder, {})
        at[name] = v
    root = group(tree)
    out[:96] = SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, LEAF // 2, 16, 0, 0, NOWHERE, len(out), NOWHERE) + struct.pack("<QQ24x", 0, root)
    return bytes(out)


def hdf5_files(voxels: DataFrame, raw: str = "/volumes/raw", labels: str = "/volumes/labels/neuron_ids", chunk: tuple[int, int, int] = (3, 2, 4)) -> DataFrame:
    """(name, content) of each volume (v 0-255, label) as an HDF5 file; a file is one task's group."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(int(pdf[c].iloc[0]) for c in ("d", "h", "w"))
        gray, marks = np.zeros(shape, np.uint8), np.zeros(shape, np.uint64)
        at = tuple(pdf[c].to_numpy() for c in ("z", "y", "x"))
        gray[at], marks[at] = pdf["v"], pdf["label"]
        return pd.DataFrame({"name": [f"{pdf['vol_id'].iloc[0]}.hdf"], "content": [write_hdf5({raw: gray, labels: marks}, chunk)]})

    return voxels.withColumn("label", F.col("label").cast("long")).groupBy("vol_id").applyInPandas(encode, "name string, content binary")
