"""The gray front over volumes cut in blocks: the very field of ``propagate.propagated``, no task holding more than its blocks.

The front closes one level of a whole volume at a time, so blocks go in step. They stay in their tasks' memory in a barrier
stage: each step, a task closes what waits at the volume's level in its blocks, and tells all others, as a bit for each cell
of a block's face that closed, what its neighbours must know, and which levels nearest to the present one wait in its
blocks. A volume stays at its level while faces have news; then it goes to the nearest level at which cells wait anywhere,
the upper of two. A message is as long as the faces with news, compressed; levels are two numbers for each volume.

Volumes of at most ``TOGETHER`` cells have all their blocks in one task, which needs no stage of that kind: it takes many of
them from a stream and closes the blocks of all in step, each volume at its own level (``closed_together``).

The tasks of the stage run at once, so there must be a core for each; a lost executor starts the stage anew. They find each
other by the barrier's gathering and then talk through the first task, as that gathering takes a second each time.
"""

from __future__ import annotations

import base64
import json
import secrets
import zlib
from collections.abc import Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.blocks import by_runs
from voxelry.operators.interpolate import border_level
from voxelry.operators.lattice import VOLUME, colocated
from voxelry.operators.propagate import FIELD as PACKED
from voxelry.operators.propagate import cells_of, dense_span, field_table, to_dense
from voxelry.sources.store import checkpointed

#: Cells along a block's edge; even.
EDGE = 64
#: Cells of a volume whose blocks are all in one task.
TOGETHER = EDGE**3
FIELD = "vol_id long, w int, h int, d int, ex int, ey int, ez int, u int"
BLOCK = "vol_id long, w int, h int, d int, bx int, by int, bz int, l_inf int, low binary, high binary, seeds binary"
#: The six faces: axis, and whether it is the upper one.
FACES = [(axis, up) for axis in range(3) for up in (False, True)]


def block_spans(voxels: DataFrame, edge: int, seeds: DataFrame | None = None) -> DataFrame:
    """A row for each block of cells of volumes with a column l_inf: the cells' intervals, and seeds (CELL, u) or -1."""
    half = edge // 2
    axes = (("bx", "x", "w"), ("by", "y", "h"), ("bz", "z", "d"))
    rows = voxels.select(*VOLUME, "x", "y", "z", "v", "l_inf", F.lit(-1).alias("ez"), F.lit(None).cast("int").alias("u"))
    for b, c, _ in axes:  # a voxel at a block's first cell is also the upper end of the one before
        own = F.floor(F.col(c) / half).cast("int")
        rows = rows.withColumn(b, F.explode(F.when((F.col(c) % half == 0) & (F.col(c) > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    if seeds is not None:
        level = voxels.select("vol_id", "l_inf").distinct()
        pins = seeds.filter("u is not null").join(level, "vol_id").select(*VOLUME, F.col("ex").alias("x"), F.col("ey").alias("y"), F.lit(0).alias("z"), F.lit(0).alias("v"), "l_inf", "ez", F.col("u").cast("int").alias("u"), *[F.floor(F.col(e) / edge).cast("int").alias(b) for b, e in (("bx", "ex"), ("by", "ey"), ("bz", "ez"))])
        rows = rows.unionByName(pins)

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        pins, pdf = pdf[pdf["u"].notna()], pdf[pdf["u"].isna()]
        first = pdf.iloc[0]
        at = {b: int(first[b]) for b in ("bx", "by", "bz")}
        start = [at[b] * half for b, _, _ in axes]
        shape = tuple(min(half + 1, int(first[n]) - s) for s, (_, _, n) in zip(start, axes, strict=True))
        local = pdf.assign(**{c: pdf[c] - s for s, (_, c, _) in zip(start, axes, strict=True)})
        low, high = (a[:edge, :edge, :edge] for a in dense_span(to_dense(local, ("x", "y", "z"), "v", shape)))
        seed = np.full(low.shape, -1, np.int32)
        if len(pins):
            seed[tuple((pins[c] - edge * at[b]).to_numpy() for c, b in (("x", "bx"), ("y", "by"), ("ez", "bz")))] = pins["u"].to_numpy()
        pack = lambda a: np.ascontiguousarray(a, np.int32).tobytes()
        return pd.DataFrame([{**{c: int(first[c]) for c in VOLUME}, **at, "l_inf": int(first["l_inf"]), "low": pack(low), "high": pack(high), "seeds": pack(seed) if len(pins) else None}])

    return colocated(rows, "vol_id", "bx", "by", "bz").groupBy("vol_id", "bx", "by", "bz").applyInPandas(spans, BLOCK)


class Block:
    """A block's cells with a bucket of waiting cells for each level."""

    def __init__(self, row: dict, edge: int):
        self.at = (row["bx"], row["by"], row["bz"])
        whole = [2 * row[n] - 1 for n in ("w", "h", "d")]
        self.start = [edge * b for b in self.at]
        self.shape = tuple(min(edge, n - s) for n, s in zip(whole, self.start, strict=True))
        self.low, self.high = (np.frombuffer(row[c], np.int32) for c in ("low", "high"))
        self.out = np.zeros(len(self.low), np.int32)
        self.reached = np.zeros(len(self.low), bool)
        self.index = np.arange(len(self.low), dtype=np.int32).reshape(self.shape)
        self.strides = (self.shape[1] * self.shape[2], self.shape[2], 1)
        self.waiting: dict[int, list[np.ndarray]] = {}
        if row["seeds"] is not None:
            seeds = np.frombuffer(row["seeds"], np.int32)
            there = np.flatnonzero(seeds >= 0)
            self.low, self.high = self.low.copy(), self.high.copy()
            self.low[there] = self.high[there] = seeds[there]
            self.wait(there, seeds[there])
        for axis in range(3):  # the border beyond the volume is closed
            for up, rim in ((False, self.start[axis] == 0), (True, self.start[axis] + self.shape[axis] == whole[axis])):
                if rim:
                    self.reach(self.face(axis, up), row["l_inf"])

    def face(self, axis: int, up: bool) -> np.ndarray:
        return self.index.take(self.shape[axis] - 1 if up else 0, axis).ravel()

    def wait(self, cells: np.ndarray, level: np.ndarray) -> None:
        self.reached[cells] = True
        order = np.argsort(level, kind="stable")
        cells, level = cells[order], level[order]
        cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1)) if len(cells) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.waiting.setdefault(int(level[a]), []).append(cells[a:b])

    def reach(self, cells: np.ndarray, level: int) -> None:
        """Cells that the front at ``level`` meets wait at that level snapped to their interval."""
        cells = cells[~self.reached[cells]]
        self.wait(cells, np.clip(level, self.low[cells], self.high[cells]))

    def close(self, level: int) -> dict[int, np.ndarray]:
        """Close all that waits at the level; for each face with cells that closed now, which ones."""
        closed = []
        while level in self.waiting:
            front = np.concatenate(self.waiting.pop(level))
            self.out[front] = level
            closed.append(front)
            near = []
            for axis, stride in enumerate(self.strides):
                place = front // stride % self.shape[axis]
                near += [front[place > 0] - stride, front[place < self.shape[axis] - 1] + stride]
            near = np.unique(np.concatenate(near))
            self.reach(near, level)
        news = {}
        if closed:
            cells = np.concatenate(closed)
            for f, (axis, up) in enumerate(FACES):
                place = cells // self.strides[axis] % self.shape[axis]
                hit = cells[place == (self.shape[axis] - 1 if up else 0)]
                if len(hit):
                    bits = np.zeros(len(self.low), bool)
                    bits[hit] = True
                    news[f] = bits[self.face(axis, up)]
        return news


def nearest(levels: list[int], to: int) -> int | None:
    """The level nearest to another, the upper of two."""
    return min(levels, key=lambda x: (abs(x - to), -x), default=None)


class Circle:
    """All tasks of a barrier stage: each says something, all hear everything."""

    def __init__(self):
        from pyspark import BarrierTaskContext

        tasks = BarrierTaskContext.get()
        infos = tasks.getTaskInfos()
        self.first = tasks.partitionId() == 0
        if self.first:
            host, key = infos[0].address.rsplit(":", 1)[0], secrets.token_hex(32)
            listener = Listener((host, 0), backlog=len(infos), authkey=key.encode())
            tasks.allGather(json.dumps([*listener.address, key]))
            self.ways: list[Connection] = [listener.accept() for _ in infos[1:]]
            listener.close()
        else:
            host, port, key = json.loads(next(x for x in tasks.allGather("") if x))
            self.ways = [Client((host, port), authkey=key.encode())]

    def heard(self, said: bytes) -> list[bytes]:
        if self.first:
            every = [said, *[way.recv() for way in self.ways]]
            for way in self.ways:
                way.send(every)
            return every
        self.ways[0].send(said)
        return self.ways[0].recv()

    def close(self) -> None:
        for way in self.ways:
            way.close()


def closed_blocks(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    """A task's work: its blocks close in step with those of all other tasks."""
    circle = Circle()
    sizes: dict[int, list[int]] = {}
    blocks: dict[int, dict[tuple[int, int, int], Block]] = {}
    level: dict[int, int] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            vol = row["vol_id"]
            blocks.setdefault(vol, {})
            sizes[vol], level[vol] = [row[c] for c in ("w", "h", "d")], row["l_inf"]
            b = Block(row, edge)
            blocks[vol][b.at] = b
    going = set(blocks)
    goes_on = True
    while goes_on:
        news, near = [], {}
        for vol in going:
            waits: set[int] = set()
            for at, block in blocks[vol].items():
                for f, bits in block.close(level[vol]).items():
                    axis, up = FACES[f]
                    to = tuple(p + (1 if up else -1) * (i == axis) for i, p in enumerate(at))
                    if to[axis] >= 0 and to[axis] * edge < 2 * sizes[vol][axis] - 1:
                        news.append([vol, to, f ^ 1, base64.b64encode(np.packbits(bits).tobytes()).decode()])
                waits |= block.waiting.keys()
            now = level[vol]
            if waits:
                near[vol] = [x for x in (max((x for x in waits if x < now), default=None), min((x for x in waits if x > now), default=None)) if x is not None]
        said = zlib.compress(json.dumps([news, list(near.items())]).encode(), 1)
        told = [json.loads(zlib.decompress(x)) for x in circle.heard(said)]
        stays, waits_at = set(), {}
        for others, levels in told:
            for vol, to, f, bits in others:
                stays.add(vol)
                block = blocks.get(vol, {}).get(tuple(to))
                if block is not None:
                    face = block.face(*FACES[f])
                    there = np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8), count=len(face)).astype(bool)
                    block.reach(face[there], level[vol])
            for vol, found in levels:
                waits_at.setdefault(vol, []).extend(found)
        goes_on = bool(stays or waits_at)
        for vol in list(going):
            if vol not in stays:
                if vol not in waits_at:
                    going.discard(vol)
                else:
                    level[vol] = nearest(waits_at[vol], level[vol])
    circle.close()
    for vol, own in blocks.items():
        for at in list(own):
            block = own.pop(at)
            n = len(block.out)
            places = [(a.ravel() + s).astype(np.int32) for a, s in zip(np.indices(block.shape, dtype=np.int32), block.start, strict=True)]
            columns = [pa.array(np.full(n, vol, np.int64)), *[pa.array(np.full(n, s, np.int32)) for s in sizes[vol]], *map(pa.array, places), pa.array(block.out)]
            yield pa.record_batch(columns, names=["vol_id", "w", "h", "d", "ex", "ey", "ez", "u"])


def closed_together(low: np.ndarray, high: np.ndarray, l_inf: np.ndarray, seeds: np.ndarray, edge: int) -> np.ndarray:
    """The fields of volumes of one size (volumes x cells), cut in blocks, from cells' intervals, borders' levels and seeds or -1.

    All volumes go in step, each at its own level: blocks close what waits at it by themselves, then cells beside the faces
    with news are reached, until no face has any; then a volume goes to its nearest level at which cells wait.
    """
    n, *shape = low.shape
    size = [s + 2 for s in shape]
    many, inner = int(np.prod(size)), (slice(None), *[slice(1, -1)] * 3)
    lo, hi, at = (np.zeros((n, *size), np.int32) for _ in range(3))
    lo[inner], hi[inner], at[inner] = np.where(seeds < 0, low, seeds), np.where(seeds < 0, high, seeds), seeds
    reached, rim = np.ones((n, *size), bool), np.zeros((n, *size), bool)
    reached[inner], rim[inner] = seeds >= 0, True
    rim[:, 2:-2, 2:-2, 2:-2] = False
    lo, hi, at, reached, vol = lo.ravel(), hi.ravel(), at.ravel(), reached.ravel(), np.repeat(np.arange(n, dtype=np.int32), many)
    ways = []  # to each side: how far, and whether that is in the same block
    for axis, place in enumerate(np.indices(size)):
        stride = int(np.prod(size[axis + 1 :]))
        ways += [(step * stride, np.tile(((place - 1) // edge == (place - 1 + step) // edge).ravel(), n)) for step in (-1, 1)]
    level, once, later = l_inf.astype(np.int32), np.empty(n * many, np.int32), []

    def reach(cells: np.ndarray) -> np.ndarray:
        """Of the cells met those that close at once; the others wait at their volume's level snapped to their interval."""
        cells = cells[~reached[cells]]
        once[cells] = np.arange(len(cells))
        cells = cells[once[cells] == np.arange(len(cells))]
        reached[cells] = True
        now = level[vol[cells]]
        at[cells] = snapped = np.clip(now, lo[cells], hi[cells])
        later.append(cells[snapped != now])
        return cells[snapped == now]

    waiting = np.zeros(0, np.int64)
    pins = np.zeros((n, *size), bool)
    pins[inner] = seeds >= 0
    later.append(np.flatnonzero(pins))
    front = reach(np.flatnonzero(rim))
    while True:
        while len(front):
            news = []
            while len(front):
                own = []
                for step, same in ways:
                    here = same[front]
                    own.append(front[here] + step)
                    news.append(front[~here] + step)
                front = reach(np.concatenate(own))
            front = reach(np.concatenate(news))
        waiting = np.concatenate([waiting, *later])
        later.clear()
        if not len(waiting):
            return at.reshape(n, *size)[inner]
        far = at[waiting].astype(np.int64) - level[vol[waiting]]
        far = 2 * np.abs(far) + (far < 0)  # of two as near the upper
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, vol[waiting], far)
        hit = far == least[vol[waiting]]
        front, waiting = waiting[hit], waiting[~hit]
        level[vol[front]] = at[front]


def small_fields(voxels: DataFrame, edge: int, seeds: DataFrame | None = None) -> DataFrame:
    """The fields, a row each (``propagate.FIELD``), of volumes with a column l_inf whose blocks are all in one task."""
    rows = voxels.select(*VOLUME, "x", "y", "z", "v", "l_inf", F.lit(None).cast("int").alias("u"))
    if seeds is not None:
        pins = seeds.filter("u is not null").select(*VOLUME, F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"), F.lit(0).alias("v"), F.lit(0).alias("l_inf"), F.col("u").cast("int").alias("u"))
        rows = rows.unionByName(pins)

    def close(table: pa.Table, code: np.ndarray) -> pa.Table:
        c = {n: table.column(n).fill_null(-1).to_numpy() for n in table.column_names}
        first = np.flatnonzero(np.diff(code, prepend=-1))
        sizes, kind = np.unique(np.stack([c[n][first] for n in ("w", "h", "d")], axis=1), axis=0, return_inverse=True)
        kind, there, parts = kind.ravel(), np.bincount(code[c["u"] < 0], minlength=len(first)) > 0, []
        for i, size in enumerate(sizes.tolist()):
            vols = np.flatnonzero((kind == i) & there)  # seeds of a volume without voxels are left out
            mine = np.flatnonzero(np.isin(code, vols))
            number, pinned = np.searchsorted(vols, code[mine]), c["u"][mine] >= 0
            at = lambda rows, number: (number, c["x"][rows], c["y"][rows], c["z"][rows])
            v, l_inf = np.zeros((len(vols), *size), np.int32), np.zeros(len(vols), np.int32)
            v[at(mine[~pinned], number[~pinned])] = c["v"][mine[~pinned]]
            l_inf[number[~pinned]] = c["l_inf"][mine[~pinned]]
            low, high = dense_span(v, 1)
            seed = np.full(low.shape, -1, np.int32)
            seed[at(mine[pinned], number[pinned])] = c["u"][mine[pinned]]
            u = closed_together(low, high, l_inf, seed, edge)
            parts += [(int(k), tuple(size), 0, f) for k, f in zip(c["vol_id"][first[vols]], u, strict=True)]
        return field_table(parts)

    return by_runs(rows, ["vol_id"], close, PACKED, 50_000)


def propagated_in_blocks(voxels: DataFrame, l_inf: str | int = "border_median", edge: int = EDGE, seeds: DataFrame | None = None, tasks: int | None = None, together: int = TOGETHER) -> DataFrame:
    """The field (CELL, u) of each volume as by ``propagated``, in blocks of ``edge`` cells each way; ``seeds`` (CELL, u; u null:
    none) are cells whose interval is one level and that wait at it from the start. ``tasks``: how many run at once, all
    cores by default, for volumes of more than ``together`` cells; the blocks of others are all in one task."""
    if edge % 2 or edge < 2:
        raise ValueError("a block's edge must be even")
    cells = (2 * F.col("w").cast("long") - 1) * (2 * F.col("h") - 1) * (2 * F.col("d") - 1)
    if l_inf == "border_median":
        rows = voxels.join(border_level(voxels).select("vol_id", F.rint("l_inf").cast("int").alias("l_inf")), "vol_id")
    else:
        rows = voxels.withColumn("l_inf", F.lit(0 if l_inf == "zero" else int(l_inf)))
    of = lambda df, some: None if df is None else df.filter(some)
    small = cells_of(small_fields(of(rows, cells <= together), edge, of(seeds, cells <= together)))
    if voxels.filter(cells > together).isEmpty():
        return small
    spans = block_spans(of(rows, cells > together), edge, of(seeds, cells > together))
    tasks = tasks or voxels.sparkSession.sparkContext.defaultParallelism
    front = checkpointed(spans.repartition(tasks).mapInArrow(lambda batches: closed_blocks(batches, edge), FIELD, barrier=True), "front")
    return front.unionByName(small)
