"""The well-composed field of gray volumes: a front that closes one level at a time.

The order of levels is a true recurrence within a volume, so each group (a volume, or a slab of one) is one task's work
on dense arrays; Spark deals out the groups, and a task takes many small ones at once from a stream of rows. A group must fit in a task: slabs (``decompose``) are the knob for volumes
that do not. Order within a level does not matter, so a level closes as a set of cells at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.functions.scalar import snap
from voxelry.operators.blocks import alike, by_runs, each_group
from voxelry.operators.interpolate import border_level
from voxelry.operators.lattice import CELL, VOLUME, colocated
from voxelry.sources.store import checkpointed, unsent

#: A whole volume's field, or some planes of it from ``first`` on: its cells plane by plane, of these x by x, of these y by y.
FIELD = "vol_id long, w int, h int, d int, first int, u array<int>"


def dense_span(v: np.ndarray, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest corner of each cell of a dense volume, one axis after the other; axes before ``begin`` number volumes."""
    low = high = v
    for axis in range(begin, v.ndim):
        n = v.shape[axis]
        shape = list(low.shape)
        shape[axis] = 2 * n - 1
        first, second = [slice(None)] * v.ndim, [slice(None)] * v.ndim
        first[axis], second[axis] = slice(0, n - 1), slice(1, n)
        even, odd = [slice(None)] * v.ndim, [slice(None)] * v.ndim
        even[axis], odd[axis] = slice(0, None, 2), slice(1, None, 2)
        new_low, new_high = np.empty(shape, v.dtype), np.empty(shape, v.dtype)
        new_low[tuple(even)], new_high[tuple(even)] = low, high
        new_low[tuple(odd)] = np.minimum(low[tuple(first)], low[tuple(second)])
        new_high[tuple(odd)] = np.maximum(high[tuple(first)], high[tuple(second)])
        low, high = new_low, new_high
    return low, high


@functools.lru_cache(maxsize=16)
def adjacent(shape: tuple[int, int, int]) -> list[list[int]]:
    """The up to six neighbours of each cell of a small grid, by flat index."""
    index = np.arange(int(np.prod(shape))).reshape(shape)
    near: list[list[int]] = [[] for _ in range(index.size)]
    for axis in range(3):
        a, b = (index.take(range(s, shape[axis] - 1 + s), axis).ravel().tolist() for s in (0, 1))
        for x, y in zip(a, b, strict=True):
            near[x].append(y)
            near[y].append(x)
    return near


def close_small(low: np.ndarray, high: np.ndarray, l_inf: int, seeds: np.ndarray | None, shape: tuple[int, int, int]) -> np.ndarray:
    """``close_levels`` cell by cell, over the padded grid."""
    pad = lambda a, v: np.pad(a.astype(np.int64), 1, constant_values=v).ravel().tolist()
    lo, hi, near = pad(low, l_inf), pad(high, l_inf), adjacent(shape)
    out, reached = [0] * len(lo), bytearray(len(lo))
    waiting: dict[int, list[int]] = {l_inf: [0]}
    reached[0] = 1
    for c, v in enumerate(pad(seeds, -1) if seeds is not None else ()):
        if v >= 0:
            reached[c] = 1
            waiting.setdefault(v, []).append(c)
    level = l_inf
    while waiting:
        if level not in waiting:
            level = min(waiting, key=lambda x: (abs(x - level), -x))
        stack = waiting.pop(level)
        while stack:
            c = stack.pop()
            out[c] = level
            for n in near[c]:
                if not reached[n]:
                    reached[n] = 1
                    at = lo[n] if level < lo[n] else hi[n] if level > hi[n] else level
                    if at == level:
                        stack.append(n)
                    else:
                        waiting.setdefault(at, []).append(n)
    return np.array(out).reshape(shape)


#: Cells of a grid that goes cell by cell, or many in step, as an array operation costs more than a level's few cells there.
SMALL = 4096


def close_levels(low: np.ndarray, high: np.ndarray, l_inf: int, seeds: np.ndarray | None = None, small: int = SMALL) -> np.ndarray:
    """The field over cells with intervals [low, high], entered from a border at ``l_inf``.

    A cell waits at the level of the front that first reaches it, snapped to its interval. The front closes all that
    waits at its level, then goes on to the nearest level at which cells wait, the upper of two. ``seeds`` (below 0:
    none) are cells that wait at given levels from the start. Grids of at most ``small`` cells go cell by cell, as an
    array operation costs more than a level's few cells there.
    """
    shape = tuple(n + 2 for n in low.shape)
    inner = tuple(slice(1, -1) for _ in shape)
    if low.size <= small:
        return close_small(low, high, l_inf, seeds, shape)[inner]
    lo, hi = np.full(shape, l_inf, np.int64), np.full(shape, l_inf, np.int64)
    lo[inner], hi[inner] = low, high
    lo, hi = lo.ravel(), hi.ravel()
    index = np.arange(lo.size).reshape(shape)
    reached = np.zeros(lo.size, bool)
    out = np.zeros(lo.size, np.int64)
    strides = [int(np.prod(shape[a + 1 :])) for a in range(3)]
    position = np.stack(np.unravel_index(np.arange(lo.size), shape))
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(cells: np.ndarray, level: np.ndarray) -> None:
        order = np.argsort(level, kind="stable")
        cells, level = cells[order], level[order]
        values, first = np.unique(level, return_index=True)
        for value, part in zip(values.tolist(), np.split(cells, first[1:]), strict=True):
            waiting.setdefault(value, []).append(part)

    start = np.array([index[0, 0, 0]])
    reached[start] = True
    wait(start, np.array([l_inf]))
    if seeds is not None:
        padded = np.full(shape, -1, np.int64)
        padded[inner] = seeds
        cells = np.flatnonzero(padded.ravel() >= 0)
        reached[cells] = True
        wait(cells, padded.ravel()[cells])
    level = l_inf
    while waiting:
        if level not in waiting:
            level = min(waiting, key=lambda x: (abs(x - level), -x))
        front = np.concatenate(waiting.pop(level))
        out[front] = level
        near = []
        for axis, stride in enumerate(strides):
            near += [front[position[axis, front] > 0] - stride, front[position[axis, front] < shape[axis] - 1] + stride]
        near = np.unique(np.concatenate(near))
        near = near[~reached[near]]
        if len(near):
            reached[near] = True
            wait(near, np.clip(level, lo[near], hi[near]))
    return out.reshape(shape)[inner]


def rim_of(shape: tuple[int, int, int]) -> np.ndarray:
    """Which cells of a grid have the border beside them."""
    rim = np.ones(shape, bool)
    rim[1:-1, 1:-1, 1:-1] = False
    return rim


def closed_in_step(low: np.ndarray, high: np.ndarray, volume: np.ndarray, at: np.ndarray, waits: np.ndarray, free: np.ndarray, l_inf: int) -> np.ndarray:
    """``close_levels`` for many grids of one size at once (grids x cells): grid i has the intervals [low, high] of ``volume[i]``,
    cells that wait from the start at levels ``at``, those at the rim among them, and free ones; others are no part of it.

    All grids go in step, each at its own level. A level's front meets no level from the start on its way, so those that are
    left lie above and below what was passed, and two places in their order are all that a grid looks at; cells met later
    are searched. A cell has its level once it is met, and a grid ends when no free cell is left.
    """
    many, shape = len(at), [n + 2 for n in at.shape[1:]]
    size, far_off = int(np.prod(shape)), np.iinfo(np.int64).max
    padded = lambda a: np.pad(a, ((0, 0), (1, 1), (1, 1), (1, 1)))
    lo, hi, open_ = padded(low).ravel(), padded(high).ravel(), padded(free)
    near_open = np.zeros_like(open_)
    for axis in (1, 2, 3):
        for step in (-1, 1):
            near_open |= np.roll(open_, step, axis)  # what comes round is the empty rim
    left = free.reshape(many, -1).sum(axis=1)
    start = padded(waits & (left > 0)[:, None, None, None])
    out, open_, near_open = padded(at).astype(np.int64).ravel(), open_.ravel(), near_open.ravel()
    ways = np.array([step * int(np.prod(shape[a + 1 :])) for a in range(3) for step in (-1, 1)])
    own = (volume - np.arange(many)) * size  # from a cell's place to that of its interval

    # cells that wait from the start, by grid and level
    cells = np.flatnonzero(start.ravel())
    base = min(int(out[cells].min(initial=l_inf)), l_inf)
    span = max(int(out[cells].max(initial=l_inf)), l_inf) - base + 1
    ordered = np.sort((cells // size * span + out[cells] - base) * size + cells % size)
    code, place = np.divmod(ordered, size)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    grid_of, levels = np.divmod(code[first], span)
    levels = np.append(levels + base, 0)
    cells = code // span * size + place
    pushes = near_open[cells]
    ends = np.append(0, np.cumsum(pushes))[np.append(first, len(cells))]
    cells = cells[pushes]
    lowest, highest = np.searchsorted(grid_of, np.arange(many)), np.searchsorted(grid_of, np.arange(many), "right")
    above = np.searchsorted(code[first], np.arange(many) * span + l_inf - base)
    below = above - 1

    level, least, once = np.full(many, l_inf, np.int64), np.full(many, far_off), np.empty(len(out), np.int64)
    waiting, waiting_in, waiting_at = (np.zeros(0, np.int64) for _ in range(3))
    going = np.flatnonzero(left)
    while len(going):
        now, up, down = level[going], above[going], below[going]
        to_up = np.where(up < highest[going], 2 * (levels[up] - now), far_off)
        to_down = np.where(down >= lowest[going], 2 * (now - levels[down]) + 1, far_off)  # of two as near the upper
        least[going] = np.minimum(to_up, to_down)
        far = waiting_at - level[waiting_in]
        far = 2 * np.abs(far) + (far < 0)
        np.minimum.at(least, waiting_in, far)
        best = least[going]
        if (best == far_off).any():
            raise ValueError("free cells that no front reaches")
        level[going] = now + np.where(best & 1, -(best >> 1), best >> 1)
        rise, fall = to_up == best, to_down == best
        above[going[rise]] += 1
        below[going[fall]] -= 1
        taken = np.concatenate([up[rise], down[fall]])
        n = ends[taken + 1] - ends[taken]
        hit = far == least[waiting_in]
        front = np.concatenate([cells[np.repeat(ends[taken + 1] - np.cumsum(n), n) + np.arange(n.sum())], waiting[hit]])
        later = []
        while len(front):
            near = (front[:, None] + ways).ravel()
            near = near[open_[near]]
            once[near] = np.arange(len(near))
            near = near[once[near] == np.arange(len(near))]
            open_[near] = False
            grid = near // size
            left -= np.bincount(grid, minlength=many)
            held = level[grid]
            out[near] = snapped = np.clip(held, lo[near + own[grid]], hi[near + own[grid]])
            same = snapped == held
            front = near[same]
            later.append((near[~same], grid[~same], snapped[~same]))
        stays = ~hit & (left[waiting_in] > 0)
        waiting, waiting_in, waiting_at = (np.concatenate([w[stays], *[x[i] for x in later]]) for i, w in enumerate((waiting, waiting_in, waiting_at)))
        going = going[left[going] > 0]
    return out.reshape(many, *shape)[:, 1:-1, 1:-1, 1:-1]


def sweep_levels(low: np.ndarray, high: np.ndarray, l_inf: int = 0, top: int = 255) -> np.ndarray:
    """The field by one sweep over rising levels from a border at ``l_inf``; -1 where the sweep does not come.

    At each level all cells join that have a cell of the field or the border beside them and whose interval snaps to the
    level, until none does. A cell whose interval the front has passed by stays open.
    """
    out = np.full(tuple(n + 2 for n in low.shape), l_inf, np.int64)
    inner = tuple(slice(1, -1) for _ in low.shape)
    out[inner] = -1
    for level in range(l_inf, top + 1):
        fits = np.clip(level, low, high) == level
        while (new := fits & (out[inner] < 0) & beside(out >= 0)).any():
            out[inner][new] = level
    return out[inner]


def beside(there: np.ndarray) -> np.ndarray:
    """Inner cells of a padded grid with a neighbour that is there."""
    out = np.zeros(tuple(n - 2 for n in there.shape), bool)
    for axis in range(there.ndim):
        for a, b in ((0, -2), (2, None)):
            out |= there[tuple(slice(a, b) if i == axis else slice(1, -1) for i in range(there.ndim))]
    return out


def gap_filled(field: DataFrame, rounds: int | None = 1, dealt: tuple[str, ...] = ()) -> DataFrame:
    """(CELL, lo, hi, u) with open cells (u null) filled from their neighbours: in each round, all at once, an open cell
    takes the neighbour's value snapped to its interval that moves least, the lesser of two. With ``rounds`` None it goes on
    until none changes. What stays open takes its interval's lower end.

    After the first round only cells filled in the last one have news, so a round scatters these alone, and groups them with the
    open cells. ``dealt``: what many small volumes are dealt out by (``colocated``); they stay so, and a round shuffles nothing.
    """
    sides = [s for s in product((-1, 0, 1), repeat=3) if sum(map(abs, s)) == 1]
    to = F.explode(F.array(*[F.struct(*[(F.col(e) + s).alias(e) for e, s in zip(("ex", "ey", "ez"), step, strict=True)], F.lit(i).alias("side")) for i, step in enumerate(sides)]))
    inside = reduce(lambda a, b: a & b, [F.col(e).between(0, 2 * F.col(n) - 2) for e, n in (("ex", "w"), ("ey", "h"), ("ez", "d"))])
    moved = [F.struct(F.abs(snap(F.col(f"n{i}"), F.col("lo"), F.col("hi")) - F.col(f"n{i}")).alias("by"), snap(F.col(f"n{i}"), F.col("lo"), F.col("hi")).alias("u")) for i in range(len(sides))]
    best = F.array_min(F.array(*[F.when(F.col(f"n{i}").isNotNull(), m) for i, m in enumerate(moved)]))
    nothing = F.lit(None).cast("int")
    filled, open_, done = field.filter("u is not null").select(*CELL, "lo", "hi", "u"), field.filter("u is null").select(*CELL, "lo", "hi"), 0
    fresh = filled
    while rounds is None or done < rounds:
        near = fresh.select(*VOLUME, "u", to.alias("_to")).select(*VOLUME, "_to.*", nothing.alias("lo"), nothing.alias("hi"), F.col("u").alias("near")).filter(inside)
        rows = near.unionByName(open_.select(*CELL, F.lit(-1).alias("side"), "lo", "hi", nothing.alias("near")))
        met = rows.groupBy(*CELL).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max(F.when(F.col("side") == i, F.col("near"))).alias(f"n{i}") for i in range(len(sides))])
        state = checkpointed(met.filter("lo is not null").select(*CELL, "lo", "hi", best.u.alias("u")), "filled", *dealt)
        fresh, open_ = state.filter("u is not null"), state.filter("u is null").drop("u")
        done += 1
        filled = filled.unionByName(fresh)
        if fresh.isEmpty():
            break
    return filled.unionByName(open_.withColumn("u", F.col("lo")))


def nearest_level(levels: DataFrame, at: int, keys: tuple[str, ...] = ("vol_id",)) -> DataFrame:
    """Per key the level nearest to ``at`` among the rows' v, the upper of two."""
    return levels.groupBy(*keys).agg(F.min_by("v", F.struct(F.abs(F.col("v") - at), -F.col("v"))).alias("level"))


def to_dense(rows: pd.DataFrame | dict[str, np.ndarray], names: tuple[str, str, str], value: str, shape: tuple[int, int, int], empty: int = 0) -> np.ndarray:
    out = np.full(shape, empty, np.int64)
    out[tuple(np.asarray(rows[n]) for n in names)] = rows[value]
    return out


def of_one_size(table: pa.Table, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers (vol_id) and levels (volumes x cells) of whole volumes, those of each size together."""
    c = {n: table.column(n).fill_null(-1).to_numpy() for n in (*VOLUME, "x", "y", "z", "v")}
    first = np.flatnonzero(np.diff(code, prepend=-1))
    for groups, at, volume, size in alike(code, first, np.stack([c[n][first] for n in ("w", "h", "d")], axis=1)):
        v = np.zeros((len(groups), *size), np.int32)
        v[volume, c["x"][at], c["y"][at], c["z"][at]] = c["v"][at]
        yield c["vol_id"][first[groups]], v


def field_table(parts: list[tuple[int, tuple[int, int, int], int, np.ndarray]], open_below_0: bool = False) -> pa.Table:
    """Rows (FIELD) of dense fields: each with its volume, that one's size, and the plane that it begins at."""
    u = np.concatenate([np.zeros(0, np.int32), *[np.moveaxis(f, 2, 0).ravel() for _, _, _, f in parts]]).astype(np.int32)
    ends = np.cumsum([0, *[f.size for _, _, _, f in parts]])
    size = {n: pa.array([s[i] for _, s, _, _ in parts], pa.int32()) for i, n in enumerate("whd")}
    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(u, mask=u < 0 if open_below_0 else None))
    return pa.table({"vol_id": pa.array([v for v, _, _, _ in parts], pa.int64()), **size, "first": pa.array([z for _, _, z, _ in parts], pa.int32()), "u": values})


def place(first: Column) -> list[Column]:
    """ex, ey and ez of the cell at _at in a row of FIELD."""
    nx, ny = 2 * F.col("w") - 1, 2 * F.col("h") - 1
    return [c.cast("int") for c in (F.floor(F.col("_at") / ny) % nx, F.col("_at") % ny, first + F.floor(F.col("_at") / (nx * ny)))]


def cells_of(packed: DataFrame, *more: str) -> DataFrame:
    """(CELL, u) of rows of FIELD, with further columns of these. What is to be shuffled is best shuffled before."""
    out = packed.select(*VOLUME, "first", *more, F.posexplode("u").alias("_at", "u"))
    return unsent(out.withColumns(dict(zip(("ex", "ey", "ez"), place(F.col("first")), strict=True))).select(*CELL, "u", *more))


def whole(packed: DataFrame) -> DataFrame:
    """(VOLUME, u) with all planes of small volumes in one row each, dealt out by volume."""
    parts = colocated(packed).groupBy(*VOLUME).agg(F.array_sort(F.collect_list(F.struct("first", "u"))).alias("_p"))
    return unsent(parts.select(*VOLUME, F.flatten(F.transform("_p", lambda p: p.u)).alias("u")))


def propagated(voxels: DataFrame, l_inf: str | int = "border_median", ascending: bool = False) -> DataFrame:
    """(CELL, u) of ``propagated_whole``."""
    return cells_of(propagated_whole(voxels, l_inf, ascending))


def propagated_whole(voxels: DataFrame, l_inf: str | int = "border_median", ascending: bool = False) -> DataFrame:
    """The well-composed field of each volume, in one row (FIELD); ``l_inf`` as in ``with_border_level``. With ``ascending`` one
    sweep over rising levels, u null where it does not come, for ``gap_filled`` to fill."""
    if l_inf == "border_median":
        rows = voxels.join(border_level(voxels).select("vol_id", F.rint("l_inf").cast("int").alias("l_inf")), "vol_id")
    else:
        rows = voxels.withColumn("l_inf", F.lit(0 if l_inf == "zero" else int(l_inf)))

    def close(table: pa.Table, code: np.ndarray) -> pa.Table:
        parts = []
        for g in each_group(table, code):
            size = tuple(int(g[c][0]) for c in ("w", "h", "d"))
            low, high = dense_span(to_dense(g, ("x", "y", "z"), "v", size))
            parts.append((int(g["vol_id"][0]), size, 0, (sweep_levels if ascending else close_levels)(low, high, int(g["l_inf"][0]))))
        return field_table(parts, ascending)

    return by_runs(rows.select(*VOLUME, "x", "y", "z", "v", "l_inf"), ["vol_id"], close, FIELD)


def ordered(field: DataFrame) -> DataFrame:
    """A total order of a volume's cells: by value, then row-major place; from 0.

    Cells are dealt out by ranges of (volume, value, place) and numbered within a range; what a range starts from is the sum
    over a volume's ranges before it, a row for each range and volume.
    """
    from pyspark.sql import Window

    flat = (F.col("ex").cast("long") * (2 * F.col("h") - 1) + F.col("ey")) * (2 * F.col("d") - 1) + F.col("ez")
    rows = field.withColumn("_flat", flat).repartitionByRange("vol_id", "u", "_flat").sortWithinPartitions("vol_id", "u", "_flat")
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranges")
    starts = rows.groupBy("vol_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("vol_id").orderBy("_part")) - F.col("_n")
    placed = rows.join(starts.select("vol_id", "_part", (before - F.col("_first")).alias("_base")), ["vol_id", "_part"])
    return placed.withColumn("f_ord", (F.col("_at") + F.col("_base")).cast("int")).select(*field.columns, "f_ord")
