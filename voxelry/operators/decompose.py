"""Slabs along z, and rounds that inject the assembled field at their boundaries until it no longer changes.

A slab with its halo is the unit of parallel work: (vol_id, k) is the group, so one volume spreads over many tasks. A
round brings each slab's voxels together with the planes of the assembled field that pin it. The round's field is
written to the shared checkpoint folder before the next one reads it; the driver sees one row of sums a round.

Volumes that are small and many go through all their rounds in one task, which takes many of them from a stream and closes
all their slabs, of every setting, in step (``swept``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.blocks import alike, by_runs
from voxelry.operators.lattice import CELL, VOLUME
from voxelry.operators.propagate import FIELD, SMALL, cells_of, close_levels, closed_in_step, dense_span, field_table, of_one_size, rim_of, whole
from voxelry.operators.verify import boundary_violations, well_composed, whole_checked
from voxelry.sources.store import checkpointed, unsent

#: Whole fields at which rounds end: halo and number of slabs, the planes that slabs end at, the round, by how much it changed the
#: field at most, and a bit for each tolerance for which it was the last.
SWEPT = FIELD + ", k int, delta int, bounds array<int>, rounds int, change int, ends long"

#: What slabs of one shape and place have in common.
SLAB = ("w", "h", "d", "k", "n", "z0", "z1", "z0e", "z1e")


def slabs(voxels: DataFrame, k: int, delta: int = 1, ahead: int = 0) -> DataFrame:
    """(vol_id, k, z0, z1, z0e, z1e): at most ``k`` runs of planes, the first ones a plane longer where d does not
    divide, each with ``delta`` planes of halo, and ``ahead`` more above."""
    if k < 1 or delta < 0 or ahead < 0:
        raise ValueError("k must be 1 at least, and delta and ahead must not be negative")
    sizes = voxels.select("vol_id", "d").distinct()
    many = F.least(F.lit(k), F.col("d"))
    out = sizes.withColumn("n", many).withColumn("k", F.explode(F.sequence(F.lit(0), many - 1)))
    base, more = F.floor(F.col("d") / F.col("n")).cast("int"), F.col("d") % F.col("n")
    z0 = F.col("k") * base + F.least("k", more)
    out = out.withColumn("z0", z0).withColumn("z1", z0 + base + (F.col("k") < more).cast("int"))
    return out.select("vol_id", "k", "n", "z0", "z1", F.greatest(F.col("z0") - delta, F.lit(0)).alias("z0e"), F.least(F.col("z1") + delta + ahead, F.col("d")).alias("z1e"))


def with_halo(voxels: DataFrame, parts: DataFrame) -> DataFrame:
    """Each voxel once for every slab whose halo holds it; a slab's rows are small and few, and keyed by volume."""
    return voxels.join(parts, "vol_id").filter((F.col("z") >= F.col("z0e")) & (F.col("z") < F.col("z1e")))


def bounds_of(parts: DataFrame) -> DataFrame:
    """(vol_id, zb): where one slab ends and the next begins."""
    return parts.filter("k < n - 1").select("vol_id", F.col("z1").alias("zb"))


def closed_slabs(table: pa.Table, code: np.ndarray, l_inf: int, shift: int = 0) -> pa.Table:
    """The planes that each slab (a group) owns, a row (FIELD) each: from twice its first plane to just before twice its end; the last
    slab all. Rows with a level u above -1 are cells (x, y, z) of the doubled grid that pin it. Small slabs close in step.

    With ``shift`` a bound's first planes belong to the slab before it: 1 for the plane of the bound itself, so that it
    and the one below come from one slab, 2 for the plane above too.
    """
    c = {n: table.column(n).fill_null(-1).to_numpy() for n in table.column_names}
    pinned, parts = c["u"] >= 0, []
    first = np.flatnonzero(~pinned)
    first = first[np.diff(code[first], prepend=-1) != 0]
    for groups, at, slab, (w, h, d, k, n, z0, z1, z0e, z1e) in alike(code, first, np.stack([c[n][first] for n in SLAB], axis=1)):
        begin = 2 * z0 + shift if k else 0
        end = min(2 * z1 + shift, 2 * d - 1) if k < n - 1 else 2 * d - 1
        if end > 2 * z1e - 1:
            raise ValueError("the halo above must hold the planes that a slab owns beyond its own")
        v = np.zeros((len(groups), w, h, z1e - z0e), np.int32)
        rows, pins = ((slab[some], *(c[x][at[some]] for x in ("x", "y", "z"))) for some in (~pinned[at], pinned[at]))
        v[(*rows[:3], rows[3] - z0e)] = c["v"][at[~pinned[at]]]
        low, high = dense_span(v, 1)
        seeds = np.full(low.shape, -1, np.int32)
        seeds[(*pins[:3], pins[3] - 2 * z0e)] = c["u"][at[pinned[at]]]
        if low[0].size <= SMALL:
            waits = seeds >= 0
            level = np.where(waits, seeds, np.clip(l_inf, low, high))
            waits |= rim_of(low.shape[1:])
            u = closed_in_step(low, high, np.arange(len(groups)), level, waits, ~waits, l_inf)
        else:
            low, high = np.where(seeds < 0, low, seeds), np.where(seeds < 0, high, seeds)
            u = [close_levels(a, b, l_inf, seed if (seed >= 0).any() else None) for a, b, seed in zip(low, high, seeds, strict=True)]
        parts += [(int(i), (w, h, d), begin, f[:, :, begin - 2 * z0e : end - 2 * z0e]) for i, f in zip(c["vol_id"][first[groups]], u, strict=True)]
    return field_table(parts)


def slab_fields(voxels: DataFrame, parts: DataFrame, pins: DataFrame | None, l_inf: int, shift: int) -> DataFrame:
    """The fields of all slabs (FIELD), many small ones of a task at once; pins come as further rows of their slab."""
    rows = with_halo(voxels, parts).select(*VOLUME, "x", "y", "z", "v", "k", "n", "z0", "z1", "z0e", "z1e", F.lit(None).cast("int").alias("u"))
    if pins is not None:
        rows = rows.unionByName(pins.select("vol_id", "k", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"), F.col("u").cast("int").alias("u")), allowMissingColumns=True)
    return by_runs(rows, ["vol_id", "k"], lambda table, code: closed_slabs(table, code, l_inf, shift), FIELD)


def round_zero(voxels: DataFrame, parts: DataFrame, l_inf: int = 0, shift: int = 0) -> DataFrame:
    """Every slab by itself. Its halo above must hold the planes that it owns: one plane, or two where ``shift`` is 2, which
    ``slabs`` gives by ``delta`` or ``ahead``; else it is an error."""
    return cells_of(slab_fields(voxels, parts, None, l_inf, shift))


def pins_of(field: DataFrame, parts: DataFrame, one_plane: bool = False) -> DataFrame:
    """Planes of the assembled field (FIELD) that pin each slab: its halo and first plane below (with ``one_plane`` the latter
    alone), its halo above. Rows meet slabs before they become cells, those alone that have planes of theirs."""
    k, n, z1, z1e, begin = F.col("k"), F.col("n"), F.col("z1"), F.col("z1e"), F.col("z0" if one_plane else "z0e")
    ez, first = F.col("ez"), F.col("first")
    end = first + F.size("u") / ((2 * F.col("w") - 1) * (2 * F.col("h") - 1))
    near = ((k > 0) & (first < 2 * F.col("z0") + 1) & (end > 2 * begin)) | ((k < n - 1) & (first < 2 * z1e) & (end > 2 * z1))
    left = (k > 0) & (ez >= 2 * begin) & (ez < 2 * F.col("z0") + 1)
    right = (k < n - 1) & (ez >= 2 * z1) & (ez < 2 * z1e) & (ez <= 2 * z1e - 2)
    columns = ["k", "n", "z0", "z1", "z0e", "z1e"]
    return cells_of(field.join(parts, "vol_id").filter(near), *columns).filter(left | right).select("vol_id", "k", "ex", "ey", "ez", "u")


def pinned_spans(cells: DataFrame, planes: DataFrame) -> DataFrame:
    """Cells (CELL, lo, hi) with planes (vol_id, ex, ey, ez, u) of an assembled field joined in: where u is there the
    interval is u alone and seed is u; other cells, and those whose u is null, keep their interval and have no seed.

    ``fronts.propagated_in_blocks`` starts from the seeds."""
    pins = planes.filter("u is not null").select("vol_id", "ex", "ey", "ez", F.col("u").cast("int").alias("seed"))
    both = cells.join(pins, ["vol_id", "ex", "ey", "ez"], "left")
    return both.withColumns({"lo": F.coalesce("seed", "lo"), "hi": F.coalesce("seed", "hi")}).select(*CELL, "lo", "hi", "seed")


def step_by_delta(voxels: DataFrame, k: int, deltas: list[int], l_inf: int = 0, small: bool = False) -> DataFrame:
    """(vol_id, delta, n_cells, n_violations, bdry_violations) of slabs by themselves, by halo: the bound's plane comes from the slab
    below it, which reads one plane more than its halo. ``small`` as in ``checked``."""
    voxels = checkpointed(voxels, "voxels")
    rows = []
    for delta in deltas:
        parts = checkpointed(slabs(voxels, k, delta, 1), "slabs")
        field = checkpointed(slab_fields(voxels, parts, None, l_inf, 1), "round-0")
        rows.append(checked(field, bounds_of(parts), small).drop("n_blocks").withColumn("delta", F.lit(delta)))
    return reduce(DataFrame.unionByName, rows)


def cuts_of(d: int, k: int) -> list[int]:
    """Where the slabs of ``slabs`` begin and the last one ends."""
    n = min(k, d)
    return [i * (d // n) + min(i, d % n) for i in range(n + 1)]


def rounds_in_step(v: np.ndarray, settings: list[tuple[int, int, list[float]]], l_inf: int, max_rounds: int, shift: int, one_plane: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rounds of ``injected`` over volumes of one size (volumes x cells) for each (k, delta, tolerances): a setting's place, the round, which
    volumes' rounds end with it for some tolerance, the round's greatest change of each, a bit for each tolerance, and fields.

    A slab none of whose pins changed would come out as it did, and is left as it is; so is one whose planes are all pinned.
    """
    low, high = dense_span(v, 1)
    many, d, top = len(v), v.shape[3], low.shape[3]
    border = np.clip(l_inf, low, high)
    parts, windows = [], {}
    for s, (k, delta, _) in enumerate(settings):
        cuts = cuts_of(d, k)
        n = len(cuts) - 1
        for i, (z0, z1) in enumerate(pairwise(cuts)):
            begin, end = max(z0 - delta, 0), min(z1 + delta, d)
            window, own = (2 * begin, 2 * end - 1), (2 * z0 + shift if i else 0, min(2 * z1 + shift, top) if i < n - 1 else top)
            if own[1] > window[1]:
                raise ValueError("the halo above must hold the planes that a slab owns beyond its own")
            left = range(2 * (z0 if one_plane else begin), 2 * z0 + 1) if i else ()
            right = range(2 * z1, 2 * end - 1) if i < n - 1 else ()
            windows.setdefault(window, []).append((s, own))
            parts.append((s, window, own, [*left, *right]))

    def close(which: list[tuple[np.ndarray, tuple[int, int], list[int], np.ndarray | None]]) -> list[np.ndarray]:
        """The planes of windows of some volumes, with pinned planes from a field."""
        at, waits, free = [], [], []
        for volumes, (begin, end), pins, field in which:
            known, inside = np.zeros((2, *low.shape[1:]), bool)
            known[..., begin:end] = rim_of((*low.shape[1:3], end - begin))
            known[..., pins] = inside[..., begin:end] = True
            level = border[volumes]
            if pins:
                level[..., pins] = field[volumes][..., pins]
            at.append(level)
            for out, kind in ((waits, known), (free, inside & ~known)):
                out.append(np.broadcast_to(kind, level.shape))
        volume = np.concatenate([w[0] for w in which])
        u = closed_in_step(low, high, volume, *map(np.concatenate, (at, waits, free)), l_inf)
        return np.split(u, np.cumsum([len(w[0]) for w in which])[:-1])

    every = np.arange(many)
    fields = [np.zeros(low.shape, np.int64) for _ in settings]
    for (window, users), u in zip(windows.items(), close([(every, w, [], None) for w in windows]), strict=True):
        for s, own in users:
            fields[s][..., slice(*own)] = u[..., slice(*own)]
    moved = [np.ones((many, top), bool) for _ in settings]
    open_ = [np.ones((many, len(eps)), bool) for _, _, eps in settings]
    for rounds in range(1, max_rounds + 1):
        todo = []
        for s, window, own, pins in parts:
            volumes = np.flatnonzero(open_[s].any(axis=1) & moved[s][:, pins].any(axis=1))
            if len(volumes) and not set(range(*own)) <= set(pins):
                todo.append((s, own, (volumes, window, pins, fields[s])))
        closed = close([work for _, _, work in todo]) if todo else []
        change = np.zeros((len(settings), many), np.int64)
        moved = [np.zeros((many, top), bool) for _ in settings]
        for (s, own, (volumes, *_)), u in zip(todo, closed, strict=True):
            new = u[..., slice(*own)]
            by = np.abs(new - fields[s][volumes][..., slice(*own)]).max(axis=(1, 2))
            moved[s][volumes, slice(*own)] = by > 0
            change[s, volumes] = np.maximum(change[s, volumes], by.max(axis=1))
            fields[s][volumes, :, :, slice(*own)] = new
        for s, (_, _, eps) in enumerate(settings):
            ends = open_[s] & ((change[s][:, None] < np.array(eps)) | (rounds == max_rounds))
            open_[s] &= ~ends
            volumes = np.flatnonzero(ends.any(axis=1))
            if len(volumes):
                yield s, rounds, volumes, change[s, volumes], (ends[volumes] << np.arange(len(eps))).sum(axis=1), fields[s][volumes]


def swept(voxels: DataFrame, settings: list[tuple[int, int, list[float]]], l_inf: int = 0, max_rounds: int = 8, shift: int = 0, one_plane: bool = False) -> DataFrame:
    """(SWEPT) of the rounds of ``injected`` over small volumes for each number of slabs, halo and list of tolerances, from one pass:
    a row for each volume, setting and round that is the last for some of its tolerances."""
    for k, delta, eps in settings:
        if shift > 2 * delta - 1:
            raise ValueError("a halo must hold the planes that its slab owns beyond the bound")
        if k < 1 or delta < 1 or max_rounds < 1 or not 0 < len(eps) < 63:
            raise ValueError("rounds need a slab, a halo of one plane at least, and a tolerance, of 62 at most; there must be a round")

    def close(table: pa.Table, code: np.ndarray) -> pa.Table:
        out = []
        for vol_id, v in of_one_size(table, code):
            size = v.shape[1:]
            for s, rounds, at, change, ends, u in rounds_in_step(v, settings, l_inf, max_rounds, shift, one_plane):
                k, delta, _ = settings[s]
                rows = field_table([(int(i), size, 0, f) for i, f in zip(vol_id[at], u, strict=True)])
                for name, values in (("k", [k] * len(at)), ("delta", [delta] * len(at)), ("bounds", [cuts_of(size[2], k)[1:-1]] * len(at)), ("rounds", [rounds] * len(at)), ("change", change), ("ends", ends)):
                    rows = rows.append_column(name, pa.array(values, {"bounds": pa.list_(pa.int32()), "ends": pa.int64()}.get(name, pa.int32())))
                out.append(rows)
        return pa.concat_tables(out)

    return unsent(by_runs(voxels.select(*VOLUME, "x", "y", "z", "v"), ["vol_id"], close, SWEPT, 50_000))


def inject_each(voxels: DataFrame, k: int, delta: int = 1, l_inf: int = 0, max_rounds: int = 8, eps: float = 0.5, shift: int = 0, one_plane: bool = False, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(CELL, u) and the rounds of ``injected``."""
    field, took = injected(voxels, k, delta, l_inf, max_rounds, eps, shift, one_plane, small)
    return cells_of(field), took


def injected(voxels: DataFrame, k: int, delta: int = 1, l_inf: int = 0, max_rounds: int = 8, eps: float = 0.5, shift: int = 0, one_plane: bool = False, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """Boundary-injection rounds from slabs by themselves; returns the field, a row (FIELD) for each slab, and how many rounds
    each volume took (vol_id, rounds, converged).

    A round recomputes each slab with its pinned planes. It is a volume's last if none of the volume's cells changed by
    ``eps`` or more; the others go on without it. ``shift`` and ``one_plane`` are those of ``closed_slabs`` and ``pins_of``.
    With ``small`` all rounds of a volume are in one task (``swept``), and its field is in one row.
    """
    if small:
        found = checkpointed(swept(voxels, [(k, delta, [eps])], l_inf, max_rounds, shift, one_plane), "rounds")
        return unsent(found.select(*VOLUME, "first", "u")), unsent(found.select("vol_id", "rounds", (F.col("change") < eps).alias("converged")))
    if shift > 2 * delta - 1:
        raise ValueError("a halo must hold the planes that its slab owns beyond the bound")
    if delta < 1 or max_rounds < 1:
        raise ValueError("rounds need a halo of one plane at least, and there must be one")
    voxels = checkpointed(voxels, "voxels")
    parts = checkpointed(slabs(voxels, k, delta), "slabs")
    field = checkpointed(slab_fields(voxels, parts, None, l_inf, shift), "round-0")
    done, took = [], []
    for rounds in range(1, max_rounds + 1):
        new = checkpointed(slab_fields(voxels, parts, pins_of(field, parts, one_plane), l_inf, shift), f"round-{rounds}")
        both = new.join(field.select("vol_id", "first", F.col("u").alias("before")), ["vol_id", "first"])
        both = both.select("vol_id", "before", F.posexplode("u").alias("_at", "u"))
        moved = both.groupBy("vol_id").agg(F.max(F.abs(F.col("u") - F.col("before")[F.col("_at")])).alias("change"))
        moved = checkpointed(moved.select("vol_id", (F.col("change") >= eps).alias("goes_on")), f"moved-{rounds}")
        field = new
        if rounds == max_rounds or not moved.filter("goes_on").limit(1).count():
            break
        ended, on = moved.filter("not goes_on"), moved.filter("goes_on")
        done.append(new.join(ended, "vol_id", "left_semi"))
        took.append(ended.select("vol_id", F.lit(rounds).alias("rounds"), F.lit(True).alias("converged")))
        parts = checkpointed(parts.join(on, "vol_id", "left_semi"), f"slabs-{rounds}")
    took.append(moved.select("vol_id", F.lit(rounds).alias("rounds"), (~F.col("goes_on")).alias("converged")))
    if done:
        field = checkpointed(reduce(DataFrame.unionByName, [*done, field]), "field")
    return field, unsent(reduce(DataFrame.unionByName, took))


def inject(voxels: DataFrame, k: int, delta: int = 1, l_inf: int = 0, max_rounds: int = 8, eps: float = 0.5) -> tuple[DataFrame, int]:
    """The field of ``inject_each`` and how many rounds ran, those of the slowest volume."""
    field, took = inject_each(voxels, k, delta, l_inf, max_rounds, eps)
    return field, took.agg(F.max("rounds")).first()[0] or 1


def checked(field: DataFrame, bounds: DataFrame, small: bool = False) -> DataFrame:
    """Per volume n_cells, n_blocks, n_violations and bdry_violations of a field (FIELD). With ``small`` volumes are put together
    in a row each, and corners looked up there; else their cells are scattered to blocks."""
    if small:
        return whole_checked(whole(field), bounds)
    cells = cells_of(field)
    blocks = unsent(well_composed(cells).select("vol_id", "n_blocks", "n_violations"))
    both = unsent(cells.groupBy("vol_id").agg(F.count("*").alias("n_cells"))).join(blocks, "vol_id")
    return both.join(unsent(boundary_violations(cells, bounds)), "vol_id", "left").na.fill(0, ["bdry_violations"])


def plane_width(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Per volume the median and maximum over slab bounds of the widest interval on the bound's plane."""
    at = bounds_of(parts).select("vol_id", (2 * F.col("zb")).alias("ez"))
    widest = spans.join(at, ["vol_id", "ez"]).groupBy("vol_id", "ez").agg(F.max(F.col("hi") - F.col("lo")).alias("width"))
    return widest.groupBy("vol_id").agg(F.median("width").alias("plane_width_med"), F.max("width").cast("double").alias("plane_width_max"))
