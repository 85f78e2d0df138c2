"""Work on volumes cut in blocks: runs of whole groups in a stream, merge trees by block, and stars that join them.

No group is larger than a block, and many small groups are worked on at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.operators.lattice import colocated
from voxelry.sources.store import checkpointed

#: Cells along a block's edge, in space and in the plane.
EDGE, FLAT_EDGE = 64, 512
#: Bits of a coordinate in a point's number.
PLACE = 20


def half_steps(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of an adjacency's steps, one of each two opposite ones, by its number of neighbours."""
    flat, most = {4: (True, 1), 8: (True, 2), 6: (False, 1), 18: (False, 2), 26: (False, 3)}[connectivity]
    steps = [s for s in product((-1, 0, 1), repeat=3) if any(s) and sum(map(abs, s)) <= most and not (flat and s[2])]
    return [s for s in steps if s > (0, 0, 0)]


def by_runs(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, least: int = 200_000) -> DataFrame:
    """``work`` on tables of whole groups of ``keys``, as many groups at once as make ``least`` rows, and their groups' numbers.

    Rows are dealt out and sorted by the keys and streamed, so a task holds one call's rows alone.
    """

    def called(parts: list[pa.RecordBatch], last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        code = groups(table, keys)
        end = table.num_rows if last else int(np.searchsorted(code, code[-1]))
        rest = table.slice(end).to_batches() if end < table.num_rows else []
        return (work(table.slice(0, end), code[:end]) if end else None), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        due = least
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= due:
                out, held = called(held, False)
                due = least if out is not None else 2 * due  # one group so far: wait for twice as much
                if out is not None:
                    yield from out.to_batches()
        if held and sum(b.num_rows for b in held):
            yield from called(held, True)[0].to_batches()

    return colocated(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, rows being sorted by the keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    for key in keys:
        c = table.column(key).combine_chunks()
        if n > 1:
            a, b = c.slice(0, n - 1), c.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.cumsum(new)


def each_group(table: pa.Table, code: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group; a null is below 0."""
    columns = {n: pc.fill_null(table.column(n), -1).to_numpy() for n in table.column_names}
    cuts = np.flatnonzero(np.diff(code, prepend=-1, append=code[-1] + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield {n: c[a:b] for n, c in columns.items()}


def alike(code: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Groups that are alike in the columns of ``kinds``, which has a row for each place of ``first``, one in each group: these rows,
    the places of all of their groups, which of the groups each is in, and the kind."""
    values, kind = np.unique(kinds, axis=0, return_inverse=True)
    kind, of = kind.ravel(), np.full(int(code[-1]) + 1, -1)
    of[code[first]] = kind
    order = np.argsort(of[code], kind="stable")
    cuts = np.searchsorted(of[code][order], np.arange(len(values) + 1))
    for i, value in enumerate(values.tolist()):
        groups, at = np.flatnonzero(kind == i), order[cuts[i] : cuts[i + 1]]
        yield groups, at, np.searchsorted(code[first[groups]], code[at]), value


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots, each the least of its tree and pointed to by all of it, after edges (a, b)."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # pointers to their ends
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def beside(points: np.ndarray, code: np.ndarray, steps: list[tuple[int, int, int]]) -> Iterator[np.ndarray]:
    """For each step, the row of the point that lies it away from each of distinct lattice points (n x 3) in its group, or -1."""
    pad = np.array([int(any(s[i] for s in steps)) for i in range(3)])
    points = points - points.min(axis=0) + pad
    size = points.max(axis=0) + 1 + pad
    flat = ((code * size[0] + points[:, 0]) * size[1] + points[:, 1]) * size[2] + points[:, 2]
    away = [(s[0] * size[1] + s[1]) * size[2] + s[2] for s in steps]
    places = (int(code.max()) + 1) * int(np.prod(size))
    if places <= 16 * len(points) + 4096:  # looked up by place
        row = np.full(places, -1, np.int32)
        row[flat] = np.arange(len(points))
        for far in away:
            yield row[flat + far]
        return
    order = np.argsort(flat)
    ordered = flat[order]
    for far in away:
        at = np.minimum(np.searchsorted(ordered, flat + far), len(ordered) - 1)
        yield np.where(ordered[at] == flat + far, order[at], -1)


def near_pairs(points: np.ndarray, code: np.ndarray, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of distinct lattice points (n x 3) of one group that are a step apart."""
    a, b = [], []
    for near in beside(points, code, steps):
        a.append(np.flatnonzero(near >= 0))
        b.append(near[a[-1]].astype(np.int64))
    return np.concatenate(a), np.concatenate(b)


def merge_tree(points: np.ndarray, level: np.ndarray, code: np.ndarray, steps: list[tuple[int, int, int]], levels: int, edge: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins over falling levels: components of each of ``many`` groups at or above each level (groups x levels), and the joins
    between points that lie at a block's ``edge``, as rows (a, b, level) that keep just these points' connections."""
    n = len(points)
    a, b = near_pairs(points, code, steps)
    at = np.minimum(level[a], level[b])
    order = np.argsort(at.astype(np.int16) if levels < 1 << 15 else at, kind="stable")
    a, b, at = a[order], b[order], at[order]
    cut = np.searchsorted(at, np.arange(1, levels + 2))
    held = np.bincount(level, minlength=levels + 1)
    root, place, counts, joins = np.arange(n), np.arange(n), np.zeros((many, levels), np.int64), []
    agent = np.full(n, -1)  # an edge point of each root's tree
    rims = bool(edge.any())
    for k in range(levels, 0, -1):
        if not held[k]:  # no point and so no pair
            counts[:, k - 1] = counts[:, k] if k < levels else 0
            continue
        before = root
        root = united(root.copy(), a[cut[k - 1] : cut[k]], b[cut[k - 1] : cut[k]])
        if rims:
            fresh = np.flatnonzero((level == k) & edge)
            agent[fresh] = fresh
            old = np.flatnonzero((before == place) & (agent >= 0))  # trees with an edge point, before
            old = old[np.argsort(root[old], kind="stable")]
            same = np.flatnonzero(root[old][1:] == root[old][:-1])
            joins.append(np.stack([agent[old[same]], agent[old[same + 1]], np.full(len(same), k)]))
            agent[root[old]] = agent[old]
        counts[:, k - 1] = np.bincount(code[(root == place) & (level >= k)], minlength=many)
    return counts, np.concatenate(joins, axis=1).T if joins else np.zeros((0, 3), np.int64)


def part_sums(points: np.ndarray, level: np.ndarray, code: np.ndarray, levels: int, flat: bool, many: int) -> np.ndarray:
    """Vertices - edges + faces - cubes whose corners are all points of one group at or above each level (groups x levels)."""
    corners = [c for c in product((0, 1), repeat=3) if any(c) and not (flat and c[2])]
    known = np.append(level, 0)  # row -1: no point
    at = {(0, 0, 0): level} | {c: known[near] for c, near in zip(corners, beside(points, code, corners), strict=True)}
    total = np.zeros(many * (levels + 1), np.int64)
    for span in at:
        low = level
        for c in at:
            if any(c) and all(i <= j for i, j in zip(c, span, strict=True)):
                low = np.minimum(low, at[c])
        total += (1 - 2 * (sum(span) % 2)) * np.bincount(code * (levels + 1) + low, minlength=len(total))
    return np.cumsum(total.reshape(many, levels + 1)[:, :0:-1], axis=1)[:, ::-1]


def stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v) with v the least vertex that u reaches over the edges (keys, u, v), for all u but these; star contraction.

    In a large-star step each vertex's larger neighbours go to its smallest neighbour or itself, in a small-star step its
    smaller ones do; it goes on until a sum over the edges stays as it is.
    """
    turned = lambda e: e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, seen = checkpointed(turned(edges), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges
        seen = state
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        big = both.join(least, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = big.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = checkpointed(turned(small.unionByName(low.select(*keys, "u", F.col("m").alias("v")))), "edges")


def packed_points(rows: DataFrame, keys: list[str], names: tuple[str, str, str], levels: int, edge: int, mark: Column | None) -> DataFrame:
    """A row for each block of each key with its points at level 1 and above as numbers (``unpacked_points``), and whether ``mark``
    holds for all its points of any level. Small volumes that are dealt out by volume are packed where they are."""
    bits, own = (edge - 1).bit_length(), (levels + 1).bit_length()
    block = {f"_{n}": F.floor(F.col(n) / edge).cast("int") for n in names}
    number = reduce(lambda a, b: F.shiftleft(a, bits) + b, [F.col(n).cast("long") - F.col(f"_{n}") * edge for n in names])
    point = F.when(F.col("level") > 0, F.shiftleft(number, own) + F.col("level"))
    dealt = rows.withColumns(block).select(*keys, *block, point.alias("_p"), (F.lit(True) if mark is None else mark).alias("_m"))
    return dealt.groupBy(*keys, *block).agg(F.collect_list("_p").alias("_p"), F.bool_and("_m").alias("mark"))


def unpacked_points(number: np.ndarray, levels: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Places within a block (n x 3), and levels."""
    bits, own = (edge - 1).bit_length(), (levels + 1).bit_length()
    level, place = number & ((1 << own) - 1), number >> own
    return np.stack([place >> 2 * bits, place >> bits & ((1 << bits) - 1), place & ((1 << bits) - 1)], axis=1), level


def measured_by_level(rows: DataFrame, keys: list[str], levels: int, wanted: dict[str, int], names: tuple[str, str, str] = ("ex", "ey", "ez"), edge: int | None = None, flat: bool | None = None, mark: Column | None = None, least: int = 200_000) -> DataFrame:
    """(keys, level, mark, a column of counts for each connectivity of ``wanted``, chi unless ``flat`` is None): components and Euler
    numbers of the points at or above each level 1, 2, ... ``levels``; ``rows`` has keys, coordinates (0 to 2 ** 20 - 1) and
    level. Every key has a row for each level; ``mark``: a condition, and whether it holds for all of a key's rows.

    A block's points are packed in a row, and a task works on many small blocks at once. Each block makes its merge tree.
    Points at blocks' edges, the trees' joins between them, and pairs across edges are one small graph; how many of its
    pairs join components at a level, beyond the trees' own, is what the sum over blocks is too many by. Parts that lie
    across edges have all their corners at these points.
    """
    conns = list(wanted.values())
    edge = edge or (FLAT_EDGE if flat or (conns and all(c in (4, 8) for c in conns)) else EDGE)
    packed = packed_points(rows, keys, names, levels, edge, mark)
    kinds = {k: packed.schema[k].dataType.simpleString() for k in keys}
    numbers = ["conn", "kind", "level", "a", "b", "chi", *[f"n{i}" for i in range(len(conns))]]
    schema = ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", mark boolean, " + ", ".join(f"{c} long" for c in numbers)

    def work(table: pa.Table) -> pa.Table:
        many, points = table.num_rows, table.column("_p").combine_chunks()
        code = np.repeat(np.arange(many), points.value_lengths().to_numpy())
        place, level = unpacked_points(points.flatten().to_numpy(), levels, edge)
        start = np.stack([table.column(f"_{n}").to_numpy() for n in names], axis=1).astype(np.int64) * edge
        rim = ((place == edge - 1) | ((place == 0) & (start[code] > 0))).any(axis=1)
        parts = []

        def put(at: np.ndarray, kind: int, **columns: np.ndarray) -> None:
            own = table.select([*keys, "mark"]).take(pa.array(at))
            for c in numbers:
                own = own.append_column(c, pa.array(np.full(len(at), kind)) if c == "kind" else pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(len(at), pa.int64()))
            parts.append(own)

        counts = {}
        for i, conn in enumerate(conns):
            counts[f"n{i}"] = np.zeros((many, levels), np.int64)
            if len(code):
                counts[f"n{i}"], joins = merge_tree(place, level, code, half_steps(conn), levels, rim, many)
                put(code[joins[:, 0]], 2, conn=np.full(len(joins), i), level=joins[:, 2], a=numbered(place, start, code, joins[:, 0]), b=numbered(place, start, code, joins[:, 1]))
        if flat is not None:
            counts["chi"] = part_sums(place, level, code, levels, flat, many) if len(code) else np.zeros((many, levels), np.int64)
        put(np.repeat(np.arange(many), levels), 0, level=np.tile(np.arange(1, levels + 1), many), **{c: n.ravel() for c, n in counts.items()})
        at = np.flatnonzero(rim)
        put(code[at], 1, level=level[at], a=numbered(place, start, code, at))
        return pa.concat_tables(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = np.cumsum(batch.column(batch.schema.get_field_index("_p")).value_lengths().to_numpy()) // least
            cuts = np.flatnonzero(np.diff(held, prepend=-1, append=-1)) if batch.num_rows else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from work(table.slice(a, b - a)).to_batches()

    found = checkpointed(packed.mapInArrow(run, schema), "merge-trees")
    by = [*keys, "level"]
    names_of = {f"n{i}": name for i, name in enumerate(wanted)} | ({} if flat is None else {"chi": "chi"})
    every = found.filter("kind = 0").select(*by, "mark", *names_of)
    if not found.filter("kind = 1").isEmpty():
        nothing = {c: F.lit(0).cast("long") for c in names_of} | {"mark": F.lit(True)}
        add = lambda part, name, n: part.withColumns(nothing | {name: n}).select(*every.columns)
        coordinate = [F.floor(F.col("a") / (1 << 2 * PLACE)), F.floor(F.col("a") / (1 << PLACE)) % (1 << PLACE), F.col("a") % (1 << PLACE)]
        point = found.filter("kind = 1").select(*by, "a", *[c.cast("long").alias(f"p{i}") for i, c in enumerate(coordinate)])
        if flat is not None:
            every = every.unionByName(add(across_parts(point, keys, levels, flat, edge), "chi", F.col("_n")))
        steps = [F.struct(F.lit(i).cast("long").alias("conn"), *[(F.col(f"p{j}") + s[j]).alias(f"q{j}") for j in range(3)]) for i, c in enumerate(conns) for s in half_steps(c)]
        if steps:
            across = lambda t: (t["q0"] >= 0) & (t["q1"] >= 0) & (t["q2"] >= 0) & ~((F.floor(t["q0"] / edge) == F.floor(F.col("p0") / edge)) & (F.floor(t["q1"] / edge) == F.floor(F.col("p1") / edge)) & (F.floor(t["q2"] / edge) == F.floor(F.col("p2") / edge)))
            to = point.withColumn("t", F.explode(F.filter(F.array(*steps), across))).select(*by, "t.conn", F.col("a").alias("u"), point_number(F.col("t.q0"), F.col("t.q1"), F.col("t.q2")).alias("v"))
            there = point.select(*keys, F.col("level").alias("there"), F.col("a").alias("v"))
            pairs = to.join(there, [*keys, "v"]).select(*keys, "conn", F.least("level", "there").alias("top"), "u", "v")
            own = found.filter("kind = 2").select(*keys, "conn", F.col("level").alias("top"), F.col("a").alias("u"), F.col("b").alias("v"))
            at_each = lambda e: e.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))))
            joined = stars(at_each(pairs.unionByName(own)).select(*by, "conn", "u", "v"), [*by, "conn"])
            more = joined.groupBy(*by, "conn").agg((-F.count("*")).alias("_n")).unionByName(at_each(own).groupBy(*by, "conn").agg(F.count("*").alias("_n")))
            for i in range(len(conns)):
                every = every.unionByName(add(more.filter(F.col("conn") == i), f"n{i}", F.col("_n")))
    return every.groupBy(*by).agg(F.bool_and("mark").alias("mark"), *[F.sum(c).alias(name) for c, name in names_of.items()]).withColumn("level", F.col("level").cast("int"))


def numbered(place: np.ndarray, start: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``point_number`` of rows of points whose places count from their block's start."""
    p = place[at] + start[code[at]]
    return (p[:, 0] * (1 << PLACE) + p[:, 1]) * (1 << PLACE) + p[:, 2]


def across_parts(point: DataFrame, keys: list[str], levels: int, flat: bool, edge: int) -> DataFrame:
    """(keys, level, _n): edges, faces and cubes that lie in more than one block, with their signs, from points (p0, p1, p2) at edges."""
    spans = [s for s in product((0, 1), repeat=3) if any(s) and not (flat and s[2])]
    corners = [(s, c) for s in spans for c in product((0, 1), repeat=3) if all(i <= j for i, j in zip(c, s, strict=True))]
    to = F.array(*[F.struct(*[F.lit(s[i]).alias(f"s{i}") for i in range(3)], *[(F.col(f"p{i}") - c[i]).alias(f"o{i}") for i in range(3)]) for s, c in corners])
    crosses = lambda t: reduce(lambda a, b: a | b, [F.floor((t[f"o{i}"] + t[f"s{i}"]) / edge) != F.floor(t[f"o{i}"] / edge) for i in range(3)])
    rows = point.select(*keys, "level", F.explode(F.filter(to, lambda t: crosses(t) & (F.least(t["o0"], t["o1"], t["o2"]) >= 0))).alias("t")).select(*keys, "level", "t.*")
    dim = F.col("s0") + F.col("s1") + F.col("s2")
    whole = rows.groupBy(*keys, "s0", "s1", "s2", "o0", "o1", "o2").agg(F.count("*").alias("corners"), F.min("level").alias("low")).filter(F.col("corners") == F.pow(F.lit(2), dim))
    sums = whole.groupBy(*keys, "low").agg(F.sum(F.when(dim % 2 == 0, 1).otherwise(-1)).alias("_n"))
    return sums.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("low")))).select(*keys, "level", "_n")


def point_number(x: Column, y: Column, z: Column) -> Column:
    return (x.cast("long") * (1 << PLACE) + y) * (1 << PLACE) + z


def components_by_level(rows: DataFrame, keys: list[str], levels: int, wanted: dict[str, int], names: tuple[str, str, str] = ("ex", "ey", "ez"), edge: int | None = None) -> DataFrame:
    """(keys, level, a column of counts for each connectivity of ``wanted``) of ``measured_by_level``, levels without points left out."""
    found = measured_by_level(rows.filter("level > 0"), keys, levels, wanted, names, edge)
    return found.filter(reduce(lambda a, b: a | b, [F.col(name) > 0 for name in wanted])).drop("mark")
