"""Every operator as a query over the given tables, with SQL of an independent form where SQL can express it.

The SQL builds each cell from a generated lattice and reads its neighbours by joins; the queries scatter and aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.functions import scalar
from voxelry.operators import decompose, fronts, interpolate, labels, propagate, stats, topology, verify
from voxelry.operators.lattice import CELL, VOLUME
from voxelry.plans import experiments
from voxelry.sources import raster
from voxelry.sources import volumes as volume_files
from voxelry.sources.store import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The thresholds of the stability index.
NINE = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def volumes(n: int) -> str:
    """SQL of the embeddings as images (n = 2) or volumes (n = 3)."""
    w, d = (8, 1) if n == 2 else (4, 4)
    at = "i % 8 AS x, i // 8 AS y, 0 AS z" if n == 2 else "i % 4 AS x, i // 4 % 4 AS y, i // 16 AS z"
    return f"""vox AS (SELECT vec_id AS vol_id, {at}, floor(255 * least(greatest((embedding[i + 1]::DOUBLE - -0.6) / 1.2, 0), 1))::INT AS v FROM embeddings, range(64) t(i)),
lat AS (SELECT ex.range AS ex, ey.range AS ey, ez.range AS ez FROM range({2 * w - 1}) ex, range({2 * w - 1}) ey, range({2 * d - 1}) ez),
cells AS (
  SELECT vol_id, ex, ey, ez, min(v) AS lo, max(v) AS hi, avg(v) AS mean, median(v) AS med
  FROM lat JOIN vox ON x BETWEEN ex // 2 AND (ex + 1) // 2 AND y BETWEEN ey // 2 AND (ey + 1) // 2 AND z BETWEEN ez // 2 AND (ez + 1) // 2
  GROUP BY vol_id, ex, ey, ez)"""


def face_blocks(field: str, planes: tuple[str, ...] = ("xy",)) -> str:
    """SQL of the gaps of a field's face blocks, by self-joins along the two axes."""
    parts = []
    for p in planes:
        a, b = f"e{p[0]}", f"e{p[1]}"
        c = ({"xy": "ez", "xz": "ey", "yz": "ex"})[p]
        join = lambda t, da, db: f"JOIN {field} {t} ON {t}.vol_id = p.vol_id AND {t}.{a} = p.{a} + {da} AND {t}.{b} = p.{b} + {db} AND {t}.{c} = p.{c}"
        parts.append(f"""SELECT p.vol_id, '{p}' AS plane, p.ex, p.ey, p.ez, greatest(least(p.u, s.u) - greatest(q.u, r.u), least(q.u, r.u) - greatest(p.u, s.u)) AS gap
  FROM {field} p {join("q", 1, 0)} {join("r", 0, 1)} {join("s", 1, 1)}""")
    return " UNION ALL ".join(parts)


SUMMARY = "SELECT vol_id, count(*) AS n_blocks, count(*) FILTER (WHERE gap > 0) AS n_violations, coalesce(max(gap) FILTER (WHERE gap > 0), 0)::DOUBLE AS max_abs_error, (count(*) FILTER (WHERE gap > 0)) / count(*)::DOUBLE AS violation_rate FROM blocks GROUP BY vol_id"


def closure(name: str, start: str) -> str:
    """SQL of CTEs ``<name>_front`` and ``<name>``: the well-composed field, a step of the front in each round of a recursion.

    ``start`` has a row for each group with key columns k (a list), w, h, d cells along the axes, l (the border's level),
    and lists lo, hi and s in row-major order; s holds the level at which a cell waits, -1 for none. A step closes all cells
    that wait at the level nearest to the last one, the upper of two, and lets their neighbours wait.
    """
    at = "(i - 1)"
    ways = [(f"{at} // (h * d) > 0", "i - h * d"), (f"{at} // (h * d) < w - 1", "i + h * d"), (f"{at} // d % h > 0", "i - d"), (f"{at} // d % h < h - 1", "i + d"), (f"{at} % d > 0", "i - 1"), (f"{at} % d < d - 1", "i + 1")]
    touched = " OR ".join(f"({there} AND s[{j}] = l)" for there, j in ways)
    nearest = "255 - list_min(list_transform(list_filter(s, lambda v: v BETWEEN 0 AND 255), lambda v: abs(v - l) * 1000 + 255 - v)) % 1000"
    return f"""{name}_front AS (SELECT k, w, h, d, l, lo, hi, s, 0 AS step FROM ({start})
  UNION ALL SELECT k, w, h, d, l, lo, hi, list_transform(s, lambda v, i: CASE WHEN v = l THEN 1000 + l WHEN v = -1 AND ({touched}) THEN greatest(lo[i], least(l, hi[i])) ELSE v END), step + 1
  FROM (SELECT k, w, h, d, lo, hi, s, step, ({nearest})::INT AS l FROM {name}_front WHERE list_bool_or(list_transform(s, lambda v: v BETWEEN 0 AND 255)))),
{name} AS (SELECT k, (i // (h * d))::INT AS ex, (i // d % h)::INT AS ey, (i % d)::INT AS ez, (s[i + 1] - 1000)::INT AS u FROM (SELECT k, w, h, d, arg_max(s, step) AS s FROM {name}_front GROUP BY ALL), range(343) t(i) WHERE i < w * h * d)"""


def dense_start(cells: str, keys: str, level: str, d: str = "7", seed: str = "NULL") -> str:
    """SQL of ``closure``'s start from cells (keys, ex, ey, ez, lo, hi): those at the rim wait, and those with a seed."""
    rim = f"least(ex, ey, ez) = 0 OR greatest(ex, ey) = 6 OR ez = {d} - 1"
    waits = f"CASE WHEN {seed} IS NOT NULL THEN {seed} WHEN {rim} THEN greatest(lo, least({level}, hi)) ELSE -1 END"
    order = "ORDER BY ex, ey, ez"
    return f"SELECT [{keys}] AS k, 7 AS w, 7 AS h, any_value({d})::INT AS d, any_value({level})::INT AS l, list(lo::INT {order}) AS lo, list(hi::INT {order}) AS hi, list(({waits})::INT {order}) AS s FROM {cells} GROUP BY [{keys}]"


def emb(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return raster.embeddings(spark, sf_dir, f"emb{n}d")


def report(checked: DataFrame) -> DataFrame:
    return checked.select("vol_id", "n_blocks", "n_violations", "max_abs_error", "violation_rate")


# --- the flagship: 2-D field, checked


@query(f"WITH {volumes(2)}, f AS (SELECT *, greatest(lo, least(0, hi)) AS u FROM cells), blocks AS ({face_blocks('f')}) {SUMMARY}")
def dwc2d_summary(spark, sf_dir):
    return report(verify.well_composed(interpolate.field_2d(emb(spark, sf_dir, 2)), flat=True))


@query(f"WITH {volumes(2)}, f AS (SELECT vol_id, ex, ey, ez, mean AS u FROM cells), blocks AS ({face_blocks('f')}) {SUMMARY}")
def dwc_naive2d(spark, sf_dir):
    return report(verify.well_composed(interpolate.linear(emb(spark, sf_dir, 2)), flat=True))


# --- stencils

for _n in (2, 3):

    def _ispan(spark, sf_dir, n=_n):
        return interpolate.interval_span(emb(spark, sf_dir, n)).select("vol_id", "ex", "ey", "ez", "lo", "hi")

    def _naive(spark, sf_dir, n=_n):
        return interpolate.linear(emb(spark, sf_dir, n)).select("vol_id", "ex", "ey", "ez", "u")

    def _nearest(spark, sf_dir, n=_n):
        return interpolate.nearest(emb(spark, sf_dir, n)).select("vol_id", "ex", "ey", "ez", "u")

    QUERIES |= {f"ispan{_n}d": _ispan, f"naive{_n}d": _naive, f"nearest{_n}d": _nearest}
    SQL |= {
        f"ispan{_n}d": f"WITH {volumes(_n)} SELECT vol_id, ex, ey, ez, lo, hi FROM cells",
        f"naive{_n}d": f"WITH {volumes(_n)} SELECT vol_id, ex, ey, ez, mean AS u FROM cells",
        f"nearest{_n}d": f"WITH {volumes(_n)} SELECT vol_id, ex, ey, ez, v AS u FROM lat JOIN vox ON x = (ex + 1) // 2 AND y = (ey + 1) // 2 AND z = (ez + 1) // 2",
    }


@query(f"WITH {volumes(3)} SELECT vol_id, ex, ey, ez, med AS u FROM cells")
def median_cells(spark, sf_dir):
    return interpolate.corner_median(emb(spark, sf_dir, 3)).select("vol_id", "ex", "ey", "ez", "u")


@query(f"WITH {volumes(3)} SELECT vol_id, (ex % 2 + ey % 2 + ez % 2)::INT AS k, count(*) AS n, sum(hi - lo)::BIGINT AS width FROM cells GROUP BY ALL")
def cell_type(spark, sf_dir):
    cells = interpolate.interval_span(emb(spark, sf_dir, 3))
    return cells.groupBy("vol_id", scalar.cell_kind().cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("width"))


_faces = " UNION ALL ".join(f"SELECT vol_id, v FROM vox WHERE {c} = {e}" for c in "xyz" for e in (0, 3))


@query(f"WITH {volumes(3)}, faces AS ({_faces}) SELECT vol_id, median(v) AS l_inf FROM faces GROUP BY vol_id")
def linf_border(spark, sf_dir):
    return interpolate.border_level(emb(spark, sf_dir, 3))


@query(f"""WITH {volumes(2)}, faces AS (SELECT vol_id, v FROM vox WHERE x = 0 UNION ALL SELECT vol_id, v FROM vox WHERE x = 7 UNION ALL SELECT vol_id, v FROM vox WHERE y = 0
  UNION ALL SELECT vol_id, v FROM vox WHERE y = 7 UNION ALL SELECT vol_id, v FROM vox UNION ALL SELECT vol_id, v FROM vox),
l AS (SELECT vol_id, round_even(median(v), 0) AS l FROM faces GROUP BY vol_id) SELECT vol_id, ex, ey, greatest(lo, least(l, hi))::INT AS u FROM cells JOIN l USING (vol_id)""")
def field2d_median(spark, sf_dir):
    return interpolate.field_2d(emb(spark, sf_dir, 2), "border_median").select("vol_id", "ex", "ey", "u")


@query(f"""WITH {volumes(3)}, l AS (SELECT vol_id, 7 AS l FROM vox GROUP BY vol_id), rim AS (SELECT l.vol_id, l.l AS v FROM l, range(-1, 8) a(x), range(-1, 8) b(y), range(-1, 8) c(z) WHERE least(a.x, b.y, c.z) = -1 OR greatest(a.x, b.y, c.z) = 7)
SELECT vol_id, count(*) AS n_cells, sum(lo)::DOUBLE AS lo_sum, sum(hi)::DOUBLE AS hi_sum FROM (SELECT vol_id, lo, hi FROM cells UNION ALL SELECT vol_id, v, v FROM rim) GROUP BY vol_id""")
def pad_border(spark, sf_dir):
    voxels = emb(spark, sf_dir, 3)
    cells = interpolate.padded(interpolate.with_border_level(interpolate.interval_span(voxels), voxels, 7))
    return cells.groupBy("vol_id").agg(F.count("*").alias("n_cells"), F.sum("lo").alias("lo_sum"), F.sum("hi").alias("hi_sum"))


@query(f"""WITH {volumes(2)}, c AS (SELECT p.vol_id, p.ex, p.ey, any_value(p.med) AS u, min(q.med) AS lo, max(q.med) AS hi FROM cells p JOIN cells q ON p.vol_id = q.vol_id
  AND (abs(p.ex - q.ex) + abs(p.ey - q.ey) = 1 OR (p.ex = q.ex AND p.ey = q.ey)) GROUP BY p.vol_id, p.ex, p.ey)
SELECT vol_id, ex, ey, CASE WHEN (ex % 2 + ey % 2) > 0 THEN greatest(lo, least(u, hi)) ELSE u END AS u FROM c""")
def self_dual_correction(spark, sf_dir):
    # with one plane every cell is at the edge along z, so the cell itself always counts among its neighbours
    return interpolate.immerse(emb(spark, sf_dir, 2)).select("vol_id", "ex", "ey", "u")


@query(f"""WITH {volumes(2)} SELECT vol_id, ex, ey, ez, (v >= 0.5)::INT AS u FROM lat JOIN (SELECT vol_id, x, y, z, v / 255.0 AS v FROM vox) ON x = (ex + 1) // 2 AND y = (ey + 1) // 2""")
def label_upsample(spark, sf_dir):
    half = emb(spark, sf_dir, 2).withColumn("v", F.col("v") / 255.0)
    return interpolate.label_upsampled(half).select("vol_id", "ex", "ey", "ez", "u")


# --- checks


def _body() -> str:
    joins = " ".join(f"JOIN f c{k} ON c{k}.vol_id = c0.vol_id AND c{k}.ex = c0.ex + {k & 1} AND c{k}.ey = c0.ey + {k >> 1 & 1} AND c{k}.ez = c0.ez + {k >> 2}" for k in range(1, 8))
    gaps = []
    for k in range(4):
        rest = ", ".join(f"c{i}.u" for i in range(8) if i not in (k, 7 - k))
        gaps.append(f"least(c{k}.u, c{7 - k}.u) - greatest({rest}), least({rest}) - greatest(c{k}.u, c{7 - k}.u)")
    return f"SELECT c0.vol_id, 'xyz' AS plane, c0.ex, c0.ey, c0.ez, greatest({', '.join(gaps)}) AS gap FROM f c0 {joins}"


@query(f"""WITH {volumes(3)}, f AS (SELECT vol_id, ex, ey, ez, mean AS u FROM cells), blocks AS ({face_blocks('f', ('xy', 'xz', 'yz'))} UNION ALL {_body()})
SELECT vol_id, count(*) AS n_blocks, count(*) FILTER (WHERE gap > 0) AS n_violations, coalesce(max(gap) FILTER (WHERE gap > 0 AND plane <> 'xyz'), 0)::DOUBLE AS max_abs_error, (count(*) FILTER (WHERE gap > 0)) / count(*)::DOUBLE AS violation_rate FROM blocks GROUP BY vol_id""")
def dwc_blocks3d(spark, sf_dir):
    return report(verify.well_composed(interpolate.linear(emb(spark, sf_dir, 3))))


@query(f"""WITH {volumes(2)}, f AS (SELECT vol_id, ex, ey, ez, mean AS u FROM cells), blocks AS ({face_blocks('f')})
SELECT DISTINCT vol_id, ex + dx.range AS ex, ey + dy.range AS ey, ez FROM blocks, range(2) dx, range(2) dy WHERE gap > 0""")
def violating_cells(spark, sf_dir):
    return verify.violating_cells(interpolate.linear(emb(spark, sf_dir, 2)), flat=True).select("vol_id", "ex", "ey", "ez")


@query(f"WITH {volumes(2)} SELECT vol_id, max(abs(greatest(lo, least(0, hi)) - v))::INT AS max_error FROM cells JOIN vox USING (vol_id) WHERE ex = 2 * x AND ey = 2 * y GROUP BY vol_id")
def zero_cell_error(spark, sf_dir):
    voxels = emb(spark, sf_dir, 2)
    return verify.voxel_error(interpolate.field_2d(voxels), voxels)


@query(f"WITH {volumes(2)} SELECT vol_id, count(*) FILTER (WHERE 100 NOT BETWEEN lo AND hi) AS n_outside, count(*) AS n_cells FROM cells GROUP BY vol_id")
def interval_bounds(spark, sf_dir):
    """Cells whose span does not hold 100, as a field that is 100 everywhere."""
    cells = interpolate.interval_span(emb(spark, sf_dir, 2))
    return verify.within_span(cells.withColumn("u", F.lit(100)), cells)


@query(f"""WITH {volumes(3)}, c AS (SELECT p.vol_id, p.ex, p.ey, p.ez, any_value(p.med) AS u, min(q.med) AS lo, max(q.med) AS hi FROM cells p JOIN cells q ON p.vol_id = q.vol_id
  AND abs(p.ex - q.ex) + abs(p.ey - q.ey) + abs(p.ez - q.ez) = 1 GROUP BY p.vol_id, p.ex, p.ey, p.ez)
SELECT vol_id, count(*) FILTER (WHERE (ex % 2 + ey % 2 + ez % 2) > 0 AND (u < lo OR u > hi)) AS n_outside FROM c GROUP BY vol_id""")
def self_dual_check(spark, sf_dir):
    return verify.self_dual(interpolate.corner_median(emb(spark, sf_dir, 3)))


# --- normalising


@query(f"""WITH {volumes(2)}, p AS (SELECT vol_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM vox WHERE v > 0 GROUP BY vol_id)
SELECT vol_id, x, y, CASE WHEN v > 0 THEN floor(greatest(0.0, least(1.0, (v - a) / (b - a + 1e-9::DOUBLE))) * 255)::INT ELSE 0 END AS v FROM vox LEFT JOIN p USING (vol_id)""")
def pct_normalise(spark, sf_dir):
    return interpolate.percentile_normalised(emb(spark, sf_dir, 2)).select("vol_id", "x", "y", "v")


@query(f"WITH {volumes(2)} SELECT vol_id, x, y, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)::DOUBLE ELSE 0 END AS v FROM vox WINDOW w AS (PARTITION BY vol_id)")
def minmax_normalise(spark, sf_dir):
    return interpolate.min_max_normalised(emb(spark, sf_dir, 2)).select("vol_id", "x", "y", "v")


@query(f"WITH {volumes(2)} SELECT vol_id, count(*) FILTER (WHERE v > 127.5) AS n_on, count(*) AS n FROM vox GROUP BY vol_id")
def threshold_mask(spark, sf_dir):
    return interpolate.thresholded(emb(spark, sf_dir, 2), 127.5).groupBy("vol_id").agg(F.count_if("m").alias("n_on"), F.count("*").alias("n"))


@query(f"WITH {volumes(2)} SELECT vol_id, avg((v > 160)::INT) AS fg_rate FROM vox GROUP BY vol_id HAVING avg((v > 160)::INT) BETWEEN 0.05 AND 0.95")
def fg_gate(spark, sf_dir):
    return labels.foreground(interpolate.thresholded(emb(spark, sf_dir, 2), 160), 0.05, 0.95)


# --- topology


def _chi(n: int, names: tuple[str, str, str], table: str) -> str:
    """SQL of chi by self-joins: corners that all exist, with the sign of the part's dimension."""
    parts = []
    for span in range(1 << n):
        axes = [names[a] for a in range(n) if span >> a & 1]
        joins = ""
        for k in range(1, 1 << len(axes)):
            on = " AND ".join(f"t{k}.{c} = t.{c} + {k >> axes.index(c) & 1}" if c in axes else f"t{k}.{c} = t.{c}" for c in names)
            joins += f" JOIN {table} t{k} ON t{k}.vol_id = t.vol_id AND {on}"
        parts.append(f"SELECT t.vol_id, {(-1) ** len(axes)} AS s FROM {table} t{joins}")
    return " UNION ALL ".join(parts)


@query(f"WITH {volumes(2)}, m AS (SELECT * FROM vox WHERE v > 127), parts AS ({_chi(2, ('x', 'y', 'z'), 'm')}) SELECT vol_id, sum(s)::BIGINT AS chi FROM parts GROUP BY vol_id")
def euler2d(spark, sf_dir):
    return topology.euler(emb(spark, sf_dir, 2).filter("v > 127"), ["vol_id"], ("x", "y", "z"), flat=True)


@query(f"WITH {volumes(3)}, m AS (SELECT * FROM vox WHERE v > 127), parts AS ({_chi(3, ('x', 'y', 'z'), 'm')}) SELECT vol_id, sum(s)::BIGINT AS chi FROM parts GROUP BY vol_id")
def euler3d(spark, sf_dir):
    return topology.euler(emb(spark, sf_dir, 3).filter("v > 127"), ["vol_id"], ("x", "y", "z"))


def _b0(n: int, near: str, level: int = 127) -> str:
    """SQL of b0: the smallest point that each point reaches, by a recursive union of distinct pairs."""
    return f"""WITH RECURSIVE {volumes(n)}, m AS (SELECT vol_id, x, y, z, x + 8 * y + 64 * z AS id FROM vox WHERE v > {level}),
e AS (SELECT a.vol_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.vol_id = b.vol_id AND a.id <> b.id AND {near}),
r AS (SELECT vol_id, id, id AS root FROM m UNION SELECT e.vol_id, e.b, r.root FROM r JOIN e ON e.vol_id = r.vol_id AND e.a = r.id AND r.root < e.b)
SELECT vol_id, count(*) FILTER (WHERE low = id) AS b0 FROM (SELECT vol_id, id, min(root) AS low FROM r GROUP BY vol_id, id) GROUP BY vol_id"""


_l1, _linf = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)", "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))"
for _name, _n, _c, _near in (("beta0_4", 2, 4, f"{_l1} = 1"), ("beta0_8", 2, 8, f"{_linf} = 1"), ("beta0_6", 3, 6, f"{_l1} = 1"), ("beta0_18", 3, 18, f"{_linf} = 1 AND {_l1} <= 2"), ("beta0_26", 3, 26, f"{_linf} = 1")):

    def _beta(spark, sf_dir, n=_n, c=_c):
        return topology.components(emb(spark, sf_dir, n).filter("v > 127"), ["vol_id"], c, ("x", "y", "z"))

    QUERIES[_name], SQL[_name] = _beta, _b0(_n, _near)


@query(f"WITH {volumes(2)}, a AS ({_b0(2, _l1 + ' = 1').replace('WITH RECURSIVE ' + volumes(2) + ',', 'WITH RECURSIVE')}) SELECT sum(b0)::BIGINT AS b0, count(*) AS n_volumes FROM a")
def beta0_large(spark, sf_dir):
    masks = emb(spark, sf_dir, 2).filter("v > 127")
    found = topology.large_components(masks, 4, ("x", "y", "z"), (F.col("w"), F.col("h"), F.col("d")))
    return found.filter("point = root").agg(F.count("*").alias("b0"), F.count_distinct("vol_id").alias("n_volumes"))


def _mean_counts(spark, sf_dir):
    field = interpolate.linear(emb(spark, sf_dir, 2)).withColumn("u", F.col("u") / 255)
    return topology.counts(field, NINE, flat=True)


def labelled(name: str, masks: str, steps: list[tuple[int, int]]) -> str:
    """SQL of CTEs ``<name>_round`` and ``<name>``: b0 of masks (k, and m, a list of 15 x 15), by labels that shrink.

    Every point takes the least label of itself, its neighbours and its own label's place, until none changes.
    """
    near = []
    for dx, dy in steps:
        inside = [c for d, v in ((dx, "(i - 1) // 15"), (dy, "(i - 1) % 15")) if d for c in ([f"{v} > 0"] if d < 0 else [f"{v} < 14"])]
        near.append(f"CASE WHEN {' AND '.join(inside)} THEN l[i + {15 * dx + dy}] END")
    return f"""{name}_round AS (SELECT k, list_transform(m, lambda v, i: CASE WHEN v THEN i END) AS l, 0 AS step FROM {masks}
  UNION ALL SELECT k, n, step + 1 FROM (SELECT k, l, step, list_transform(l, lambda v, i: CASE WHEN v IS NOT NULL THEN list_min([v, l[v], {', '.join(near)}]) END) AS n FROM {name}_round) WHERE n <> l),
{name} AS (SELECT k, len(list_filter(list_transform(l, lambda v, i: v = i), lambda v: v)) AS b0 FROM (SELECT k, arg_max(l, step) AS l FROM {name}_round GROUP BY k))"""


_four = [(0, 1), (0, -1), (1, 0), (-1, 0)]
_eight = [*_four, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def counts_sql(field: str) -> str:
    """SQL of CTE ``counted`` (k, thr, b0_low, b0_high, chi) of a field (k: an integer, ex, ey, u) over nine thresholds."""
    return f"""thrs AS (SELECT t + 1 AS i, (30 + 5 * t) / 100.0::DOUBLE AS thr FROM range(9) r(t)),
over AS (SELECT k * 16 + i AS vol_id, ex, ey, 0 AS ez FROM {field} JOIN thrs ON u >= thr), marked AS (SELECT k * 16 + i AS k, list(u >= thr ORDER BY ex, ey) AS m FROM {field}, thrs GROUP BY ALL),
{labelled('low', 'marked', _four)}, {labelled('high', 'marked', _eight)}, parts AS ({_chi(2, ('ex', 'ey', 'ez'), 'over')}), chis AS (SELECT vol_id AS k, sum(s)::BIGINT AS chi FROM parts GROUP BY vol_id),
counted AS (SELECT low.k // 16 AS k, thr, low.b0 AS b0_low, high.b0 AS b0_high, coalesce(chi, 0) AS chi FROM low JOIN high USING (k) LEFT JOIN chis USING (k) JOIN thrs ON low.k % 16 = i)"""


_cross = "abs(b0_low - b0_high) AS cc, (b0_low = b0_high)::INT AS cc_zero, CASE WHEN b0_low > 0 THEN round_even(b0_high / b0_low::DOUBLE, 6) ELSE 1.0 END::DOUBLE AS b0_consistency, (ref_chi <> 0 AND ref_chi * chi < 0)::INT AS chi_sign_flip, greatest(0, b0_high - chi) AS beta1_proxy"
_ref = f"ref_parts AS ({_chi(2, ('x', 'y', 'z'), 'on_voxels')}), ref AS (SELECT vol_id, sum(s)::BIGINT AS ref_chi FROM ref_parts GROUP BY vol_id)"
_mean = "f AS (SELECT vol_id AS k, ex, ey, mean / 255 AS u FROM cells)"


@query(f"WITH RECURSIVE {volumes(2)}, {_mean}, {counts_sql('f')}, on_voxels AS (SELECT * FROM vox WHERE v > 127), {_ref}, every AS (SELECT c.k AS vol_id, thr, b0_low, b0_high, chi, coalesce(ref_chi, 0) AS ref_chi FROM counted c LEFT JOIN ref ON ref.vol_id = c.k) SELECT *, {_cross} FROM every")
def cross_connectivity(spark, sf_dir):
    """Differences of b0 under both adjacencies with consistency, flips and the beta1 proxy, over nine thresholds."""
    counted = _mean_counts(spark, sf_dir)
    ref = topology.euler(emb(spark, sf_dir, 2).filter("v > 127"), ["vol_id"], ("x", "y", "z"), flat=True).withColumnRenamed("chi", "ref_chi")
    both = counted.join(ref, "vol_id", "left").na.fill(0, ["ref_chi"])
    return both.withColumns(topology.cross_metrics(F.col("b0_low"), F.col("b0_high"), F.col("chi"), F.col("ref_chi")))


@query(f"WITH RECURSIVE {volumes(2)}, {_mean}, {counts_sql('f')} SELECT k AS vol_id, round(stddev_pop(b0_high), 9) AS tsi FROM counted GROUP BY k")
def tsi9(spark, sf_dir):
    return topology.stability(_mean_counts(spark, sf_dir)).withColumn("tsi", F.round("tsi", 9))


@query(f"WITH {volumes(2)} SELECT vol_id, bool_and(v IN (0, 1))::INT AS is_binary FROM vox GROUP BY vol_id")
def is_binary(spark, sf_dir):
    return topology.is_binary(emb(spark, sf_dir, 2).withColumnRenamed("v", "u"))


_methods = ["nearest", "linear", "field_border", "field_zero"]
_masks = volumes(2).replace("vox AS (", "gray AS (", 1).replace("\nlat AS", "\nvox AS (SELECT vol_id, x, y, z, (v > 127)::INT AS v FROM gray),\nlat AS", 1)
_fields = """rims AS (SELECT vol_id, v FROM vox WHERE x = 0 UNION ALL SELECT vol_id, v FROM vox WHERE x = 7 UNION ALL SELECT vol_id, v FROM vox WHERE y = 0 UNION ALL SELECT vol_id, v FROM vox WHERE y = 7
  UNION ALL SELECT vol_id, v FROM vox UNION ALL SELECT vol_id, v FROM vox), rim AS (SELECT vol_id, round_even(median(v), 0) AS l FROM rims GROUP BY vol_id),
f AS (SELECT c.vol_id * 4 AS k, ex, ey, v::DOUBLE AS u FROM cells c JOIN vox USING (vol_id) WHERE x = (ex + 1) // 2 AND y = (ey + 1) // 2 UNION ALL SELECT vol_id * 4 + 1, ex, ey, mean FROM cells
  UNION ALL SELECT vol_id * 4 + 2, ex, ey, greatest(lo, least(l, hi)) FROM cells JOIN rim USING (vol_id) UNION ALL SELECT vol_id * 4 + 3, ex, ey, greatest(lo, least(0, hi)) FROM cells)"""


@query(f"""WITH RECURSIVE {_masks}, {_fields}, {counts_sql('f')}, on_voxels AS (SELECT * FROM vox WHERE v = 1), {_ref},
tsis AS (SELECT k, round(stddev_pop(b0_high), 9) AS tsi FROM counted GROUP BY k), twos AS (SELECT k, bool_and(u IN (0, 1))::INT AS is_binary FROM f GROUP BY k),
every AS (SELECT k // 4 AS vol_id, {_methods}[k % 4 + 1] AS method, b0_low, b0_high, chi, coalesce(ref_chi, 0) AS ref_chi, tsi, is_binary FROM counted JOIN tsis USING (k) JOIN twos USING (k) LEFT JOIN ref ON ref.vol_id = k // 4 WHERE thr = 0.5)
SELECT *, {_cross} FROM every""")
def topology_rows(spark, sf_dir):
    """One row for each image and method, with every topology metric."""
    masks = emb(spark, sf_dir, 2).withColumn("v", (F.col("v") > 127).cast("int"))
    return experiments.topology_rows(masks, _methods, NINE).withColumn("tsi", F.round("tsi", 9))


# --- labels, tiles, slabs

_label = """images AS (SELECT event_type, user_id AS x, hour(ts) AS y, count(*) AS n FROM events GROUP BY ALL),
ranked AS (SELECT x, y, dense_rank() OVER (ORDER BY event_type) AS t, n, event_type FROM images),
best AS (SELECT x, y, arg_max(t, n * 1000 - t) AS v FROM ranked GROUP BY x, y),
lab AS (SELECT u.range AS x, h.range AS y, coalesce(b.v, 0)::INT AS v FROM range((SELECT max(user_id) + 1 FROM events)) u CROSS JOIN range(24) h LEFT JOIN best b ON b.x = u.range AND b.y = h.range)"""


@query(f"WITH {_label} SELECT a.x, a.y, a.v, coalesce(bool_or(b.v <> a.v), false) AS m FROM lab a LEFT JOIN lab b ON (abs(a.x - b.x) = 1 AND a.y = b.y) OR (a.x = b.x AND abs(a.y - b.y) = 1) GROUP BY a.x, a.y, a.v".replace("LEFT JOIN lab b ON (abs(a.x - b.x) = 1 AND a.y = b.y) OR (a.x = b.x AND abs(a.y - b.y) = 1)", "LEFT JOIN (SELECT x + dx AS x, y + dy AS y, v FROM lab, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)) b ON a.x = b.x AND a.y = b.y"))
def membrane2d(spark, sf_dir):
    return labels.membrane(raster.event_labels(spark, sf_dir)).select("x", "y", "v", "m")


@query(f"WITH {volumes(2)} SELECT vol_id, tx.range AS tx, ty.range AS ty, count(*) AS n, sum(v)::BIGINT AS total FROM vox JOIN range(3) tx ON x BETWEEN 2 * tx.range AND 2 * tx.range + 3 JOIN range(3) ty ON y BETWEEN 2 * ty.range AND 2 * ty.range + 3 GROUP BY ALL")
def tiles(spark, sf_dir):
    return labels.tiles(emb(spark, sf_dir, 2), 4, 2).groupBy("vol_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {volumes(2)} SELECT vol_id, x - 1 AS x, y - 2 AS y, 1 AS off_x, 1 AS off_y, v FROM vox WHERE x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6")
def subvolume_crop(spark, sf_dir):
    return labels.crop(emb(spark, sf_dir, 2), (2, 3, 0), (4, 3, 1), 1).select("vol_id", "x", "y", "off_x", "off_y", "v")


@query("SELECT vec_id AS vol_id, k, z0, z1, z0e, z1e FROM embeddings, (VALUES (0, 0, 2, 0, 3), (1, 2, 3, 1, 4), (2, 3, 4, 2, 4)) t(k, z0, z1, z0e, z1e)")
def domain_split(spark, sf_dir):
    return decompose.slabs(emb(spark, sf_dir, 3), 3, 1).select("vol_id", "k", "z0", "z1", "z0e", "z1e")


@query(f"WITH {volumes(3)} SELECT vol_id, k, count(*) AS n, sum(v)::BIGINT AS total FROM vox JOIN (VALUES (0, 0, 3), (1, 1, 4), (2, 2, 4)) t(k, a, b) ON z >= a AND z < b GROUP BY vol_id, k")
def halo(spark, sf_dir):
    voxels = emb(spark, sf_dir, 3)
    return decompose.with_halo(voxels.drop("n"), decompose.slabs(voxels, 3, 1)).groupBy("vol_id", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {volumes(2)} SELECT vol_id, ex, ey, (row_number() OVER (PARTITION BY vol_id ORDER BY greatest(lo, least(0, hi)), ex * 15 + ey) - 1)::INT AS f_ord FROM cells")
def f_ord(spark, sf_dir):
    return propagate.ordered(interpolate.field_2d(emb(spark, sf_dir, 2))).select("vol_id", "ex", "ey", "f_ord")


# --- propagation and slabs: invariants of the gray fields

_whole = closure("whole", dense_start("cells", "vol_id", "0"))
_faces3 = "faces AS (" + " UNION ALL ".join(f"SELECT vol_id, v FROM vox WHERE {c} = {e}" for c in "xyz" for e in (0, 3)) + "), border AS (SELECT vol_id, round_even(median(v), 0)::INT AS l FROM faces GROUP BY vol_id)"


def _checked(field: str, cells: str = "cells") -> str:
    """SQL of blocks, violations and sums of a field f (vol_id, ex, ey, ez, u)."""
    return f"""blocks AS ({face_blocks('f', ('xy', 'xz', 'yz'))} UNION ALL {_body()}), bad AS (SELECT vol_id, count(*) FILTER (WHERE gap > 0) AS n_violations FROM blocks GROUP BY vol_id),
sums AS (SELECT vol_id, count(*) FILTER (WHERE u NOT BETWEEN lo AND hi) AS n_outside, count(*) AS n_cells, sum(u)::BIGINT AS total, sum(u * (ex + 7 * ey + 49 * ez + 1))::BIGINT AS placed FROM f JOIN {cells} USING (vol_id, ex, ey, ez) GROUP BY vol_id)
SELECT vol_id, n_violations, n_outside, n_cells, total, placed FROM bad JOIN sums USING (vol_id)"""


def _invariants(spark, sf_dir, l_inf):
    voxels = emb(spark, sf_dir, 3)
    field = propagate.whole(checkpointed(propagate.propagated_whole(voxels, l_inf), "field"))
    bad = verify.whole_checked(field).select("vol_id", "n_violations")
    place = F.col("ex") + 7 * F.col("ey") + 49 * F.col("ez") + 1
    u, outside = F.col("u"), (F.col("u") < F.col("lo")) | (F.col("u") > F.col("hi"))
    sums = verify.whole_beside(field, interpolate.interval_span(voxels)).groupBy("vol_id").agg(F.count_if(outside).alias("n_outside"), F.count("*").alias("n_cells"), F.sum("u").alias("total"), F.sum(u * place).alias("placed"))
    return bad.join(sums, "vol_id").select("vol_id", "n_violations", "n_outside", "n_cells", "total", "placed")


@query(f"WITH RECURSIVE {volumes(3)}, {_whole}, f AS (SELECT k[1] AS vol_id, ex, ey, ez, u FROM whole), {_checked('f')}")
def udwc3d_zero(spark, sf_dir):
    return _invariants(spark, sf_dir, "zero")


@query(f"WITH RECURSIVE {volumes(3)}, {_faces3}, with_l AS (SELECT * FROM cells JOIN border USING (vol_id)), {closure('whole', dense_start('with_l', 'vol_id', 'l'))}, f AS (SELECT k[1] AS vol_id, ex, ey, ez, u FROM whole), {_checked('f')}")
def udwc3d_median(spark, sf_dir):
    return _invariants(spark, sf_dir, "border_median")


@query(f"WITH RECURSIVE {volumes(3)}, {_whole} SELECT k[1] AS vol_id, ex, ey, ez, u FROM whole")
def immersion3d(spark, sf_dir):
    """Every cell of the gray field."""
    return propagate.propagated(emb(spark, sf_dir, 3), "zero").select("vol_id", "ex", "ey", "ez", "u")


@query(f"WITH RECURSIVE {volumes(3)}, {_whole} SELECT k[1] AS vol_id, ex, ey, ez, u FROM whole")
def immersion_blocks(spark, sf_dir):
    """Every cell of the gray field, by blocks of 4 x 4 x 4 cells that close in step."""
    return fronts.propagated_in_blocks(emb(spark, sf_dir, 3), "zero", 4).select("vol_id", "ex", "ey", "ez", "u")


_seeded = "pinned AS (SELECT c.vol_id, c.ex, c.ey, c.ez, coalesce(p.v, lo) AS lo, coalesce(p.v, hi) AS hi, p.v AS seed FROM cells c LEFT JOIN vox p ON p.vol_id = c.vol_id AND c.ez = 3 AND p.x * 2 = c.ex AND p.y * 2 = c.ey AND p.z = 2 AND p.v % 5 > 0)"


def _planes(spark, sf_dir):
    """A plane between two of the voxels', with the upper voxels' levels at the voxels' places, some of them null."""
    plane = emb(spark, sf_dir, 3).filter("z = 2")
    return plane.select(*VOLUME, (2 * F.col("x")).alias("ex"), (2 * F.col("y")).alias("ey"), F.lit(3).alias("ez"), F.when(F.col("v") % 5 > 0, F.col("v")).alias("u"))


@query(f"WITH {volumes(3)}, {_seeded} SELECT * FROM pinned")
def pinned_spans(spark, sf_dir):
    cells = interpolate.interval_span(emb(spark, sf_dir, 3))
    return decompose.pinned_spans(cells, _planes(spark, sf_dir)).select("vol_id", "ex", "ey", "ez", "lo", "hi", "seed")


@query(f"WITH RECURSIVE {volumes(3)}, {_seeded}, {closure('whole', dense_start('pinned', 'vol_id', '0', '7', 'seed'))} SELECT k[1] AS vol_id, ex, ey, ez, u FROM whole")
def seeded_blocks(spark, sf_dir):
    """The field by blocks, from the border and a pinned plane's seeds."""
    return fronts.propagated_in_blocks(emb(spark, sf_dir, 3), "zero", 4, _planes(spark, sf_dir)).select("vol_id", "ex", "ey", "ez", "u")


@query(f"""WITH RECURSIVE {volumes(3)}, b AS (SELECT vol_id, ex, ey, ez, (lo > 127)::INT AS lo, (hi > 127)::INT AS hi FROM cells),
edge AS (SELECT vol_id, ex, ey, ez FROM b WHERE lo = 0 AND (least(ex, ey, ez) = 0 OR greatest(ex, ey, ez) = 6)),
flood AS (SELECT vol_id, ex, ey, ez FROM edge UNION SELECT b.vol_id, b.ex, b.ey, b.ez FROM flood f, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(dx, dy, dz), b
  WHERE b.vol_id = f.vol_id AND b.ex = f.ex + dx AND b.ey = f.ey + dy AND b.ez = f.ez + dz AND b.lo = 0),
rest AS (SELECT vol_id, count(*) AS n_low FROM flood GROUP BY vol_id)
SELECT v.vol_id, coalesce(r.n_low, 0) AS n_flooded FROM (SELECT DISTINCT vol_id FROM vox) v LEFT JOIN rest r USING (vol_id)""")
def udwc3d_flood(spark, sf_dir):
    """Cells that a binary volume's field takes at level 0 before it first rises: those the border's front floods."""
    masks = emb(spark, sf_dir, 3).withColumn("v", (F.col("v") > 127).cast("int"))
    cells = interpolate.interval_span(masks)
    free = cells.filter("lo = 0").select("vol_id", "w", "h", "d", "ex", "ey", "ez")
    field = propagate.propagated(masks, "zero").select("vol_id", "ex", "ey", "ez", "u")
    # a cell of level 0 that is reached from outside lies in a component, by faces, that touches the border
    schema = "vol_id long, n_flooded long"

    def count(pdf):
        import pandas as pd

        at = pdf[["ex", "ey", "ez"]].to_numpy()
        root = topology.label(at, topology.half_steps(6))
        edge = (at == 0).any(axis=1) | (at == 6).any(axis=1)
        import numpy as np

        return pd.DataFrame({"vol_id": [pdf["vol_id"].iloc[0]], "n_flooded": [int(np.isin(root, root[edge]).sum())]})

    low = field.filter("u = 0").join(free, ["vol_id", "ex", "ey", "ez"])
    found = low.groupBy("vol_id").applyInPandas(count, schema)
    return masks.select("vol_id").distinct().join(found, "vol_id", "left").na.fill(0, ["n_flooded"])


def _slabs_sql(k: int, delta: int) -> list[tuple[int, int, int, int, int]]:
    """k, z0, z1, z0e, z1e of four planes in k slabs."""
    size, out = 4 // k, []
    for i in range(k):
        z0, z1 = i * size, (i + 1) * size
        out.append((i, z0, z1, max(0, z0 - delta), min(4, z1 + delta)))
    return out


def rounds_sql(k: int, delta: int, eps: int, rounds: int, shift: int = 0, one_plane: bool = False) -> str:
    """SQL of CTEs ``f0`` (slabs by themselves), ``f<r>`` (round r) and ``f`` with ``took``: injection rounds over the volumes."""
    values = ", ".join(str((i, z0, z1, z0e, z1e, 2 * (z1e - z0e) - 1, 2 * z0 + shift if i else 0, 2 * z1 + shift if i < k - 1 else 7)) for i, z0, z1, z0e, z1e in _slabs_sql(k, delta))
    parts = [f"""slab AS (SELECT * FROM (VALUES {values}) t(part, z0, z1, z0e, z1e, d, own_from, own_to)),
local AS (SELECT vol_id, part, z0, z1, z0e, z1e, d, own_from, own_to, ex, ey, ez - 2 * z0e AS ez, lo, hi FROM cells JOIN slab ON ez BETWEEN 2 * z0e AND 2 * z0e + d - 1)"""]

    def owned(r: int) -> str:
        return f"f{r} AS (SELECT k[1] AS vol_id, ex, ey, ez + 2 * z0e AS ez, u FROM g{r} JOIN slab ON part = k[2] WHERE ez + 2 * z0e >= own_from AND ez + 2 * z0e < own_to)"

    parts += [closure("g0", dense_start("local", "vol_id, part", "0", "d")), owned(0)]
    for r in range(1, rounds + 1):
        pinned = f"((part > 0 AND x.ez + 2 * z0e >= {'2 * z0' if one_plane else '0'} AND x.ez + 2 * z0e < 2 * z0 + 1) OR (part < {k - 1} AND x.ez + 2 * z0e >= 2 * z1 AND x.ez + 2 * z0e < 2 * z1e))"
        parts.append(f"p{r} AS (SELECT x.vol_id, part, d, x.ex, x.ey, x.ez, CASE WHEN {pinned} THEN y.u END AS pin, coalesce(CASE WHEN {pinned} THEN y.u END, lo) AS lo, coalesce(CASE WHEN {pinned} THEN y.u END, hi) AS hi FROM local x JOIN f{r - 1} y ON x.vol_id = y.vol_id AND x.ex = y.ex AND x.ey = y.ey AND x.ez + 2 * z0e = y.ez)")
        parts += [closure(f"g{r}", dense_start(f"p{r}", "vol_id, part", "0", "d", "pin")), owned(r)]
        parts.append(f"c{r} AS (SELECT vol_id, {r} AS r, max(abs(f{r}.u - f{r - 1}.u)) AS change FROM f{r} JOIN f{r - 1} USING (vol_id, ex, ey, ez) GROUP BY vol_id)")
    every = " UNION ALL ".join(f"SELECT * FROM c{r}" for r in range(1, rounds + 1))
    parts.append(f"took AS (SELECT vol_id, least(coalesce(min(r) FILTER (WHERE change < {eps}), {rounds}), {rounds})::INT AS rounds, count(*) FILTER (WHERE change < {eps}) > 0 AS converged FROM ({every}) GROUP BY vol_id)")
    parts.append("f AS (" + " UNION ALL ".join(f"SELECT vol_id, ex, ey, ez, u FROM f{r} JOIN took USING (vol_id) WHERE rounds = {r}" for r in range(1, rounds + 1)) + ")")
    return ",\n".join(parts)


def _ibi_sql(k: int, delta: int = 1, eps: int = 1, rounds: int = 3) -> str:
    bounds = ", ".join(f"({2 * z1 - 1}), ({2 * z1})" for i, _, z1, _, _ in _slabs_sql(k, delta) if i < k - 1) or "(-1)"
    near = ", ".join(str(2 * z1 + j) for i, _, z1, _, _ in _slabs_sql(k, delta) if i < k - 1 for j in range(-2, 3)) or ", ".join(map(str, range(7)))
    return f"""WITH RECURSIVE {volumes(3)}, {_whole}, {rounds_sql(k, delta, eps, rounds)}, blocks AS ({face_blocks('f', ('xy', 'xz', 'yz'))} UNION ALL {_body()}),
bad AS (SELECT vol_id, count(*) FILTER (WHERE gap > 0) AS n_violations, count(*) FILTER (WHERE gap > 0 AND plane IN ('xz', 'yz') AND ez IN (SELECT z FROM (VALUES {bounds}) b(z))) AS bdry_violations FROM blocks GROUP BY vol_id),
apart AS (SELECT f.vol_id, count(*) FILTER (WHERE f.u <> w.u) AS cells_differ, max(abs(f.u - w.u)) AS max_diff, max(abs(f.u - w.u)) FILTER (WHERE f.ez IN ({near})) AS max_diff_bounds FROM f JOIN whole w ON w.k[1] = f.vol_id AND w.ex = f.ex AND w.ey = f.ey AND w.ez = f.ez GROUP BY f.vol_id)
SELECT vol_id, n_violations, cells_differ, max_diff, max_diff_bounds, bdry_violations, rounds, converged FROM bad JOIN apart USING (vol_id) JOIN took USING (vol_id)"""


#: Slabs, halo, tolerance and most rounds of the injection queries.
IBI = {"ibi_k1": (1, 1, 0.5, 3), "ibi_k2": (2, 1, 0.5, 3), "ibi_k4": (4, 1, 0.5, 3), "ibi_wide": (2, 2, 0.5, 3), "ibi_eps": (4, 1, 2.0, 3)}
for _name, (_k, _delta, _eps, _most) in IBI.items():

    def _ibi(spark, sf_dir, k=_k, delta=_delta, eps=_eps, most=_most):
        voxels = checkpointed(emb(spark, sf_dir, 3), "volumes")
        field, took = decompose.injected(voxels, k, delta, max_rounds=most, eps=eps, small=True)
        field, undivided = propagate.whole(field), propagate.propagated_whole(voxels, "zero")
        bounds = decompose.bounds_of(decompose.slabs(voxels, k, delta))
        checked = verify.whole_checked(field, bounds).join(verify.whole_differing(field, undivided, bounds), "vol_id").join(took, "vol_id")
        return checked.select("vol_id", "n_violations", "cells_differ", "max_diff", "max_diff_bounds", "bdry_violations", "rounds", "converged")

    QUERIES[_name], SQL[_name] = _ibi, _ibi_sql(_k, _delta, -(-int(2 * _eps) // 2), _most)


@query(f"WITH RECURSIVE {volumes(3)}, {rounds_sql(2, 1, 1, 1)}, g AS (SELECT * FROM f0), blocks AS ({face_blocks('g', ('xy', 'xz', 'yz'))} UNION ALL {_body().replace('f c', 'g c')}) SELECT vol_id, count(*) AS n_blocks, count(*) FILTER (WHERE gap > 0) AS n_violations FROM blocks GROUP BY vol_id")
def ibi_round0(spark, sf_dir):
    voxels = emb(spark, sf_dir, 3)
    field = decompose.slab_fields(voxels, decompose.slabs(voxels, 2, 1), None, 0, 0)
    return verify.whole_checked(propagate.whole(field)).select("vol_id", "n_blocks", "n_violations")


def _deltas_sql() -> str:
    """Slabs by themselves at halos of 0 to 3, in SQL; a slab's number holds its halo."""
    rows = [(10 * delta + i, z0, z1, z0e, min(4, z1e + 1 - i), 2 * (min(4, z1e + 1 - i) - z0e) - 1, 2 * z0 + i, 2 * z1 + 1 if i == 0 else 7) for delta in range(4) for i, z0, z1, z0e, z1e in _slabs_sql(2, delta)]
    return f"""WITH RECURSIVE {volumes(3)}, slab AS (SELECT * FROM (VALUES {", ".join(map(str, rows))}) t(part, z0, z1, z0e, z1e, d, own_from, own_to)),
local AS (SELECT vol_id, part, z0, z1, z0e, z1e, d, own_from, own_to, ex, ey, ez - 2 * z0e AS ez, lo, hi FROM cells JOIN slab ON ez BETWEEN 2 * z0e AND 2 * z0e + d - 1),
{closure("g", dense_start("local", "vol_id, part", "0", "d"))},
f AS (SELECT k[1] * 10 + k[2] // 10 AS vol_id, ex, ey, ez + 2 * z0e AS ez, u FROM g JOIN slab ON part = k[2] WHERE ez + 2 * z0e >= own_from AND ez + 2 * z0e < own_to),
blocks AS ({face_blocks("f", ("xy", "xz", "yz"))} UNION ALL {_body()}), n AS (SELECT vol_id, count(*) AS n_cells FROM f GROUP BY vol_id),
bad AS (SELECT vol_id, count(*) FILTER (WHERE gap > 0) AS n_violations, count(*) FILTER (WHERE gap > 0 AND plane IN ('xz', 'yz') AND ez IN (3, 4)) AS bdry_violations FROM blocks GROUP BY vol_id)
SELECT vol_id // 10 AS vol_id, (vol_id % 10)::INT AS delta, n_cells, n_violations, bdry_violations FROM bad JOIN n USING (vol_id)"""


@query(_deltas_sql())
def round0_deltas(spark, sf_dir):
    """The step by halo: slabs by themselves, whose bounds violate at a halo of 0."""
    return decompose.step_by_delta(emb(spark, sf_dir, 3), 2, [0, 1, 2, 3], small=True).select("vol_id", "delta", "n_cells", "n_violations", "bdry_violations")


@query()
def li_cube_ibi(spark, sf_dir):
    """One larger volume, line items by quantity, discount and tax, in three slabs."""
    voxels = checkpointed(interpolate.percentile_normalised(raster.line_items(spark, sf_dir)), "cube")
    field, rounds = decompose.inject(voxels, 3)
    bounds = decompose.bounds_of(decompose.slabs(voxels, 3))
    checked = verify.well_composed(field).join(verify.boundary_violations(field, bounds), "vol_id")
    width = decompose.plane_width(interpolate.interval_span(voxels), decompose.slabs(voxels, 3))
    return checked.join(width, "vol_id").select("vol_id", "n_blocks", "n_violations", "bdry_violations", "plane_width_med", "plane_width_max", F.lit(rounds).alias("rounds"))


# --- statistics over rows by image and method

_rows_sql = f"""{volumes(2)}, f AS (SELECT vol_id, ex, ey, ez, greatest(lo, least(0, hi))::DOUBLE AS u FROM cells), g AS (SELECT vol_id, ex, ey, ez, mean AS u FROM cells),
rows AS (SELECT vol_id, 'field' AS method, sum(u) / 225 AS level, count(*) FILTER (WHERE gap > 0)::BIGINT AS bad FROM (SELECT vol_id, u, NULL AS gap FROM f UNION ALL SELECT vol_id, 0, gap FROM ({face_blocks('f')})) GROUP BY vol_id
UNION ALL SELECT vol_id, 'mean', sum(u) / 225, count(*) FILTER (WHERE gap > 0)::BIGINT FROM (SELECT vol_id, u, NULL AS gap FROM g UNION ALL SELECT vol_id, 0, gap FROM ({face_blocks('g')})) GROUP BY vol_id)"""


def _rows(spark, sf_dir) -> DataFrame:
    """(vol_id, method, level, bad): mean level and violating blocks of two methods."""
    voxels = emb(spark, sf_dir, 2)
    parts = []
    for name, field in (("field", interpolate.field_2d(voxels)), ("mean", interpolate.linear(voxels))):
        level = field.groupBy("vol_id").agg((F.sum(F.col("u").cast("double")) / 225).alias("level"))
        parts.append(verify.well_composed(field, flat=True).join(level, "vol_id").select("vol_id", F.lit(name).alias("method"), "level", F.col("n_violations").alias("bad")))
    return parts[0].unionByName(parts[1])


@query(f"WITH {_rows_sql} SELECT method, count(*) AS n, avg(bad) AS bad_mean, min(bad) AS bad_min, max(bad) AS bad_max, round(stddev_pop(bad), 9) AS bad_std, median(bad) AS bad_median, 100 * avg((bad = 0)::INT) AS bad_pct_zero FROM rows GROUP BY method")
def summary_by_method(spark, sf_dir):
    return stats.summary(_rows(spark, sf_dir), ["method"], ["bad"]).withColumn("bad_std", F.round("bad_std", 9))


@query(f"WITH {_rows_sql} SELECT method, count(bad) AS n, avg(bad) AS mean, round(coalesce(stddev_samp(bad), 0), 9) AS std, min(bad) AS min, max(bad) AS max, 100 * avg((bad = 0)::INT) AS pct_zero FROM rows GROUP BY method")
def describe(spark, sf_dir):
    return stats.describe(_rows(spark, sf_dir), ["method"], "bad").withColumn("std", F.round("std", 9))


@query(f"""WITH {_rows_sql}, s AS (SELECT method, count(*)::DOUBLE AS n, count(*) FILTER (WHERE bad = 0) AS k FROM rows GROUP BY method), t AS (SELECT method, n, k, k / n AS p, 1.96::DOUBLE AS z FROM s)
SELECT method, n::BIGINT AS n, k AS n_pass, p AS pass_rate, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 12) AS ci_low,
  round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 12) AS ci_high FROM t""")
def wilson_ci(spark, sf_dir):
    out = stats.pass_rates(_rows(spark, sf_dir), ["method"], F.col("bad") == 0)
    return out.withColumns({"ci_low": F.round("ci_low", 12), "ci_high": F.round("ci_high", 12)})


@query(f"""WITH {_rows_sql}, d AS (SELECT a.bad - b.bad AS d FROM rows a JOIN rows b ON a.vol_id = b.vol_id AND a.method = 'field' AND b.method = 'mean'),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM r) AS n_eff, coalesce((SELECT sum(r) FROM r WHERE d > 0), 0)::DOUBLE AS w""")
def wilcoxon_w(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    pick = lambda m, c: rows.filter(F.col("method") == m).select("vol_id", F.col("bad").cast("double").alias(c))
    pairs = pick("field", "x").join(pick("mean", "y"), "vol_id").withColumn("label", F.lit("bad"))
    return stats.signed_rank(pairs, ["label"]).select("n", "n_eff", "w")


@query(f"""WITH {_rows_sql}, d AS (SELECT 'bad' AS label, a.bad - b.bad AS d FROM rows a JOIN rows b ON a.vol_id = b.vol_id AND a.method = 'field' AND b.method = 'mean'
  UNION ALL SELECT 'bad_reversed', a.bad - b.bad FROM rows a JOIN rows b ON a.vol_id = b.vol_id AND a.method = 'mean' AND b.method = 'field'
  UNION ALL SELECT 'level', a.level - b.level FROM rows a JOIN rows b ON a.vol_id = b.vol_id AND a.method = 'field' AND b.method = 'mean'),
r AS (SELECT label, d, rank() OVER w + (count(*) OVER (PARTITION BY label, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY label, abs(d)) AS t FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY label ORDER BY abs(d))),
s AS (SELECT label, count(*) AS n FROM d GROUP BY label), e AS (SELECT label, count(*) AS n_eff, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS w, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY label)
SELECT label, n, coalesce(n_eff, 0) AS n_eff, coalesce(w, 0) AS w, coalesce((w - n_eff * (n_eff + 1) / 4.0) / sqrt(n_eff * (n_eff + 1) * (2 * n_eff + 1) / 24.0 - ties / 48) < -3.090232306167813::DOUBLE, false) AS significant FROM s LEFT JOIN e USING (label)""")
def wilcoxon_battery(spark, sf_dir):
    """Significant at one in a thousand, which is 3.09 standard deviations for these numbers of samples."""
    rows = _rows(spark, sf_dir).withColumnRenamed("vol_id", "sample")
    out = stats.battery(rows, [("bad", "bad", "field", "mean"), ("bad_reversed", "bad", "mean", "field"), ("level", "level", "field", "mean")])
    return out.select("label", "n", "n_eff", "w", "significant")


@query(f"""WITH {_rows_sql}, r AS (SELECT method, rank() OVER (ORDER BY bad) + (count(*) OVER (PARTITION BY bad) - 1) / 2.0 AS r FROM rows),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM rows GROUP BY bad)),
q AS (SELECT count(*) AS g, sum(m)::DOUBLE AS n, sum(s * s / m)::DOUBLE AS q FROM (SELECT sum(r)::DOUBLE AS s, count(*) AS m FROM r GROUP BY method))
SELECT g AS n_groups, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h FROM q, t""")
def kruskal_h(spark, sf_dir):
    return stats.kruskal(_rows(spark, sf_dir), "method", "bad").select("n_groups", "n", F.round("h", 6).alias("h"))


@query("SELECT event_type, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, bool_and(v = 0) AS all_zero, round(stddev_pop(v), 6) AS std FROM (SELECT event_type, user_id % 7 AS v FROM events) GROUP BY event_type")
def trial_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 7).alias("v"))
    return stats.trials(e, ["event_type"], "v").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT event_type AS method, count(*) AS n, round(avg(t), 3) AS mean, round(stddev_samp(t), 3) AS std, round(min(t), 6) AS min, round(max(t), 3) AS max FROM (SELECT event_type, CASE WHEN value > 0 AND user_id % 9 > 0 THEN 225::DOUBLE / value ELSE 0 END AS t FROM events) GROUP BY event_type")
def tips(spark, sf_dir):
    """Cells a second as if each event's value were the seconds of one 8x8 image, guaranteed for eight users in nine."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("method"), scalar.tips(F.lit(8), F.lit(8), F.lit(1), F.col("value"), F.col("user_id") % 9 > 0).alias("tips"))
    out = stats.spread_of(rows, ["method"], "tips")
    return out.withColumns({"mean": F.round("mean", 3), "std": F.round("std", 3), "min": F.round("min", 6), "max": F.round("max", 3)})


@query("SELECT l_orderkey AS k, CASE WHEN v > 0 THEN format('{:.2f}×10^{}', v / pow(10, e), e) ELSE '0' END AS s FROM (SELECT l_orderkey, v, floor(log10(v))::INT AS e FROM (SELECT l_orderkey, sum(l_quantity)::DOUBLE * 37.137::DOUBLE AS v FROM lineitem GROUP BY l_orderkey))")
def tips_format(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum("l_quantity").cast("double") * 37.137).alias("v"))
    return t.select("k", scalar.scientific(F.col("v")).alias("s"))


@query("SELECT o_orderkey, round_even(a / nullif(b, 0), 2) AS speedup FROM (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS a, min(l_extendedprice) AS b FROM lineitem GROUP BY l_orderkey)")
def speedup(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("a"), F.min("l_extendedprice").alias("b"))
    return t.select("o_orderkey", scalar.speedup(F.col("a"), F.col("b")).alias("speedup"))


@query("""SELECT l_linenumber AS eps, count(DISTINCT l_suppkey) AS n_subjects, round(avg(l_quantity), 9) AS viol_mean, round(sqrt(sum((l_quantity - m) ** 2) / (count(*) - 1)), 6) AS viol_std, min(l_quantity) AS viol_min, max(l_quantity) AS viol_max, avg((l_quantity = 0)::INT) AS pass_rate,
round(avg(r), 9) AS rounds_mean, round(sqrt(sum((r - n) ** 2) / (count(*) - 1)), 6) AS rounds_std, min(r) AS rounds_min, max(r) AS rounds_max FROM (SELECT *, l_orderkey % 5 AS r, avg(l_quantity) OVER w AS m, avg(l_orderkey % 5) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)) GROUP BY l_linenumber""")
def eps_summary(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("eps"), F.col("l_suppkey").alias("subject"), F.col("l_quantity").alias("violations"), (F.col("l_orderkey") % 5).alias("rounds"))
    return stats.per_epsilon(t).withColumns({c: F.round(c, 9 if "mean" in c else 6) for c in ("viol_mean", "rounds_mean", "viol_std", "rounds_std")})


@query("SELECT l_linenumber AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def mode_default(spark, sf_dir):
    return stats.mode(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_linenumber")


#: K, delta and eps; the volumes have 4 planes, so that larger K would be these again.
EPS_GRID = [(k, delta, eps) for k in (2, 4) for delta in (1, 2) for eps in (0.1, 0.5, 1.0, 2.0)]


@query()
def eps_sweep(spark, sf_dir):
    """Injection rounds over the volumes for each number of slabs, halo and tolerance, summed by these."""
    return stats.per_epsilon(experiments.sweep(emb(spark, sf_dir, 3), "v", EPS_GRID, small=True), ("K", "delta", "eps"))


# --- relational glue


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_antijoin(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"))
    return experiments.still_to_do(wanted, done, ["key"]).agg(F.count("*").alias("n"), F.sum("key").alias("total"))


@query("SELECT k, delta, eps, n_nationkey AS subject FROM (VALUES (2), (4), (8), (16)) a(k), (VALUES (1), (2)) b(delta), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) c(eps), nation")
def config_grid(spark, sf_dir):
    subjects = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("subject"))
    return subjects.crossJoin(F.broadcast(experiments.grid(spark, k=[2, 4, 8, 16], delta=[1, 2], eps=[0.1, 0.5, 1.0, 2.0]))).select(F.col("k").cast("int").alias("k"), F.col("delta").cast("int").alias("delta"), "eps", "subject")


@query(f"WITH {_rows_sql} SELECT count(*) AS n, max(abs(a.bad - b.bad)) AS bad_max_diff FROM rows a JOIN rows b ON a.vol_id = b.vol_id AND a.method = 'field' AND b.method = 'mean'")
def paired_methods(spark, sf_dir):
    return stats.paired(_rows(spark, sf_dir), "vol_id", "method", "field", "mean", ["bad"])


@query(f"WITH {volumes(2)} SELECT vol_id, arg_min(v, abs(v - 100) * 1000 - v) AS level FROM (SELECT DISTINCT vol_id, v FROM vox) GROUP BY vol_id")
def nearest_level(spark, sf_dir):
    """The level that waits nearest to 100, the upper of two."""
    return propagate.nearest_level(emb(spark, sf_dir, 2), 100)


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS comment FROM customer UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier")
def union_missing_cols(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("s").alias("comment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT source AS subject, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, lang, doc_id) AS r FROM documents WHERE lang <> 'es') WHERE r = 1")
def first_pattern(spark, sf_dir):
    """One file of each subject by the first pattern that it matches, then by path; no pattern matches ``es``."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select(F.col("source").alias("subject"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return volume_files.resolved(files, ["^en/", "^fr/", "^de/"]).select("subject", "path")


@query("SELECT event_type, x, y, count(*)::INT AS v FROM (SELECT event_type, user_id AS x, hour(ts) AS y FROM events) GROUP BY ALL")
def event_raster(spark, sf_dir):
    images = raster.event_images(spark, sf_dir).filter("v > 0").join(F.broadcast(raster.event_types(spark, sf_dir)), "vol_id")
    return images.select("event_type", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v")


@query("SELECT (l_quantity - 1)::INT AS x, round(l_discount * 100)::INT AS y, round(l_tax * 100)::INT AS z, count(*)::INT AS v FROM lineitem GROUP BY ALL")
def line_item_cube(spark, sf_dir):
    return raster.line_items(spark, sf_dir).filter("v > 0").select("x", "y", "z", "v")


# --- further operators


@query("SELECT c_custkey AS key FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 40")
def sampled_subjects(spark, sf_dir):
    """Forty subjects without replacement: the limit is the operator."""
    return labels.sampled(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key")), "key", 40)


@query(f"""WITH {volumes(2)}, r AS (SELECT vol_id, x, y, CASE WHEN v % 50 = 0 THEN NULL ELSE v END AS v FROM vox WHERE v % 40 > 0 UNION ALL SELECT vol_id, x + 5, y, v FROM vox WHERE v % 30 = 0),
p AS (SELECT vol_id, x, y, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls FROM r GROUP BY ALL)
SELECT vol_id, sum(n)::BIGINT AS n_rows, 64::BIGINT AS n_wanted, coalesce(sum(n) FILTER (WHERE x > 7), 0)::BIGINT AS n_outside, count(*) FILTER (WHERE n > 1) AS n_twice, sum(nulls)::BIGINT AS n_null,
  sum(n) = 64 AND coalesce(sum(n) FILTER (WHERE x > 7), 0) = 0 AND count(*) FILTER (WHERE n > 1) = 0 AND sum(nulls) = 0 AS ok FROM p GROUP BY vol_id""")
def shape_checks(spark, sf_dir):
    """Images with voxels left out, put beside their place, or without a level."""
    voxels = emb(spark, sf_dir, 2)
    some = voxels.filter("v % 40 > 0").withColumn("v", F.when(F.col("v") % 50 == 0, None).otherwise(F.col("v")))
    return verify.shape_checks(some.unionByName(voxels.filter("v % 30 = 0").withColumn("x", F.col("x") + 5)))


_open = "SELECT vol_id, ex, ey, lo, hi, CASE WHEN (ex + ey) % 3 = 0 THEN hi END AS u FROM cells"


@query(f"""WITH {volumes(2)}, f AS ({_open}), n AS (SELECT a.vol_id, a.ex, a.ey, greatest(a.lo, least(b.u, a.hi)) AS s, b.u FROM f a JOIN f b ON a.vol_id = b.vol_id AND abs(a.ex - b.ex) + abs(a.ey - b.ey) = 1 AND b.u IS NOT NULL),
best AS (SELECT vol_id, ex, ey, arg_min(s, abs(s - u) * 1000 + s) AS s FROM n GROUP BY ALL) SELECT vol_id, ex, ey, coalesce(u, s, lo)::INT AS u FROM f LEFT JOIN best USING (vol_id, ex, ey)""")
def gap_fill(spark, sf_dir):
    """Fields with two cells of three open, filled from their neighbours in one round, then from below."""
    cells = interpolate.interval_span(emb(spark, sf_dir, 2)).withColumn("u", F.when((F.col("ex") + F.col("ey")) % 3 == 0, F.col("hi")))
    return propagate.gap_filled(cells, dealt=("vol_id",)).select("vol_id", "ex", "ey", "u")


_deep = "SELECT vol_id, ex, ey, lo, hi, CASE WHEN (ex + ey) % 9 = 0 AND vol_id % 7 > 0 THEN hi END AS u FROM cells"
_clip = "greatest(lo[i], least(n, hi[i]))"
_around = ", ".join(f"CASE WHEN {there} THEN s[{j}] END" for there, j in (("i > 15", "i - 15"), ("i <= 210", "i + 15"), ("(i - 1) % 15 > 0", "i - 1"), ("(i - 1) % 15 < 14", "i + 1")))


@query(f"""WITH RECURSIVE {volumes(2)}, f AS ({_deep}), start AS (SELECT vol_id, list(lo ORDER BY ex, ey) AS lo, list(hi ORDER BY ex, ey) AS hi, list(u ORDER BY ex, ey) AS s FROM f GROUP BY vol_id),
fill AS (SELECT vol_id, lo, hi, s, 0 AS step FROM start UNION ALL SELECT vol_id, lo, hi, t, step + 1 FROM (
  SELECT vol_id, lo, hi, s, step, list_transform(s, lambda v, i: coalesce(v, list_min(list_transform(list_filter([{_around}], lambda n: n IS NOT NULL), lambda n: abs({_clip} - n) * 1000 + {_clip})) % 1000)) AS t FROM fill) WHERE t IS DISTINCT FROM s)
SELECT vol_id, (i // 15)::INT AS ex, (i % 15)::INT AS ey, coalesce(s[i + 1], lo[i + 1])::INT AS u FROM (SELECT vol_id, any_value(lo) AS lo, arg_max(s, step) AS s FROM fill GROUP BY vol_id), range(225) t(i)""")
def gap_fill_deep(spark, sf_dir):
    """Fields with holes several cells deep, filled until nothing changes; a volume of seven has nothing to fill from."""
    cells = interpolate.interval_span(emb(spark, sf_dir, 2)).withColumn("u", F.when(((F.col("ex") + F.col("ey")) % 9 == 0) & (F.col("vol_id") % 7 > 0), F.col("hi")))
    return propagate.gap_filled(cells, None, ("vol_id",)).select("vol_id", "ex", "ey", "u")


def sweep_sql(start: str) -> str:
    """SQL of CTEs ``sweep_front`` and ``swept``: a step of the rising sweep in each round; u null where it does not come."""
    near = " OR ".join(f"({there} AND s[{j}] >= 0)" for there, j in (("(i - 1) // 49 > 0", "i - 49"), ("(i - 1) // 49 < 6", "i + 49"), ("(i - 1) // 7 % 7 > 0", "i - 7"), ("(i - 1) // 7 % 7 < 6", "i + 7"), ("(i - 1) % 7 > 0", "i - 1"), ("(i - 1) % 7 < 6", "i + 1")))
    return f"""sweep_front AS (SELECT k, l, lo, hi, rim, list_transform(lo, lambda v: -1) AS s, 0 AS step FROM ({start})
  UNION ALL SELECT k, CASE WHEN n = s THEN l + 1 ELSE l END, lo, hi, rim, n, step + 1 FROM (SELECT k, l, lo, hi, rim, s, step, list_transform(s, lambda v, i: CASE WHEN v < 0 AND greatest(lo[i], least(l, hi[i])) = l AND (rim[i] OR {near}) THEN l ELSE v END) AS n FROM sweep_front WHERE l <= 255)),
swept AS (SELECT k AS vol_id, i // 49 AS ex, i // 7 % 7 AS ey, i % 7 AS ez, nullif(s[i + 1], -1) AS u FROM (SELECT k, arg_max(s, step) AS s FROM sweep_front GROUP BY k), range(343) t(i))"""


_rim_lists = "SELECT vol_id AS k, 0 AS l, list(lo ORDER BY ex, ey, ez) AS lo, list(hi ORDER BY ex, ey, ez) AS hi, list(least(ex, ey, ez) = 0 OR greatest(ex, ey, ez) = 6 ORDER BY ex, ey, ez) AS rim FROM cells GROUP BY vol_id"


@query(f"WITH RECURSIVE {volumes(3)}, {sweep_sql(_rim_lists)} SELECT vol_id, count(u) AS n_reached, coalesce(sum(u), 0)::BIGINT AS total, coalesce(sum(u * (ex + 7 * ey + 49 * ez + 1)), 0)::BIGINT AS placed FROM swept GROUP BY vol_id")
def ascending_sweep(spark, sf_dir):
    """One sweep over rising levels: the cells that it reaches and their levels by place."""
    field = propagate.propagated(emb(spark, sf_dir, 3), "zero", ascending=True)
    place = F.col("ex") + 7 * F.col("ey") + 49 * F.col("ez") + 1
    return field.groupBy("vol_id").agg(F.count("u").alias("n_reached"), F.coalesce(F.sum("u"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("u") * place), F.lit(0)).alias("placed"))


@query(f"WITH {volumes(3)}, lab AS (SELECT vol_id, x, y, z, v // 64 AS v FROM vox) SELECT a.vol_id, a.x, a.y, a.z, bool_or(a.v <> b.v) AS m FROM lab a JOIN lab b ON a.vol_id = b.vol_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY ALL")
def membrane3d(spark, sf_dir):
    return labels.membrane(emb(spark, sf_dir, 3).withColumn("v", F.floor(F.col("v") / 64).cast("int"))).select("vol_id", "x", "y", "z", "m")


@query(f"WITH {volumes(2)} SELECT vol_id, 1 AS w, 8 AS h, 8 AS d, 0 AS x, x AS y, y AS z, v FROM vox")
def transposed_axes(spark, sf_dir):
    return labels.transposed(emb(spark, sf_dir, 2), ("z", "x", "y")).select("vol_id", "w", "h", "d", "x", "y", "z", "v")


@query(f"WITH {volumes(2)} SELECT vol_id, count(*) FILTER (WHERE v > 190) AS n_on FROM vox GROUP BY vol_id HAVING count(*) FILTER (WHERE v > 190) > 0")
def empty_gate(spark, sf_dir):
    return labels.not_empty(interpolate.thresholded(emb(spark, sf_dir, 2), 190))


@query(f"""WITH {volumes(2)}, c AS (SELECT vec_id AS vol_id, a.range AS attempt, ((vec_id + a.range) % 5)::INT AS x0, ((vec_id * 3 + a.range) % 5)::INT AS y0 FROM embeddings, range(6) a),
r AS (SELECT vol_id, attempt, x0, y0, avg((v > 150)::INT) AS fg_rate FROM vox JOIN c USING (vol_id) WHERE x BETWEEN x0 AND x0 + 3 AND y BETWEEN y0 AND y0 + 3 GROUP BY ALL) SELECT * FROM r WHERE fg_rate BETWEEN 0.01 AND 0.30 ORDER BY vol_id, attempt LIMIT 200""")
def accepted_patches(spark, sf_dir):
    """The first two hundred patches with a fitting share of mask voxels: the limit is the operator."""
    masks = interpolate.thresholded(emb(spark, sf_dir, 2), 150)
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vol_id"))
    tries = ids.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("vol_id", F.col("attempt").cast("long").alias("attempt"), ((F.col("vol_id") + F.col("attempt")) % 5).cast("int").alias("x0"), ((F.col("vol_id") * 3 + F.col("attempt")) % 5).cast("int").alias("y0"), F.lit(0).alias("z0"))
    return labels.patches(masks, tries, (4, 4, 1), 200).select("vol_id", "attempt", "x0", "y0", "fg_rate")


@query(f"WITH {volumes(2)} SELECT 'field_zero' AS method, vol_id, sum(greatest(lo, least(0, hi)))::DOUBLE AS total FROM cells GROUP BY vol_id UNION ALL SELECT 'linear', vol_id, sum(mean)::DOUBLE FROM cells GROUP BY vol_id UNION ALL SELECT 'zoomed', vol_id, sum(greatest(90.0, least(mean, 140.0)))::DOUBLE FROM cells GROUP BY vol_id")
def methods_by_name(spark, sf_dir):
    """Methods from the registry, one of them of one's own."""
    interpolate.register("zoomed", lambda v: interpolate.zoomed(v, 1, 90, 140))
    voxels, parts = emb(spark, sf_dir, 2), None
    for name in ("field_zero", "linear", "zoomed"):
        one = interpolate.method(name)(voxels).groupBy("vol_id").agg(F.sum(F.col("u").cast("double")).alias("total")).select(F.lit(name).alias("method"), "vol_id", "total")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query(f"WITH RECURSIVE {volumes(2)}, {_mean}, {counts_sql('f')} SELECT k AS vol_id, thr, b0_low AS b0, greatest(0, b0_low - chi) AS b1 FROM counted")
def betti2d(spark, sf_dir):
    return topology.betti(_mean_counts(spark, sf_dir), flat=True).select("vol_id", "thr", "b0", "b1")


_cube6 = [(d if a == 0 else 0, d if a == 1 else 0, d if a == 2 else 0) for a in range(3) for d in (-1, 1)]
_cube26 = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def labelled3(name: str, masks: str, steps: list[tuple[int, int, int]]) -> str:
    """``labelled`` for masks of 7 x 7 x 7."""
    near = []
    for step in steps:
        inside = []
        for d, v in zip(step, ("(i - 1) // 49", "(i - 1) // 7 % 7", "(i - 1) % 7"), strict=True):
            inside += [f"{v} > 0"] if d < 0 else [f"{v} < 6"] if d > 0 else []
        near.append(f"CASE WHEN {' AND '.join(inside)} THEN l[i + {49 * step[0] + 7 * step[1] + step[2]}] END")
    return labelled(name, masks, []).replace("[v, l[v], ]", f"[v, l[v], {', '.join(near)}]")


@query(f"""WITH RECURSIVE {volumes(3)}, f AS (SELECT vol_id AS k, ex, ey, ez, mean / 255 AS u FROM cells), thrs AS (SELECT t + 1 AS i, (30 + 5 * t) / 100.0::DOUBLE AS thr FROM range(9) r(t)),
over AS (SELECT k * 16 + i AS vol_id, ex, ey, ez FROM f JOIN thrs ON u >= thr), marked AS (SELECT k * 16 + i AS k, list(u >= thr ORDER BY ex, ey, ez) AS m FROM f, thrs GROUP BY ALL),
{labelled3('low', 'marked', _cube6)}, {labelled3('high', 'marked', _cube26)}, parts AS ({_chi(3, ('ex', 'ey', 'ez'), 'over')}), chis AS (SELECT vol_id AS k, sum(s)::BIGINT AS chi FROM parts GROUP BY vol_id),
counted AS (SELECT low.k // 16 AS k, thr, low.b0 AS b0_low, high.b0 AS b0_high, coalesce(chi, 0) AS chi FROM low JOIN high USING (k) LEFT JOIN chis USING (k) JOIN thrs ON low.k % 16 = i),
on_voxels AS (SELECT * FROM vox WHERE v > 127), ref_parts AS ({_chi(3, ('x', 'y', 'z'), 'on_voxels')}), ref AS (SELECT vol_id, sum(s)::BIGINT AS ref_chi FROM ref_parts GROUP BY vol_id),
tsis AS (SELECT k, round(stddev_pop(b0_high), 9) AS tsi FROM counted GROUP BY k), twos AS (SELECT k, bool_and(u IN (0, 1))::INT AS is_binary FROM f GROUP BY k),
every AS (SELECT k AS vol_id, 'linear' AS method, b0_low, b0_high, chi, coalesce(ref_chi, 0) AS ref_chi, tsi, is_binary FROM counted JOIN tsis USING (k) JOIN twos USING (k) LEFT JOIN ref ON ref.vol_id = k WHERE thr = 0.5)
SELECT *, {_cross}, b0_low AS b0, -1::BIGINT AS b1 FROM every""")
def topology3d(spark, sf_dir):
    """Every topology metric of volumes' mean fields under 6- and 26-adjacency."""
    voxels = emb(spark, sf_dir, 3)
    field = interpolate.linear(voxels).withColumn("u", F.col("u") / 255).withColumn("method", F.lit("linear"))
    ref = topology.euler_in_blocks(voxels.withColumn("on", F.col("v") > 127), ["vol_id"], ("x", "y", "z")).withColumnRenamed("chi", "ref_chi")
    return topology.betti(topology.bundle(field, ref, 0.5, NINE)).withColumn("tsi", F.round("tsi", 9))


def _slab_rows_sql(delta: int) -> str:
    return f"""SELECT vol_id, 2 AS "K", {delta} AS delta, rounds, bdry_violations, bdry_violations = 0 AS dwc_ok, 2 AS "D_sub", 1 AS sigma_cover, width::DOUBLE AS plane_width_med, width::DOUBLE AS plane_width_max, {50.0 * delta}::DOUBLE AS rho_pct
FROM ({_ibi_sql(2, delta)}) JOIN (WITH {volumes(3)} SELECT vol_id, max(hi - lo) AS width FROM cells WHERE ez = 4 GROUP BY vol_id) USING (vol_id)"""


@query(_slab_rows_sql(1))
def slab_rows(spark, sf_dir):
    """Rounds, violations, widths and shares of each volume in two slabs."""
    return experiments.slab_rows(checkpointed(emb(spark, sf_dir, 3), "volumes"), 2, 1, 3, True)


@query(f"""WITH r AS ({_slab_rows_sql(1)} UNION ALL {_slab_rows_sql(2)}), s AS (SELECT "K", delta, count(*) AS n, count(*) FILTER (WHERE dwc_ok) AS n_pass, median("D_sub") AS "D_sub_median", median(sigma_cover) AS sigma_cover_median,
  median(rho_pct) AS rho_pct_median, median(plane_width_med) AS plane_width_med_median FROM r GROUP BY ALL), t AS (SELECT *, n_pass / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM s)
SELECT * EXCLUDE (p, z), round(100 * greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 0), 9) AS ci_low_pct,
  round(100 * least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 1), 9) AS ci_high_pct, "D_sub_median" < 30 AS thin, delta / "D_sub_median" < 0.10 AS narrow, ("D_sub_median" < 30) <> (n_pass = n) AS thin_right FROM t""")
def slab_table(spark, sf_dir):
    voxels = checkpointed(emb(spark, sf_dir, 3), "volumes")
    rows = experiments.slab_rows(voxels, 2, 1, 3, True).unionByName(experiments.slab_rows(voxels, 2, 2, 3, True))
    return stats.slab_table(rows).withColumns({c: F.round(c, 9) for c in ("ci_low_pct", "ci_high_pct")})


@query(f"WITH RECURSIVE {volumes(3)}, {rounds_sql(2, 1, 1, 3, 1, True)} SELECT vol_id, sum(u)::BIGINT AS total, sum(u * (ex + 7 * ey + 49 * ez + 1))::BIGINT AS placed, any_value(rounds) AS rounds FROM f JOIN took USING (vol_id) GROUP BY vol_id")
def ibi_one_plane(spark, sf_dir):
    """Rounds in which a bound's plane belongs to the slab before it and is the only pin from below."""
    field, took = decompose.inject_each(emb(spark, sf_dir, 3), 2, 1, max_rounds=3, shift=1, one_plane=True, small=True)
    place = F.col("ex") + 7 * F.col("ey") + 49 * F.col("ez") + 1
    return field.groupBy("vol_id").agg(F.sum("u").alias("total"), F.sum(F.col("u") * place).alias("placed")).join(took.drop("converged"), "vol_id")


@query(f"WITH RECURSIVE {volumes(3)}, {rounds_sql(2, 2, 1, 1, 2)} SELECT vol_id, ex, ey, ez, u FROM f0")
def ibi_three_planes(spark, sf_dir):
    """Slabs by themselves, three planes about a bound from one slab."""
    voxels = emb(spark, sf_dir, 3)
    return decompose.round_zero(voxels, decompose.slabs(voxels, 2, 2), shift=2).select("vol_id", "ex", "ey", "ez", "u")
