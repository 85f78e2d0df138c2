import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions import scalar
from voxelry.operators import stats


def test_signed_rank_against_enumeration(spark):
    d = [-3.0, 1.0, -2.0, -5.0, 4.0, -6.0, 0.0]
    df = spark.createDataFrame([(0, x, 0.0) for x in d], "k int, x double, y double")
    row = stats.signed_rank(df, ["k"], alpha=0.2).first()
    ranks = [3, 1, 2, 5, 4, 6]
    w = 1 + 4
    below = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= w for signs in itertools.product((0, 1), repeat=6))
    assert (row.n, row.n_eff, row.w) == (7, 6, w) and math.isclose(row.p, below / 64)


def test_signed_rank_ties_and_nothing_left(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 2.0), (0, 3.0, 1.0), (1, 5.0, 5.0)], "k int, x double, y double")
    rows = {r.k: r for r in stats.signed_rank(df, ["k"]).collect()}
    assert rows[0].w == 3.0 and rows[1].n_eff == 0 and rows[1].p == 1.0


def test_kruskal(spark):
    groups = {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "c": [9, 10, 11, 12]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    row = stats.kruskal(df, "g", "v").first()
    assert math.isclose(row.h, 12 / (12 * 13) * (100 / 4 + 26**2 / 4 + 42**2 / 4) - 39) and math.isclose(row.p, math.exp(-row.h / 2))
    same = stats.kruskal(df.withColumn("v", F.lit(1.0)), "g", "v").first()
    assert same.h == 0 and same.p == 1
    assert stats.kruskal(df.filter("g = 'a'"), "g", "v").first().h is None


@pytest.mark.parametrize("x, k, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2_tail(x, k, p):
    assert math.isclose(stats.chi2_tail(x, k), p, rel_tol=1e-9)


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 0), (10, 10)], "k int, n int")
    low, high = scalar.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("a"), high.alias("b")).collect()
    assert np.allclose(rows[0], (0.4901625, 0.9433178), atol=1e-6) and tuple(rows[1]) == (0, 0) and rows[2].b == 1


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 4), ("b", 1)], "m string, x int")
    rows = {r.m: r for r in stats.summary(df, ["m"], ["x"]).collect()}
    assert rows["a"].x_median == 2 and math.isclose(rows["a"].x_std, np.std([0, 2, 4])) and math.isclose(rows["a"].x_pct_zero, 100 / 3)
    assert {r.m: r.std for r in stats.describe(df, ["m"], "x").collect()} == {"a": 2.0, "b": 0.0}
    assert stats.mode(spark.createDataFrame([(2,), (1,), (2,), (1,)], "x int"), "x").first().mode == 1
    assert stats.pass_rates(df, ["m"], F.col("x") == 0, F.col("x") > 1).filter("m = 'a'").first().n_fired == 2


def test_tips_and_speedup(spark):
    row = spark.range(1).select(scalar.tips(F.lit(2), F.lit(2), F.lit(2), F.lit(0.5), F.lit(True)).alias("t"), scalar.tips(F.lit(2), F.lit(2), F.lit(2), F.lit(0.5), F.lit(False)).alias("z"), scalar.speedup(F.lit(1.0), F.lit(0.0)).alias("n"), scalar.scientific(F.lit(12345.0)).alias("s")).first()
    assert row.t == 54 and row.z == 0 and row.n is None and row.s == "1.23×10^4"


def test_battery_pairs_by_sample(spark):
    rows = [(i, m, float(i) if m == "a" else i + 1.0) for i in range(20) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "sample int, method string, v double")
    out = {r.label: r for r in stats.battery(df, [("less", "v", "a", "b"), ("more", "v", "b", "a")]).collect()}
    assert out["less"].significant and not out["more"].significant
    assert stats.paired(df, "sample", "method", "a", "b", ["v"]).first().v_max_diff == 1


def test_average_ranks_over_bins(spark):
    rng = np.random.default_rng(5)
    few, wide = rng.integers(-3, 4, 200).astype(float), np.exp(rng.normal(0, 40, 200)) * rng.choice([-1, 1], 200)
    values = [*few, *wide, *(100 + rng.random(200)), -0.0, math.inf, -math.inf, math.inf, math.nan, 5e-324, -5e-324]
    rows = [(k, float(v)) for k in (0, 1) for v in values[k * 150 :]]
    got = stats.average_ranks(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v")).collect()
    assert len(got) == len(rows)
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    own = {k: [order(v) for j, v in rows if j == k] for k in (0, 1)}
    for r in got:
        below, ties = (sum(f(v) for v in own[r.k]) for f in (lambda v, x=order(r.v): v < x, lambda v, x=order(r.v): v == x))
        assert r.ties == ties and r["rank"] == below + (ties + 1) / 2
    every = stats.average_ranks(spark.createDataFrame([(2.0,), (1.0,), (2.0,)], "v double"), [], F.col("v")).collect()
    assert sorted((r.v, r["rank"]) for r in every) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5)]
