"""Summaries of result rows and rank tests, by any keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voxelry.functions.scalar import wilson


def summary(rows: DataFrame, keys: list[str], metrics: list[str], flips: str | None = None) -> DataFrame:
    """n, and for each metric mean, min, max, population std, median and share of zeros in percent; sum of ``flips``."""
    out = [F.count("*").alias("n")]
    for m in metrics:
        c = F.col(m)
        out += [F.avg(c).alias(f"{m}_mean"), F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max"), F.stddev_pop(c).alias(f"{m}_std"), F.median(c).alias(f"{m}_median"), (100 * F.avg((c == 0).cast("int"))).alias(f"{m}_pct_zero")]
    if flips:
        out.append(F.sum(flips).alias("flips"))
    return rows.groupBy(*keys).agg(*out)


def describe(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """n, mean, sample std, min, max and share of zeros in percent."""
    c = F.col(metric)
    return rows.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), (100 * F.avg((c == 0).cast("int"))).alias("pct_zero"))


def pass_rates(rows: DataFrame, keys: list[str], passed: Column, rule: Column | None = None) -> DataFrame:
    """Passes of n with their Wilson interval; with a ``rule``, how often it fired and agreed with the outcome."""
    out = [F.count("*").alias("n"), F.count_if(passed).alias("n_pass")]
    if rule is not None:
        out += [F.count_if(rule).alias("n_fired"), F.avg((rule != passed).cast("int")).alias("rule_accuracy")]
    found = rows.groupBy(*keys).agg(*out)
    low, high = wilson(F.col("n_pass"), F.col("n"))
    return found.withColumns({"pass_rate": F.col("n_pass") / F.col("n"), "ci_low": low, "ci_high": high})


def trials(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean, population std, min and max over trials, and whether all are 0."""
    c = F.col(metric)
    return rows.groupBy(*keys).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.bool_and(c == 0).alias("all_zero"))


def spread_of(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """n, mean, sample std (0 for one row), min and max, such as of cells a second by method."""
    c = F.col(metric)
    return rows.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def slab_table(rows: DataFrame, least_depth: int = 30, least_share: float = 0.10) -> DataFrame:
    """By K and delta, over rows of ``experiments.slab_rows``: passes with their interval, medians, and two rules: slabs
    thinner than ``least_depth`` planes, and a halo below ``least_share`` of a slab; ``thin_right``: whether the first rule
    warns just where not all pass."""
    medians = [F.median(c).alias(f"{c}_median") for c in ("D_sub", "sigma_cover", "rho_pct", "plane_width_med")]
    out = rows.groupBy("K", "delta").agg(F.count("*").alias("n"), F.count_if("dwc_ok").alias("n_pass"), *medians)
    low, high = wilson(F.col("n_pass"), F.col("n"))
    thin, narrow = F.col("D_sub_median") < least_depth, F.col("delta") / F.greatest(F.col("D_sub_median"), F.lit(1.0)) < least_share
    return out.withColumns({"ci_low_pct": 100 * low, "ci_high_pct": 100 * high, "thin": thin, "narrow": narrow, "thin_right": thin != (F.col("n_pass") == F.col("n"))})


def rule_accuracy(table: DataFrame) -> DataFrame:
    """Of rows of ``slab_table``: n_right and n, how often the rule of thin slabs told whether all pass."""
    return table.agg(F.count_if("thin_right").alias("n_right"), F.count("*").alias("n"))


def per_epsilon(records: DataFrame, keys: list[str] = ("eps",)) -> DataFrame:
    """Violations and rounds by tolerance, with sample stds (0 for one row) and the share of runs without violations."""
    v, r = F.col("violations"), F.col("rounds")
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return records.groupBy(*keys).agg(
        F.count_distinct("subject").alias("n_subjects"), F.avg(v).alias("viol_mean"), std(v).alias("viol_std"), F.min(v).alias("viol_min"), F.max(v).alias("viol_max"),
        F.avg((v == 0).cast("int")).alias("pass_rate"), F.avg(r).alias("rounds_mean"), std(r).alias("rounds_std"), F.min(r).alias("rounds_min"), F.max(r).alias("rounds_max"))


def mode(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of several."""
    return rows.agg(F.mode(column, True).alias("mode"))


def octave_bin(value: Column, parts: int = 4096) -> Column:
    """A number that never falls as the value rises: ``parts`` bins for each doubling of its size, 0 for 0."""
    x = value.cast("double")
    size = F.floor((F.least(F.log2(F.abs(x)), F.lit(1025.0)) + 1076) * parts) + 1
    return F.coalesce(F.signum(x) * size, F.lit(0.0))


def average_ranks(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Add ``rank``, the mean rank of ties within the keys, and ``ties``, how many share it.

    Ranks come from counts by value: those of a bin of neighbouring values are summed in a window of their own, and one
    window for each key, with a row for each bin, adds what lies below. So the distinct values of a key, however many,
    are spread over tasks unless they all lie in few bins. The counts go back to the rows by a join.
    """
    rows = rows.withColumn("_value", value)
    by = rows.groupBy(*keys, "_value").agg(F.count("*").alias("ties")).withColumn("_bin", octave_bin(F.col("_value")))
    before = lambda n, within, at: F.coalesce(F.sum(n).over(Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = by.groupBy(*keys, "_bin").agg(F.sum("ties").alias("_n")).withColumn("_below", before("_n", keys, "_bin")).drop("_n")
    by = by.join(bins, [*keys, "_bin"]).withColumn("rank", F.col("_below") + before("ties", [*keys, "_bin"], "_value") + (F.col("ties") + 1) / 2)
    return rows.join(by.drop("_bin", "_below"), [*keys, "_value"]).drop("_value")


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def signed_rank_p(n: int, w: float, tie_sum: float) -> float:
    """One-sided p of a signed-rank sum as small as w (less): exact for n up to 50 without ties, else normal."""
    if n == 0:
        return 1.0
    if n <= 50 and tie_sum == 0 and float(w).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return float(ways[: int(w) + 1].sum() / 2.0**n)
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    return normal_tail(-(w - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by the series and continued fraction of the incomplete gamma."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def signed_rank(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", alpha: float = 0.001) -> DataFrame:
    """Wilcoxon signed-rank test of x < y by keys: n, n_eff, w (positive ranks), p and whether p < alpha.

    Differences of 0 are dropped; where all are, n_eff is 0, w 0 and p 1. The p-value is a function of three numbers a
    group, computed on the aggregated rows alone.
    """
    d = pairs.withColumn("_d", F.col(x) - F.col(y)).filter("_d is not null")
    ranked = average_ranks(d.filter("_d <> 0"), keys, F.abs("_d"))
    w = ranked.groupBy(*keys).agg(F.count("*").alias("n_eff"), F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_sum"))
    every = d.groupBy(*keys).agg(F.count("*").alias("n"))
    out = every.join(w, keys, "left") if keys else every.crossJoin(w)
    out = out.na.fill({"n_eff": 0, "w": 0.0, "tie_sum": 0.0})
    p = F.udf(lambda n, w, t: signed_rank_p(int(n), float(w), float(t)), DoubleType())  # a row for each key
    return out.withColumn("p", p("n_eff", "w", "tie_sum")).withColumn("significant", F.col("p") < alpha).drop("tie_sum")


def kruskal(rows: DataFrame, group: str, value: str, keys: list[str] = ()) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups, by keys: groups, n, h and p; identical values give 0 and 1,
    fewer than two groups give nulls."""
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    by = ["_all", *keys]
    ranked = average_ranks(rows, by, F.col(value))
    sums = ranked.groupBy(*by, group).agg(F.count("*").alias("m"), F.sum("rank").alias("r"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("t"))
    total = sums.groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("m").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.sum("t").alias("t"))
    n = F.col("n").cast("double")
    fix = 1 - F.col("t") / F.nullif(n * n * n - n, F.lit(0.0))
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    h = F.when(F.col("n_groups") < 2, None).when(fix <= 1e-12, 0.0).otherwise(raw / fix)
    tail = F.udf(lambda h, k: None if h is None else chi2_tail(h, k), DoubleType())  # a row for each key
    return total.withColumn("h", h).withColumn("p", tail("h", (F.col("n_groups") - 1).cast("int"))).select(*keys, "n_groups", "n", "h", "p")


def paired(rows: DataFrame, sample: str, method: str, one: str, two: str, metrics: list[str]) -> DataFrame:
    """Greatest difference of each metric between two methods, paired by sample."""
    pick = lambda name, tag: rows.filter(F.col(method) == name).select(sample, *[F.col(m).alias(f"{m}_{tag}") for m in metrics])
    both = pick(one, "a").join(pick(two, "b"), sample)
    return both.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(f"{m}_a") - F.col(f"{m}_b"))).alias(f"{m}_max_diff") for m in metrics])


def battery(rows: DataFrame, tests: list[tuple[str, str, str, str]], sample: str = "sample", method: str = "method", alpha: float = 0.001) -> DataFrame:
    """Signed-rank tests (label, metric, method x, method y), each one-sided for x < y, in one job."""
    parts = None
    for name, metric, x, y in tests:
        wide = rows.filter(F.col(method).isin(x, y)).groupBy(sample).agg(F.max(F.when(F.col(method) == x, F.col(metric))).cast("double").alias("x"), F.max(F.when(F.col(method) == y, F.col(metric))).cast("double").alias("y"))
        one = wide.select(F.lit(name).alias("label"), "x", "y")
        parts = one if parts is None else parts.unionByName(one)
    return signed_rank(parts, ["label"], alpha=alpha)
