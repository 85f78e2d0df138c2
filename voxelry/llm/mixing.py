"""Mixing sources to target weights by hash thresholds, in DataFrame operations alone.

Each document has a key, the first 52 bits of the MD5 of its id. A histogram holds the words of each source by the
key's leading bits; a source's remaining budget ends within one bucket, which alone is refined by the next bits, until
the last of four nested levels of 13 bits. Documents with a key below the threshold so found are taken once more than
the source's whole copies. No document is sorted, and only histograms meet in a window.

Cases: a null or empty text has size 0 and counts as taken with 0 words; null sources are one source, last in order;
rows with equal ids share a key and go together; an empty table gives no rows; columns of the operator's own begin with
``_mix_``, so others may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 13, 4


def key_of(doc_id: Column) -> Column:
    """52 bits that order the documents of a source."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def weights_of(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights by the sources' order; ``sizes`` has a row for each source."""
    order = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last())) - 1
    return sizes.withColumn("_mix_weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double"))


def targets_of(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets in proportion to the weights, at most ``most`` times a source's size, that sum to ``share`` of all.

    The sources reach their ceiling in the order of most * size / weight; with the first k at their ceiling, the others
    share what is left by weight. The least k for which none of the others is above its ceiling is the one that
    resharing the excess again and again ends at.
    """
    w = weights_of(sizes, weights).withColumn("_mix_ceiling", F.col("_mix_size") * F.lit(most))
    w = w.withColumn("_mix_ratio", F.col("_mix_ceiling") / F.col("_mix_weight"))
    ordered, every = Window.orderBy("_mix_ratio", F.col("_mix_source").asc_nulls_last()), Window.partitionBy()
    capped = F.coalesce(F.sum("_mix_ceiling").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("_mix_weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_mix_level", (F.sum("_mix_size").over(every) * F.lit(share) - capped) / free)
    least = F.min_by("_mix_level", F.when(F.col("_mix_level") <= F.col("_mix_ratio"), F.struct("_mix_ratio", "_mix_level"))).over(every)
    w = w.withColumn("_mix_level", F.coalesce(least, F.lit(float("inf"))))
    return w.withColumn("_mix_target", F.least("_mix_ceiling", F.col("_mix_level") * F.col("_mix_weight"))).select("_mix_source", F.col("_mix_size").alias("_mix_source_size"), "_mix_target")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the key below which documents get one more copy: _mix_source, _mix_below.

    ``rows`` has _mix_source, _mix_words, _mix_key; ``budgets`` has _mix_source, _mix_rest, the words still to take.
    """
    state = budgets.select(F.col("_mix_source").alias("_s"), F.col("_mix_rest").alias("_rest"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = rows.join(state, F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.shiftright("_mix_key", shift + LEVEL_BITS) == F.col("_prefix")))
        bins = inside.groupBy("_s", F.shiftright("_mix_key", shift).alias("_bin")).agg(F.sum("_mix_words").alias("_words"), F.first("_rest").alias("_rest"))
        upto = Window.partitionBy("_s").orderBy("_bin")  # at most 2 ** LEVEL_BITS rows of a source
        bins = bins.withColumn("_sum", F.sum("_words").over(upto))
        # the first bucket whose words go beyond the budget holds the threshold
        over = bins.filter(F.col("_sum") > F.col("_rest")).groupBy("_s").agg(F.min_by(F.struct("_bin", "_words", "_sum", "_rest"), "_bin").alias("_b"))
        found = over.select("_s", F.col("_b._bin").alias("_prefix"), F.col("_b._words").alias("_words"), (F.col("_b._rest") - (F.col("_b._sum") - F.col("_b._words"))).alias("_rest"))
        state = materialize(found, f"mix-level-{level}")
    # the boundary key itself joins in if that comes nearer to the budget
    return state.select(F.col("_s").alias("_mix_source"), (F.col("_prefix") + F.when(F.col("_words") - F.col("_rest") < F.col("_rest"), 1).otherwise(0)).alias("_mix_below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Rows with _mix_source, _mix_words and _mix_key for ``docs``, and the decisions, a row for each source."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", F.col("source").alias("_mix_source"), words.alias("_mix_words"), key_of(F.col("doc_id")).alias("_mix_key"))
    rows = materialize(sized, "mix-sizes")
    sizes = rows.groupBy("_mix_source").agg(F.sum("_mix_words").alias("_mix_size"))
    targets = targets_of(sizes, weights, share, most)
    whole = F.when(F.col("_mix_source_size") > 0, F.floor(F.col("_mix_target") / F.col("_mix_source_size"))).otherwise(0)
    budgets = materialize(targets.withColumn("_mix_whole", whole.cast("long")).withColumn("_mix_rest", F.col("_mix_target") - F.col("_mix_whole") * F.col("_mix_source_size")), "mix-budgets")
    below = thresholds(rows.filter("_mix_words > 0"), budgets.filter("_mix_rest > 0"))
    both = budgets.alias("b").join(below.alias("t"), F.col("b._mix_source").eqNullSafe(F.col("t._mix_source")), "left").select("b.*", F.coalesce("t._mix_below", F.when(F.col("_mix_rest") > 0, F.lit(1 << 52)).otherwise(0)).alias("_mix_below"))
    return rows, materialize(both.withColumnRenamed("_mix_source", "_mix_of"), "mix-sources")


def copies(of: DataFrame, both: DataFrame) -> DataFrame:
    """Join the sources' decisions to rows with _mix_source and _mix_key; a row for each source is small."""
    joined = of.join(both, F.col("_mix_source").eqNullSafe(F.col("_mix_of")), "left")
    return joined.withColumn("_mix_copies", F.least(F.lit(2), F.col("_mix_whole") + F.when(F.col("_mix_key") < F.col("_mix_below"), 1).otherwise(0)))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs``."""
    rows, both = mix(docs, **options)
    return copies(rows, both).select("doc_id", F.col("_mix_words").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_words") * F.col("_mix_copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, left out, once or twice."""
    _, both = mix(docs, **options)
    keyed = docs.withColumn("_mix_source", F.col("source")).withColumn("_mix_key", key_of(F.col("doc_id")))
    times = copies(keyed, both).withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_mix_copies"), F.lit(1)))))
    return times.filter("_mix_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns])
