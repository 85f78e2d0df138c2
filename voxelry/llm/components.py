"""Connected components of an edge table by alternating star contractions, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.shared import materialize


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for each vertex of ``links`` (a, b): the smallest vertex that it reaches.

    ``known``, the result for other links, is taken in: the components of all of them together come out.

    In a large-star step each vertex's larger neighbours go to its smallest neighbour or itself; in a small-star step
    its smaller ones do. The edges end as stars around the smallest vertices, in a number of rounds that grows with the
    logarithm of the longest path. It goes on until sums over the edges tell that nothing changes any more.
    """
    if known is not None:
        links = links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
