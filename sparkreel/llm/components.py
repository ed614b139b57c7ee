"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.storage import discard, store


def _stars(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Hangs the ends ``v`` of edges on the smallest vertex next to ``u``; the edges that matter."""
    lowest = (
        of.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        .withColumn("mark", F.xxhash64("u"))
    )
    return edges.withColumn("mark", F.xxhash64("u")).join(lowest, ["u", "mark"]).drop("mark")


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that can be reached, for every id with an edge ``a, b``.

    Large-star and small-star steps by turns, each stored in the shared folder, until nothing
    changes. The smallest neighbours are pre-aggregated; large stars meet their edges in joins
    that adaptive execution can split. Edges with a null end are ignored.
    """
    now = store(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _stars(both, both).filter("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct())
        large = store(large)
        hung = _stars(large, large)
        small = (
            hung.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionAll(hung.select("u", F.col("low").alias("v")))
            .filter("u <> v").distinct())
        before, now = now, store(small)
        discard(before, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
