"""Evaluation batches that come late, in part, out of order or twice, merged into one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.sources.stage_tables import next_batch, read_stage, write_stage

KEY = ["source_id", "candidate_id"]


def merge_batches(deliveries: DataFrame) -> DataFrame:
    """One row per candidate of each source: the one that was sent last.

    ``deliveries`` has ``source_id, candidate_id`` and ``sent``, a number that grows with every
    delivery; ``item_pos`` (the position in a delivery), if there is one, decides between rows of
    one delivery. A delivery with a part of its batch replaces that part. Merging is idempotent and
    does not depend on the order in which deliveries are merged. Rows without a key are left out.
    """
    order = [name for name in ("sent", "item_pos") if name in deliveries.columns]
    values = [name for name in deliveries.columns if name not in KEY]
    # The values break ties, so that rows sent twice under one number give one result.
    rank = F.struct(*order, *[F.col(name) for name in values if name not in order])
    return (
        deliveries.filter(" AND ".join(f"{name} IS NOT NULL" for name in KEY))
        .groupBy(*KEY).agg(F.max(rank).alias("last"))
        .select(*[F.col(name) if name in KEY else F.col(f"last.{name}").alias(name)
                  for name in deliveries.columns]))


def numbered(merged: DataFrame) -> DataFrame:
    """Adds ``eval_pos``, from 1 along the candidates of each source, as a union of batches has it."""
    along = Window.partitionBy("source_id").orderBy("candidate_id")
    return merged.withColumn("eval_pos", F.row_number().over(along).cast("bigint"))


def merge_into_stage(
    spark: SparkSession, root: str, stage: str, arriving: DataFrame
) -> None:
    """Merges a delivery into a stage table; only the sources that it names are read and written.

    The rows keep their ``sent``, so an older delivery that comes later replaces nothing newer.
    """
    touched = arriving.filter("source_id IS NOT NULL").select("source_id").distinct()
    stored = read_stage(spark, root, stage, wanted=touched)
    rows = arriving if stored is None else stored.unionByName(arriving)
    write_stage(merge_batches(rows), touched, root, stage, next_batch(spark, root, [stage]))
