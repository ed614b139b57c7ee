"""Intermediate tables in the shared folder, and reading the corpus tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.plans.lineage import shared_folder

# What `[\x20\x09-\x0D]` holds; Spark's regular expressions read it as it stands.
BLANKS = r"[ \t-\r]+"
NO_ID = -(2**63)


# Folders of the open scopes, the innermost last; tables are stored there.
_scopes: list[str] = []


def _new_folder(spark: SparkSession) -> str:
    inside = _scopes[-1] if _scopes else f"{shared_folder(spark).rstrip('/')}/tables"
    return f"{inside}/{uuid.uuid4().hex}"


def store(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back: cut lineage that outlives any executor."""
    spark = rows.sparkSession
    path = _new_folder(spark)
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    stored.stored_at = path
    return stored


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more: what was made of them is stored itself.

    Spark keeps the shuffle files of finished steps until their plans are collected as garbage on
    the driver, which it may not need to do for hours; so that is asked for here as well.
    """
    for rows in tables:
        path = getattr(rows, "stored_at", None)
        if path is not None:
            remove(rows.sparkSession, path)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables stored inside the scope.

    It outlives the scope, as results may still read it; whoever has stored them calls ``remove``.
    """
    folder = _new_folder(spark)
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``: a number that names a document and orders as ``doc_id`` does.

    It is ``doc_id`` where ids are unique. Otherwise rows of one id and one text share a key (they
    are one document, listed again), other rows of an id are documents of their own in the order
    of a hash of their text, and rows without an id come first.
    """
    odd = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    named = docs.withColumn("_hash", F.xxhash64(text_of("text")))
    order = store(
        named.select(F.col("doc_id").alias("_id"), "_hash").distinct()
        .orderBy(F.col("_id").asc_nulls_first(), "_hash")
        .withColumn("_key", F.monotonically_increasing_id()))
    order = order.withColumnRenamed("_hash", "_of")
    return named.join(
        order, named["doc_id"].eqNullSafe(order["_id"]) & (named["_hash"] == order["_of"])
    ).drop("_id", "_of", "_hash")


def folded(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, _others``: all other columns in one, so that no name of theirs clashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", *without)]
    # A struct needs a field.
    others = others or [F.lit(None).cast("int").alias("none")]
    return docs.select("doc_id", "text", F.struct(*others).alias("_others"))


def unfolded(columns: list[str]) -> list[Column]:
    """The columns of ``folded`` documents under their own names, in the given order."""
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in columns]


def small(rows: DataFrame, most: int) -> DataFrame:
    """A stored table, marked for broadcast if it has ``most`` rows at the most; else as it is."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
