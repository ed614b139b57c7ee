"""Operator 4: exact duplicates by progressive refinement.

Rows are grouped by length first, then by length and a hash of the first characters; only rows
whose group still has company have their whole content hashed and grouped. All groups are sums
pre-aggregated before the shuffle, and rows meet them in joins whose large keys can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.storage import BLANKS, text_of

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _with_company(rows: DataFrame, keys: list[str], extra: str) -> DataFrame:
    """Rows whose key occurs more than once.

    ``extra`` follows from the keys; joining on it too makes both sides a shuffle of their own,
    which adaptive execution can split where a key is frequent.
    """
    common = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(extra).alias(extra))
        .filter("_n > 1").drop("_n")
    )
    return rows.join(common, [*keys, extra], "left_semi")


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups with two rows or more: ``text_sha256, keep_id, group_size``.

    ``docs`` has ``doc_id`` and ``text``; nothing else is read. ``keep_id`` is the smallest
    doc_id (null only if all are), rows that repeat an id count as rows.
    """
    text = normalised(F.col("text"))
    sizes = docs.select(
        F.col("doc_id").alias("id"),
        F.length(text).alias("chars"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("head"),
    ).withColumn("mark", F.col("chars") % 1021)
    alike = _with_company(sizes, ["chars"], "mark")
    alike = _with_company(alike, ["chars", "head"], "mark")
    alike = alike.groupBy("chars", "head").agg(F.first("mark").alias("mark"))
    full = (
        docs.select(F.length(text).alias("chars"),
                    F.xxhash64(F.substring(text, 1, prefix_chars)).alias("head"),
                    F.col("doc_id"), text.alias("whole"))
        .withColumn("mark", F.col("chars") % 1021)
        .join(alike, ["chars", "head", "mark"], "left_semi")
        .select("doc_id", F.sha2("whole", 256).alias("text_sha256"))
    )
    return (
        full.groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Adds ``text_sha256, keep_id, group_size, kept`` to the rows.

    Texts are equal when they are after every run of ASCII white space became one space; null is
    empty. Of equal texts the smallest doc_id stays; rows repeating that id stay with it, rows
    without an id stay only where no row of the group has one. Empty tables give no rows.
    """
    added = ["text_sha256", "keep_id", "group_size", "kept"]
    first = F.substring("text_sha256", 1, 6)
    groups = exact_groups(docs.select("doc_id", "text"), prefix_chars).withColumn("_first", first)
    return (
        docs.drop(*added)
        .withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
        .withColumn("_first", first)
        .join(groups, ["text_sha256", "_first"], "left")
        .drop("_first")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id"))
                    .otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
