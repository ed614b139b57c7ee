"""Operator 1: token counts by rank-synchronous merging of ragged arrays (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm import bpe


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a text under a vocabulary file, which every executor must have at that path."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = bpe.load(vocabulary)
        for batch in batches:
            yield pd.Series(engine.encode(batch.tolist(), ids=False)[0])

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One row per input row, repeated rows and rows without an id included; null and empty texts
    have 0 bytes and 0 tokens. Texts are read whole. Existing columns of these names are replaced.
    """
    return (
        docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
        .withColumn("n_tokens", token_count(F.col("text"), vocabulary))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
