"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A stage works on everything the one before kept, and its result is written before
the next one is called: then the tables it worked with are removed.

Every stage takes null and empty texts, texts of any length, repeated rows, ids that are null or
shared, empty tables and further columns of any name; these come back as they were. Null and empty
texts are never toxic, repeated, copies or contaminated, and pack as one end mark each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.llm.decontamination import remove_contaminated
from sparkreel.llm.jaccard_join import without_near_copies
from sparkreel.llm.line_dedup import line_dedup
from sparkreel.llm.packing import pack_documents
from sparkreel.llm.queries import VOCABULARY, toxicity_model
from sparkreel.llm.storage import discard, folded, remove, scratch, store, table, text_of, unfolded
from sparkreel.llm.toxicity import toxicity_score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_used: list[str] = []


def clean(spark: SparkSession) -> None:
    """Removes the working tables of stages whose results have been written."""
    while _used:
        remove(spark, _used.pop())


def stage(function: Stage) -> Stage:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clean(spark)
        with scratch(spark) as folder:
            _used.append(folder)
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; the model learns from the labels that are not held out.

    Where no labelled document is at hand nothing can be told, and all stay. A text without words
    has nothing toxic in it and stays.
    """
    model = toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    if not model.fitted:
        return docs
    empty = text_of("text").rlike(r"\A[ \t-\r]*\z")
    return docs.filter(empty | (toxicity_score(docs, F.col("text"), model) < 0.5))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that consist of nothing else.

    ``n_chars`` of documents that lost lines is counted anew.
    """
    found = line_dedup(folded(docs))
    nothing_left = (F.col("n_removed") > 0) & (F.trim("kept_text") == "")
    found = found.filter(~F.coalesce(nothing_left, F.lit(False))).withColumn("text", F.col("kept_text"))
    columns = unfolded(docs.columns)
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns[at] = F.when(F.col("n_removed") > 0, counted).otherwise(columns[at])
    return found.select(*[c.alias(n) for c, n in zip(columns, docs.columns, strict=True)])


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the first stays."""
    return without_near_copies(docs, size=5, num=80, den=100)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The stages learn a model, follow links and pack bins, which SQL does not express; the tests hold
# each of them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        before, docs = docs, store(function(spark, docs, sf_dir))
        discard(before)
    clean(spark)
    return docs
