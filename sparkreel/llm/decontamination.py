"""Operator 5: benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of word shingles (powers of two). A partition's items are
sketched by their smallest shingle hashes, as many as the partition needs: if a share ``t`` of an
item's ``q`` shingles must occur in a document, at most ``(1 - t) q`` are missing, so of any
``floor((1 - t) q) + 1`` hashes one is found there. With sketches of that length for the largest
``q`` of the partition the search misses nothing, however long the document is. Documents whose
shingle hashes hit a sketch are candidates, verified on the shingles themselves.

An item of fewer words than a shingle has is one shingle of all its words, and documents are then
looked through for runs of that length, too.

Only DataFrame functions are used.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.storage import folded, keyed, small, store, text_of, unfolded

BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _places(words: Column, size: int) -> Column:
    count = F.size(words) - size + 1
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none if there are fewer words."""
    return F.transform(
        _places(words, size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def shingle_texts(words: Column, size: int) -> Column:
    return F.array_distinct(F.transform(
        _places(words, size),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])))


def _of_all_lengths(make, words: Column, lengths: list[int]) -> Column:
    return F.concat(*[make(words, length) for length in lengths])


def _of_own_length(make, words: Column, size: int) -> Column:
    """Shingles of ``size`` words; of fewer words all as one, of none none."""
    out = make(words, size)
    for length in range(1, size):
        out = F.when(F.size(words) == length, make(words, length)).otherwise(out)
    return out


def sketches(items: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """``item, hash``: the smallest hashes of every item, as many as its size partition needs.

    ``items`` has ``item`` and ``words``.
    """
    own = _of_own_length(shingle_hashes, F.col("words"), size)
    hashes = items.select("item", F.array_sort(F.array_distinct(own)).alias("all"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("all"))) + 1) - 1
    missing = F.floor(largest * (threshold.denominator - threshold.numerator)
                      / threshold.denominator)
    return hashes.filter(F.size("all") > 0).select(
        "item", F.explode(F.slice("all", 1, (missing + 1).cast("int"))).alias("hash"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)
) -> DataFrame:
    """``_key, doc_id, item_id, n_shared, n_item, containment`` of items inside documents.

    ``docs`` has ``_key, doc_id, text`` (see ``keyed``), ``benchmark`` has ``item_id, text``. A
    pair is listed when at least ``threshold`` of the item's distinct shingles occur in the
    document.
    """
    items = store(
        benchmark.select(F.col("item_id").cast("long"), words_of(text_of("text")).alias("words"))
        .distinct().withColumn("item", F.xxhash64("item_id", "words")))
    probes = small(store(sketches(items, size, threshold)), BROADCAST_ROWS)
    # At most ``size`` numbers: the lengths of items below it, and itself.
    short = items.filter(F.size("words").between(1, size - 1)).select(F.size("words")).distinct()
    lengths = sorted({size, *[row[0] for row in short.collect()]})
    # Words are computed once per row, then read by the lambdas.
    split = docs.select("_key", words_of(F.col("text")).alias("words"))
    hits = (
        split.select("_key", F.explode(
            _of_all_lengths(shingle_hashes, F.col("words"), lengths)).alias("hash"))
        .join(probes, "hash").select("_key").distinct())
    hits = small(store(hits), 5 * BROADCAST_ROWS)

    pieces = store(items.select(
        "item", "item_id",
        F.explode(_of_own_length(shingle_texts, F.col("words"), size)).alias("shingle")))
    sizes = pieces.groupBy("item").agg(F.count("*").alias("n_item"))
    suspects = docs.join(hits, "_key", "left_semi").select(
        "_key", "doc_id", words_of(F.col("text")).alias("words"))
    found = (
        suspects.select("_key", "doc_id", F.explode(
            _of_all_lengths(shingle_texts, F.col("words"), lengths)).alias("shingle"))
        .join(small(pieces, BROADCAST_ROWS // 4), "shingle")
        .dropDuplicates(["_key", "item", "shingle"])
        .groupBy("_key", "doc_id", "item", "item_id").agg(F.count("*").alias("n_shared")))
    enough = F.col("n_shared") * threshold.denominator >= F.col("n_item") * threshold.numerator
    return found.join(sizes, "item").filter(enough).select(
        "_key", "doc_id", "item_id", "n_shared", "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``, one row per document and item.

    Words are lower-case runs of letters and digits. Null and empty texts match nothing; an item of
    fewer than ``size`` words is found where all of them stand in a row. Rows that repeat an id and a text count once; rows of one
    id with other texts are documents of their own, and so are items. Empty tables give no rows.
    """
    docs = keyed(docs.select("doc_id", text_of("text").alias("text")))
    return contaminated(docs, benchmark, size, threshold).drop("_key")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: Fraction = Fraction(4, 5)
) -> DataFrame:
    """The rows of ``docs``, all columns, without documents that hold a benchmark item."""
    own = docs.columns
    docs = keyed(folded(docs))
    read = docs.select("_key", "doc_id", text_of("text").alias("text"))
    found = store(contaminated(read, benchmark, size, threshold).select("_key").distinct())
    return docs.join(small(found, 5 * BROADCAST_ROWS), "_key", "left_anti").select(*unfolded(own))
