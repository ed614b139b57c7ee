"""Operator 2: repeated runs of lines, by prefix doubling over line ids.

The corpus is a sequence of line ids (128-bit hashes), document after document. Prefix doubling
names the blocks of 1, 2, 4, ... lines from every line on: two blocks have one name exactly when
their lines agree, and a block is looked at only while it occurs more than once. These names are
the suffix array's ranks without their order, for which nothing here asks. Its longest-common-
prefix intervals are then walked from the root: an interval is the set of suffixes that agree in
their first L lines, and a step of 2^k lines, k falling, leads into the child whose members agree
that much further. In every interval the suffix that comes first in the corpus stays behind as its
first copy and may still be a later copy in a shallower one. Where the walk ends, L lines are the
longest run from this line on that also starts earlier in the corpus: a later copy of a maximal
repeated run, which is deleted.

Only DataFrame functions are used. Counts and first members are pre-aggregated, and rows meet them
in joins that adaptive execution can split, so a line that fills a third of the corpus is no
group of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkreel.llm.storage import discard, folded, keyed, store, text_of, unfolded

LINE_FEED = "\n"
ROOT = 0


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, pos, a, b, chars``: place, name and length of every line."""
    lines = docs.select(F.col("_key").alias("doc"), F.posexplode(F.split("text", LINE_FEED)))
    return lines.select(
        "doc", "pos", F.xxhash64("col").alias("a"), F.xxhash64(F.lit(91), "col").alias("b"),
        F.length("col").alias("chars"))


def _repeated(blocks: DataFrame) -> DataFrame:
    """Blocks whose name (``a, b``) occurs more than once.

    ``mark`` follows from the name; with it in the join, both sides get a shuffle of their own.
    """
    names = (
        blocks.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
        .select("a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("mark")))
    marked = blocks.withColumn("mark", F.col("a").bitwiseXOR(F.col("b")))
    return marked.join(names, ["a", "b", "mark"], "left_semi").drop("mark")


def _longer(blocks: DataFrame, step: int) -> DataFrame:
    """Blocks of twice ``step`` lines, where both halves are repeated."""
    second = blocks.select("doc", (F.col("pos") - step).alias("pos"),
                           F.col("a").alias("a2"), F.col("b").alias("b2"))
    return blocks.join(second, ["doc", "pos"]).select(
        "doc", "pos", F.xxhash64("a", "b", "a2", "b2").alias("a"),
        F.xxhash64(F.lit(91), "a", "b", "a2", "b2").alias("b"))


def earlier_runs(lines: DataFrame) -> DataFrame:
    """``doc, pos, length, chars``: the longest run of lines from here on that also starts earlier.

    ``lines`` has ``doc, pos, a, b, chars``. Only lines with such a run are listed; ``chars`` are
    those of the line at ``pos``.
    """
    active = store(_repeated(lines).dropDuplicates(["doc", "pos"]))
    # Rows listed twice had been counted twice.
    active = store(_repeated(active))
    levels = [active.select("doc", "pos", "a", "b")]
    while True:
        longer = store(_repeated(_longer(levels[-1], 1 << (len(levels) - 1))))
        if longer.isEmpty():
            break
        levels.append(longer)

    # The walk: (ca, cb) names the interval, `length` is its depth, `own` tells a suffix that is
    # still walking from the copy of an interval's first member that the others are held against.
    now = active.select("doc", "pos", F.lit(ROOT).cast("long").alias("ca"),
                        F.lit(ROOT).cast("long").alias("cb"), F.lit(0).alias("length"),
                        F.lit(True).alias("own"))
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].select("doc", F.col("pos").alias("next"), "a", "b")
        moved = now.withColumn("next", F.col("pos") + F.col("length")).join(
            blocks, ["doc", "next"], "left")
        moved = moved.withColumn("na", F.xxhash64("ca", "cb", "a", "b")).withColumn(
            "nb", F.xxhash64(F.lit(91), "ca", "cb", "a", "b"))
        moved = store(moved)
        some = moved.filter("a IS NOT NULL")
        child = (
            some.groupBy("na", "nb")
            .agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n"))
            .filter("n > 1").drop("n")
            .withColumn("mark", F.col("na").bitwiseXOR(F.col("nb"))))
        inside = store(
            some.withColumn("mark", F.col("na").bitwiseXOR(F.col("nb")))
            .join(child, ["na", "nb", "mark"])
            .withColumn("is_first", F.struct("doc", "pos") == F.col("first")).drop("first"))
        deeper = inside.select(
            "doc", "pos", F.col("na").alias("ca"), F.col("nb").alias("cb"),
            (F.col("length") + (1 << k)).alias("length"),
            F.expr("own AND NOT is_first").alias("own"))
        left = inside.filter("own AND NOT is_first").select("doc", "pos", "own")
        stays = moved.select("doc", "pos", "ca", "cb", "length", "own").join(
            left, ["doc", "pos", "own"], "left_anti")
        before, now = now, store(deeper.unionByName(stays))
        discard(before, moved, inside)
    return now.filter("own AND length > 0").join(
        active.select("doc", "pos", "chars"), ["doc", "pos"]).select(
        "doc", "pos", "length", "chars")


def deleted_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """``doc, pos`` of the lines to delete; ``docs`` has ``_key`` and ``text``.

    They are the lines of later copies of repeated runs that hold ``min_chars`` characters or more.
    """
    runs = earlier_runs(_lines(docs))
    # A run's lines all are in the table: each starts a run itself, one line shorter.
    in_order = Window.partitionBy("doc").orderBy("pos")
    ahead = in_order.rowsBetween(Window.unboundedPreceding, 0)
    runs = store(runs.withColumn("total", F.sum("chars").over(ahead)))
    ends = runs.select("doc", (F.col("pos") + 1).alias("end"), F.col("total").alias("until"))
    held = runs.withColumn("end", F.col("pos") + F.col("length")).join(ends, ["doc", "end"])
    long_run = F.col("until") - F.col("total") + F.col("chars") >= min_chars
    reach = F.when(long_run, F.col("end"))
    return (
        held.withColumn("reach", F.max(reach).over(ahead))
        .filter(F.col("reach") > F.col("pos")).select("doc", "pos"))


def line_dedup(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """Adds ``n_lines``, ``n_removed`` and ``kept_text`` to the rows; other columns stay.

    Lines are parted by line feeds and compared as they are. A run of lines is deleted where a
    copy of it starts earlier (smaller doc_id, or further up) and it holds ``min_chars``
    characters or more; copies are judged on the input. Null texts count as one empty line and
    stay null; empty texts stay. Rows that repeat an id and a text are one document and treated
    alike; rows of one id with other texts are documents of their own, in the order of a hash of
    the text; rows without an id come first. Empty tables give no rows.
    """
    added = ("n_lines", "n_removed", "kept_text")
    own = [c for c in docs.columns if c not in added]
    docs = keyed(folded(docs, without=added))
    gone = deleted_lines(docs.select("_key", text_of("text").alias("text")), min_chars)
    gone = gone.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("pos").alias("_gone"))
    lines = F.split(text_of("text"), LINE_FEED)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), LINE_FEED)
    return (
        docs.join(gone, F.col("_key") == F.col("_doc"), "left")
        .withColumn("_lines", lines)
        .select(
            *unfolded(own), F.size("_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
            F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text).alias("kept_text")))


