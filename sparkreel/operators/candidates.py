"""Content of candidate windows, batches for scoring, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import strip

# Windows per scoring request, and characters shown in a preview.
BATCH_SIZE = 40
PREVIEW_LENGTH = 120
# Windows and segments meet in runs of this many segments.
JOIN_RUN = 64

WINDOW_COLUMNS = ["source_id", "candidate_id", "start_ms", "end_ms", "start_idx", "end_idx"]


def build_candidates(
    candidates: DataFrame, segments: DataFrame, *, with_segments: bool = False
) -> DataFrame:
    """Candidates with ``transcript_text`` (and their segments); blank windows are dropped.

    Joined on (source, run of segments), so a long source is read by many tasks and a window only
    gathers its own segments. A window is gathered where its run is, so texts that were shuffled for
    the join are not shuffled again; only the few windows in several runs are put together afterwards.
    """
    run = F.floor(F.col("idx") / JOIN_RUN)
    first, last = (F.floor(F.col(name) / JOIN_RUN) for name in ("start_idx", "end_idx"))
    within = candidates.filter(first == last).select(*WINDOW_COLUMNS, first.alias("run"))
    across = candidates.filter(first < last).select(
        *WINDOW_COLUMNS, F.explode(F.sequence(first, last)).alias("run"))
    rows = segments.select(
        "source_id",
        run.alias("run"),
        "idx",
        F.struct(
            F.col("idx"), F.col("start_ms"), F.col("end_ms"), F.col("text")
        ).alias("segment"),
    )
    if not with_segments:
        rows = rows.withColumn("segment", F.struct("segment.idx", "segment.text"))

    def gathered(windows: DataFrame) -> DataFrame:
        return (
            windows.join(rows, ["source_id", "run"])
            .filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx")))
            .groupBy(*WINDOW_COLUMNS, "run")
            .agg(F.collect_list("segment").alias("segments"))
        )

    whole = gathered(within).drop("run").unionByName(
        gathered(across).groupBy(*WINDOW_COLUMNS)
        .agg(F.flatten(F.collect_list("segments")).alias("segments")))
    content = (
        whole.withColumn("segments", F.sort_array("segments"))
        .withColumn(
            "transcript_text",
            strip(F.array_join(F.transform("segments", lambda s: s["text"]), " ")),
        )
        .filter(F.col("transcript_text") != "")
    )
    return content if with_segments else content.drop("segments")


def candidate_counts(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Windows per source, zero included."""
    counts = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    return sources.select("source_id").join(counts, "source_id", "left").fillna(
        0, ["total_candidates"]
    )


def preview(content: DataFrame) -> DataFrame:
    """One printable line per candidate."""
    start, end = (timing.fixed_seconds(F.col(name), 1) for name in ("start_ms", "end_ms"))
    return content.select(
        "source_id",
        "candidate_id",
        F.format_string(
            "%d: %ss -> %ss | %s...",
            "candidate_id", start, end, F.substring("transcript_text", 1, PREVIEW_LENGTH),
        ).alias("line"),
    )


def batch_number(batch_size: int = BATCH_SIZE) -> Column:
    """Batch (from 1) of a candidate; ids are positions, so no sort is needed."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return (F.floor((F.col("candidate_id") - 1) / batch_size) + 1).cast("bigint")


def batches(candidates: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Scoring batches of each source, their sizes and how many there are."""
    sizes = candidates.groupBy("source_id", batch_number(batch_size).alias("batch")).agg(
        F.count(F.lit(1)).alias("candidates")
    )
    totals = candidates.groupBy("source_id").agg(
        F.max(batch_number(batch_size)).alias("total_batches")
    )
    return sizes.join(totals, "source_id")


def evaluation_payloads(content: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """One JSON array of windows per batch: what a scorer is asked about."""
    item = F.struct(
        F.col("candidate_id"),
        F.round(timing.duration_seconds(F.col("start_ms"), F.col("end_ms"), 2), 1)
        .alias("duration_seconds"),
        F.col("transcript_text").alias("transcript"),
    )
    return (
        content.groupBy("source_id", batch_number(batch_size).alias("batch"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("source_id", "batch", F.size("items").cast("bigint").alias("candidates"),
                F.to_json("items").alias("payload"))
    )


def missing_evaluations(candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Candidates nobody scored."""
    return candidates.select("source_id", "candidate_id").join(
        evaluations.select("source_id", "candidate_id"), ["source_id", "candidate_id"], "left_anti"
    )


def missing_per_batch(
    candidates: DataFrame, evaluations: DataFrame, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Batches whose response left candidates out, with their ids in order."""
    return (
        missing_evaluations(candidates, evaluations)
        .groupBy("source_id", batch_number(batch_size).alias("batch"))
        .agg(F.sort_array(F.collect_list("candidate_id")).alias("missing_ids"))
    )


def score_report(candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Every candidate with its score, or MISSING. A later evaluation replaces an earlier one."""
    latest = evaluations.groupBy("source_id", "candidate_id").agg(
        F.max_by(F.struct("score", "reason", "suggested_title"), "eval_pos").alias("e")
    )
    scored = F.col("e").isNotNull()
    return candidates.join(latest, ["source_id", "candidate_id"], "left").select(
        "source_id",
        "candidate_id",
        timing.duration_seconds(F.col("start_ms"), F.col("end_ms"), 2).alias("duration"),
        F.when(scored, F.format_string("%.1f/10", "e.score")).otherwise("MISSING").alias("score"),
        F.when(scored, F.col("e.reason")).otherwise("No evaluation returned.").alias("reason"),
        F.coalesce("e.suggested_title", F.lit("None")).alias("title"),
    )
