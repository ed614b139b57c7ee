"""Pauses, natural starts and numbering over transcript segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import has_text

# A source is cut into runs of this many rows, so that no task has to hold a whole source.
RUN_LENGTH = 16_384


def with_text_flag(segments: DataFrame) -> DataFrame:
    """Segments with ``has_text``; a stored flag is kept, which spares reading the text."""
    if "has_text" in segments.columns:
        return segments
    return segments.withColumn("has_text", has_text(F.col("text")))


def with_pauses(segments: DataFrame) -> DataFrame:
    """Adds ``pause_before_ms`` (clamped at 0, 999 s for the first) and ``pause_after_ms`` (raw,
    NULL for the last).

    Neighbours are looked up inside runs of ``RUN_LENGTH`` rows; the first and last row of a run
    also visit the run next door, so one long source spreads over many tasks in a single shuffle.
    """
    run = F.floor(F.col("idx") / RUN_LENGTH)
    place = F.col("idx") % RUN_LENGTH
    visited = F.array(
        run,
        F.when((place == 0) & (run > 0), run - 1),
        F.when(place == RUN_LENGTH - 1, run + 1),
    )
    rows = segments.withColumn("_run", F.explode(F.array_compact(visited)))
    neighbours = Window.partitionBy("source_id", "_run").orderBy("idx")
    gap = F.col("start_ms") - F.lag("end_ms").over(neighbours)
    return (
        rows.withColumn(
            "pause_before_ms",
            F.coalesce(F.greatest(gap, F.lit(0)), F.lit(timing.FIRST_PAUSE_MS)).cast("bigint"),
        )
        .withColumn("pause_after_ms", F.lead("start_ms").over(neighbours) - F.col("end_ms"))
        .filter(F.col("_run") == run)
        .drop("_run")
    )


def is_natural_start(pause_ms: int) -> Column:
    return (F.col("idx") == 0) | (F.col("pause_before_ms") >= pause_ms)


def natural_starts(segments: DataFrame, pause_threshold: float = 0.8) -> DataFrame:
    """Segments that begin a source or follow a long enough pause."""
    if pause_threshold < 0:
        raise ValueError("pause_threshold cannot be negative")
    return with_pauses(segments).filter(is_natural_start(timing.to_ms(pause_threshold)))


def order_violations(segments: DataFrame) -> DataFrame:
    """Segments that end before their predecessor does; discovery expects none."""
    run = F.floor(F.col("idx") / RUN_LENGTH)
    visited = F.array(run, F.when(F.col("idx") % RUN_LENGTH == RUN_LENGTH - 1, run + 1))
    rows = segments.withColumn("_run", F.explode(F.array_compact(visited)))
    previous = F.lag("end_ms").over(Window.partitionBy("source_id", "_run").orderBy("idx"))
    return (
        rows.withColumn("previous_end_ms", previous)
        .filter((F.col("_run") == run) & (F.col("end_ms") < F.col("previous_end_ms")))
        .drop("_run")
    )


def number_rows(
    rows: DataFrame, position: str, name: str, *, start: int = 0, span: int = RUN_LENGTH
) -> DataFrame:
    """Numbers the rows of each source by a BIGINT position, from ``start`` and without gaps.

    Rows are counted per span of positions, the counts (one row per span) are summed up along the
    source, and only then are rows numbered, span by span: no task sees a whole source.
    """
    spans = rows.withColumn("_span", F.floor(F.col(position) / span))
    along = Window.partitionBy("source_id").orderBy("_span")
    offsets = (
        spans.groupBy("source_id", "_span")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(along) - F.col("_rows"))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy("source_id", "_span").orderBy(position))
    return (
        spans.withColumn("_inside", inside)
        .join(offsets, ["source_id", "_span"])
        .withColumn(name, (F.col("_before") + F.col("_inside") + (start - 1)).cast("bigint"))
        .drop("_span", "_inside", "_before")
    )


def transcript_duration(segments: DataFrame) -> DataFrame:
    """End of the last segment of each source."""
    return segments.groupBy("source_id").agg(F.max_by("end_ms", "idx").alias("duration_ms"))


def tail_scan(segments: DataFrame, start_seconds: float) -> DataFrame:
    """Segments from a time on, as printable lines."""
    start, end = (timing.fixed_seconds(F.col(name), 2) for name in ("start_ms", "end_ms"))
    return segments.filter(F.col("start_ms") >= timing.to_ms(start_seconds)).select(
        "source_id", "idx", F.format_string("%s -> %s: %s", start, end, "text").alias("line")
    )


def unusable_transcripts(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Sources without segments, or whose segments hold no text, each with the reason."""
    texts = (
        with_text_flag(segments)
        .groupBy("source_id")
        .agg(F.bool_or("has_text").alias("has_text"))
    )
    reason = F.when(F.col("has_text").isNull(), "no segments").otherwise("no usable text")
    return (
        sources.select("source_id")
        .join(texts, "source_id", "left")
        .filter(~F.coalesce("has_text", F.lit(False)))
        .select("source_id", reason.alias("reason"))
    )
