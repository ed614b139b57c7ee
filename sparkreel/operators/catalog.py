"""Projects, display titles and output paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import identity, timing
from sparkreel.functions.text import or_default, safe_filename

# Fixed value: title shown to a scorer when the source has none.
UNKNOWN_TITLE = "Unknown"


def with_identity(sources: DataFrame) -> DataFrame:
    """Sources with their type, video id, project and identity."""
    location = F.col("location")
    return (
        sources.withColumn("source_type", identity.source_type(location))
        .withColumn("video_id", identity.video_id(location))
        .withColumn("_identity", identity.source_identity(location))
        .withColumn("project_id", F.col("_identity.project_id"))
        .withColumn("identity", F.col("_identity.identity"))
        .drop("_identity")
    )


def canonical_sources(sources: DataFrame, position: str) -> DataFrame:
    """One row per project: its first location, and how many spellings it came under."""
    first = F.min_by(F.struct("source_type", "location"), position)
    return (
        with_identity(sources)
        .groupBy("project_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("spellings"))
        .select("project_id", "first.source_type", "first.location", "spellings")
    )


def clip_title(title: Column, clip_id: Column) -> Column:
    return or_default(title, F.concat(F.lit("Clip "), clip_id))


def scoring_title(title: Column) -> Column:
    return or_default(title, F.lit(UNKNOWN_TITLE))


def packaging_title(title: Column, location: Column) -> Column:
    return or_default(title, location)


def output_paths(clips: DataFrame) -> DataFrame:
    """Clips with display title and the relative paths of everything made from them."""
    number = F.format_string("%02d", "clip_id")
    title = clip_title(F.col("title"), F.col("clip_id"))
    return clips.select(
        "source_id",
        "clip_id",
        title.alias("title"),
        F.concat(F.lit("clips/clip_"), number, F.lit("_"), safe_filename(title), F.lit(".mp4"))
        .alias("file_path"),
        F.concat(F.lit("renders/clip_"), number, F.lit(".mp4")).alias("base_render_path"),
        F.concat(F.lit("packaging/clip_"), number, F.lit(".json")).alias("packaging_path"),
        F.concat(F.lit("source/section_"), number, F.lit(".mp4")).alias("section_path"),
    )


def document_paths(clips: DataFrame) -> DataFrame:
    """Where the documents of a clip lie in an export: ``subtitle_path``, ``packaging_path``."""
    project = F.concat(F.lit("project_id="), F.col("source_id").cast("string"), F.lit("/"))
    subtitles = F.regexp_replace("file_path", r"\.mp4$", ".ass")
    return output_paths(clips).select(
        "source_id", "clip_id", F.concat(project, subtitles).alias("subtitle_path"),
        F.concat(project, "packaging_path").alias("packaging_path"))


def section_ranges(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """The media ranges to fetch, one per clip, with the range expression of each."""
    start, end = (timing.seconds(F.col(name)) for name in ("start_ms", "end_ms"))
    return (
        clips.filter(F.col("end_ms") > F.col("start_ms"))
        .join(sources.select("source_id", "location"), "source_id")
        .select(
            "source_id",
            "clip_id",
            identity.source_type(F.col("location")).alias("source_type"),
            "location",
            start.alias("start_time"),
            end.alias("end_time"),
            F.concat(F.lit("*"), start, F.lit("-"), end).alias("section"),
        )
    )


def run_summary(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips made of each source, in order; sources without any say so."""
    made = (
        output_paths(clips)
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("clips"),
            F.sort_array(F.collect_list(F.struct("clip_id", "title", "file_path"))).alias("made"),
        )
    )
    lines = F.transform(
        "made", lambda clip: F.concat_ws(" | ", clip["clip_id"], clip["title"], clip["file_path"])
    )
    return sources.select("source_id").join(made, "source_id", "left").select(
        "source_id",
        F.coalesce("clips", F.lit(0).cast("bigint")).alias("clips"),
        F.coalesce(F.array_join(lines, "\n"), F.lit("No clips were selected.")).alias("summary"),
    )
