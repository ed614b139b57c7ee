"""Flat tables put back together as the nested documents other programs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.operators.responses import TEXT_FIELDS

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _source() -> Column:
    return F.struct("source_type", "location", "title")


def _nested(rows: DataFrame, order: str, name: str, *fields: Column) -> DataFrame:
    """Rows of each source as one ordered array of structs."""
    item = F.struct(*fields)
    return (
        rows.groupBy("source_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), item.alias("item"))))
             .alias("rows"))
        .select("source_id", F.transform("rows", lambda row: row["item"]).alias(name))
    )


def _document(sources: DataFrame, nested: DataFrame, *fields: Column) -> DataFrame:
    document = F.struct(_source().alias("source"), *fields)
    return sources.join(nested, "source_id").select(
        "source_id", F.to_json(document, _KEEP_NULLS).alias("document")
    )


def _segment(value: Column) -> Column:
    return F.struct(
        value["idx"].alias("id"), timing.seconds(value["start_ms"]).alias("start"),
        timing.seconds(value["end_ms"]).alias("end"), value["text"].alias("text"),
    )


def transcript_documents(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """``sources`` carries ``language``; the duration is the last end."""
    nested = _nested(
        segments, "idx", "segments",
        F.col("idx").alias("id"), timing.seconds(F.col("start_ms")).alias("start"),
        timing.seconds(F.col("end_ms")).alias("end"), F.col("text"),
    )
    return _document(
        sources, nested,
        F.element_at("segments", -1)["end"].alias("duration"), F.col("language"),
        F.col("segments"),
    )


def candidate_documents(sources: DataFrame, content: DataFrame) -> DataFrame:
    """From ``build_candidates(..., with_segments=True)``."""
    nested = _nested(
        content, "candidate_id", "candidates",
        F.col("candidate_id"), timing.seconds(F.col("start_ms")).alias("start_time"),
        timing.seconds(F.col("end_ms")).alias("end_time"), F.col("transcript_text"),
        F.transform("segments", _segment).alias("segments"),
    )
    return _document(
        sources, nested, F.size("candidates").alias("total_candidates"), F.col("candidates")
    )


def evaluation_documents(sources: DataFrame, evaluations: DataFrame) -> DataFrame:
    nested = _nested(
        evaluations, "eval_pos", "evaluations",
        *[F.col(name) for name in ("candidate_id", "score", "reason", "suggested_title")],
    )
    return _document(sources, nested, F.col("evaluations"))


def clip_plan_documents(sources: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip plans; the stored form has no duration."""
    nested = _nested(
        clips, "clip_id", "selected_clips",
        F.col("clip_id"), F.col("candidate_id"),
        timing.seconds(F.col("start_ms")).alias("snapped_start_time"),
        timing.seconds(F.col("end_ms")).alias("snapped_end_time"),
        F.col("final_score"), F.col("reason"), F.col("title"),
    )
    return _document(sources, nested, F.col("selected_clips"))


def source_documents(sources: DataFrame) -> DataFrame:
    """One source document per source: its type, location and title."""
    return sources.select("source_id", F.to_json(_source(), _KEEP_NULLS).alias("document"))


def packaging_documents(packaging: DataFrame) -> DataFrame:
    """One packaging document per clip: ``source_id, clip_id, document``."""
    fields = F.struct("clip_id", *TEXT_FIELDS, "hashtags")
    return packaging.select("source_id", "clip_id", F.to_json(fields, _KEEP_NULLS).alias("document"))
