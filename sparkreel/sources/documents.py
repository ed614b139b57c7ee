"""Stage documents: one nested JSON document per project and stage, read into flat tables.

A document is one file, or one line of a file (``per_line=True``). Each comes with ``project_id``:
the directory ``project_id=…`` it lies in, else the identity of the source it names, else its path. Fields are coerced one by
one, so that a number written as text still counts; a document that cannot be read yields no rows
here and one row in ``corrupt_documents``. A document too large for one parsed value is read in parts:
what stands beside the items as one value, every item as a value of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.identity import source_identity
from sparkreel.functions.text import strip
from sparkreel.operators.responses import (
    LARGE_BYTES, TEXT_FIELDS, as_text, field, framed, kind_of, last_key_wins, parse_error,
    stored_packaging_error, unframed,
)
from sparkreel.operators.segments import number_rows
from sparkreel.plans.lineage import computed_once

# The fields a document and its items must have, by kind of document.
REQUIRED = {
    "source": ("source_type", "location"),
    "transcript": ("source", "duration", "language"),
    "candidates": ("source",),
    "evaluations": ("source",),
    "clip_plan": ("source",),
}
ITEMS = {
    "transcript": ("segments", ("id", "start", "end", "text")),
    "candidates": ("candidates", ("candidate_id", "start_time", "end_time", "transcript_text")),
    "evaluations": ("evaluations", ("candidate_id", "score")),
    "clip_plan": (
        "selected_clips",
        ("clip_id", "candidate_id", "snapped_start_time", "snapped_end_time", "final_score"),
    ),
}
INTEGERS = ("id", "candidate_id", "clip_id")
TEXTS = ("text", "transcript_text", "language", "source_type", "location", "source")
# Longer texts, most of which fill a parsed value, are read in parts without trying the whole.
WHOLE_BYTES = 1 << 26
BESIDE_ITEMS = (
    "source", "duration", "language", "total_candidates", "source_type", "location", "clip_id",
    *TEXT_FIELDS, "hashtags",
)
# JSON as strict as that of whole values, strings of any length.
IN_PARTS = {
    "columnNameOfCorruptRecord": "_broken", "maxStringLen": str(2**31 - 1),
    "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
}


def read_documents(spark: SparkSession, path: str, *, per_line: bool = False) -> DataFrame:
    """``project_id, raw, document, in_parts``; ``document`` is NULL where the JSON is broken.

    With ``in_parts`` the whole is too large for one value, and ``document`` lacks the items.
    """
    last_key_wins(spark)
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not per_line)
    document = F.col("document")
    location = F.coalesce(
        field(document, "source.location", "string"), field(document, "location", "string")
    )
    directory = F.regexp_extract("file", "project_id=([^/]+)/", 1)
    project = F.when(directory != "", F.try_url_decode(directory)).otherwise(
        F.coalesce(
            _once(location, lambda found: source_identity(found)["project_id"]), F.col("file"))
    )
    return (
        rows.filter(F.trim("value") != "")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("value").alias("raw"),
            F.when(F.octet_length("value") < WHOLE_BYTES, framed(F.col("value"))).alias("framed"),
        )
        .withColumn("document", unframed(F.col("framed"), F.col("raw")))
        .withColumn("in_parts", F.col("document").isNull() & (F.octet_length("raw") >= LARGE_BYTES))
        .withColumn("document", F.when(F.col("in_parts"), _beside_items(F.col("raw")))
                    .otherwise(F.col("document")))
        .select(project.alias("project_id"), "raw", "document", "in_parts")
    )


def _beside_items(raw: Column) -> Column:
    """A document without its items, NULL where the JSON is broken."""
    schema = ", ".join(f"{name} variant" for name in BESIDE_ITEMS) + ", _broken string"

    def put_together(parts: Column) -> Column:
        fields = F.array(*[
            F.struct(F.lit(name).alias("key"), parts[name].alias("value")) for name in BESIDE_ITEMS])
        present = F.filter(fields, lambda f: f["value"].isNotNull())
        return F.when(parts["_broken"].isNull(), F.to_variant_object(F.map_from_entries(present)))

    # A large text must be one value inside brackets and under a name: the parser stops after the first.
    inside = F.from_json(
        F.concat(F.lit("["), raw, F.lit("]")), "array<struct<_none string>>", IN_PARTS)
    named = F.from_json(
        F.concat(F.lit('{"v":'), raw, F.lit("}")), "_none string, _broken string", IN_PARTS)
    alone = (F.size(inside) == 1) & named["_broken"].isNull()
    return F.when(alone, _once(F.from_json(raw, schema, IN_PARTS), put_together))


def _readable(value: Column, name: str) -> Column:
    if name in INTEGERS:
        return field(value, name, "bigint").isNotNull()
    if name in TEXTS:
        return field(value, name, "variant").isNotNull()
    return field(value, name, "double").isNotNull()


def _parts(kind: str) -> Column:
    """The items of a document that is read in parts, each a value of its own."""
    return F.from_json(
        F.col("raw"), f"{ITEMS[kind][0]} array<variant>, _broken string", IN_PARTS)


def _items(document: Column, kind: str) -> Column:
    name = ITEMS[kind][0]
    found = F.when(F.col("in_parts"), _parts(kind)[name]).otherwise(
        field(document, name, "array<variant>"))
    return F.coalesce(found, F.array().cast("array<variant>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.transform(F.array(value), lambda bound: use(bound))[0]


def _item_error(items: Column, kind: str) -> Column:
    def wrong(item: Column) -> Column:
        error = F.lit(None).cast("string")
        for name in reversed(ITEMS[kind][1]):
            message = F.lit(f"bad {ITEMS[kind][0]}.{name}")
            error = F.when(~_readable(item, name), message).otherwise(error)
        return error

    errors = F.filter(F.transform(items, lambda item: wrong(item)), lambda e: e.isNotNull())
    return F.get(errors, F.lit(0))


def _error(document: Column, item_error: Column | None, kind: str) -> Column:
    if kind == "packaging":
        return stored_packaging_error(document)
    error = F.when(document.isNull(), F.lit("invalid JSON"))
    for name in REQUIRED[kind]:
        error = error.when(~_readable(document, name), F.lit(f"missing {name}"))
    if kind != "source":
        for name in REQUIRED["source"]:
            absent = field(document, f"source.{name}", "variant").isNull()
            error = error.when(absent, F.lit(f"missing source.{name}"))
    if item_error is not None:
        # Items that are no list, or one that is itself too large for a value.
        unread = F.col("in_parts") & _parts(kind)["_broken"].isNotNull()
        error = error.when(unread, F.lit("document too large")).otherwise(item_error)
    return error


def _checked(documents: DataFrame, kind: str) -> DataFrame:
    """Documents with their ``items`` and, in ``error``, why one cannot be loaded; NULL if it can."""

    def checked(item_error: Column | None) -> Column:
        # Bound to a lambda variable, the document is not copied for every mention.
        error = _once(F.col("document"), lambda document: _error(document, item_error, kind))
        return F.when(error == "invalid JSON", parse_error(F.col("raw"))).otherwise(error)

    if kind not in ITEMS:
        return computed_once(documents, "error", checked(None))
    items = _items(F.col("document"), kind)
    large = F.octet_length("raw") >= LARGE_BYTES
    rows = computed_once(documents.filter(~large), "check", _once(items, lambda bound: F.struct(
        bound.alias("items"), checked(_item_error(bound, kind)).alias("error")
    ))).select("*", "check.items", "check.error").drop("check")
    # Large texts are rather read again than copied from step to step.
    return rows.unionByName(documents.filter(large).withColumn("items", items).withColumn(
        "error", checked(_once(items, lambda bound: _item_error(bound, kind)))))


def corrupt_documents(documents: DataFrame, kind: str) -> DataFrame:
    """Documents that cannot be loaded, with the reason."""
    return (
        _checked(documents, kind)
        .filter("error IS NOT NULL")
        .select("project_id", "error", "raw")
    )


def missing_documents(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """``project_id, error, raw`` of projects in ``expected`` without any document."""
    return (
        expected.select("project_id").distinct()
        .join(documents.select("project_id"), "project_id", "left_anti")
        .select("project_id", F.lit("artifact does not exist").alias("error"),
                F.lit(None).cast("string").alias("raw")))


def _loadable(documents: DataFrame, kind: str) -> DataFrame:
    return _checked(documents, kind).filter("error IS NULL")


def _seconds_ms(value: Column, name: str) -> Column:
    return timing.ms_of(field(value, name, "double"))


def read_sources(documents: DataFrame) -> DataFrame:
    document = F.col("document")
    return _loadable(documents, "source").select(
        "project_id",
        *[as_text(document, name).alias(name) for name in REQUIRED["source"]],
        field(document, "title", "string").alias("title"),
    )


def document_sources(documents: DataFrame, kind: str) -> DataFrame:
    """The source recorded inside documents of any stage."""
    return _loadable(documents, kind).select(
        "project_id",
        *[field(F.col("document"), f"source.{name}", "string").alias(name)
          for name in ("source_type", "location", "title")],
    )


def read_transcripts(documents: DataFrame) -> DataFrame:
    """Transcripts without their segments: duration and language."""
    document = F.col("document")
    return _loadable(documents, "transcript").select(
        "project_id",
        field(document, "duration", "double").alias("duration"),
        as_text(document, "language").alias("language"),
        F.size("items").cast("bigint").alias("segments"),
    )


def _segment_fields(value: Column) -> list[Column]:
    return [
        field(value, "id", "bigint").alias("id"),
        _seconds_ms(value, "start").alias("start_ms"),
        _seconds_ms(value, "end").alias("end_ms"),
        as_text(value, "text").alias("text"),
    ]


def _exploded(documents: DataFrame, kind: str) -> DataFrame:
    return _loadable(documents, kind).select(
        "project_id", F.posexplode("items").alias("pos", "item")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def read_segments(documents: DataFrame) -> DataFrame:
    """Segments of transcripts; ``idx`` is the position in the document."""
    return _exploded(documents, "transcript").select(
        "project_id", F.col("pos").alias("idx"), *_segment_fields(F.col("item"))
    )


def read_candidates(documents: DataFrame) -> DataFrame:
    """Candidate windows with their segments and the total their document states."""
    item = F.col("item")
    segments = F.coalesce(
        field(item, "segments", "array<variant>"), F.array().cast("array<variant>")
    )
    total = F.coalesce(
        field(F.col("document"), "total_candidates", "bigint"), F.size("items"))
    return (
        _loadable(documents, "candidates")
        .select("project_id", total.cast("bigint").alias("total_candidates"),
                F.posexplode("items").alias("pos", "item"))
        .select(
            "project_id",
            "total_candidates",
            F.col("pos").cast("bigint").alias("candidate_pos"),
            field(item, "candidate_id", "bigint").alias("candidate_id"),
            _seconds_ms(item, "start_time").alias("start_ms"),
            _seconds_ms(item, "end_time").alias("end_ms"),
            as_text(item, "transcript_text").alias("transcript_text"),
            F.transform(segments, lambda s: F.struct(*_segment_fields(s))).alias("segments"),
        )
    )


def read_evaluations(documents: DataFrame) -> DataFrame:
    item = F.col("item")
    return _exploded(documents, "evaluations").select(
        "project_id",
        F.col("pos").alias("eval_pos"),
        field(item, "candidate_id", "bigint").alias("candidate_id"),
        field(item, "score", "double").alias("score"),
        as_text(item, "reason", "").alias("reason"),
        field(item, "suggested_title", "string").alias("suggested_title"),
    )


def read_clip_plans(documents: DataFrame) -> DataFrame:
    item = F.col("item")
    start, end = _seconds_ms(item, "snapped_start_time"), _seconds_ms(item, "snapped_end_time")
    return _exploded(documents, "clip_plan").select(
        "project_id",
        field(item, "clip_id", "bigint").alias("clip_id"),
        field(item, "candidate_id", "bigint").alias("candidate_id"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        timing.duration_seconds(start, end, 2).alias("duration"),
        field(item, "final_score", "double").alias("final_score"),
        as_text(item, "reason", "").alias("reason"),
        field(item, "title", "string").alias("title"),
    )


def read_packaging(documents: DataFrame) -> DataFrame:
    """Stored publishing metadata, everything read as text."""
    document = F.col("document")
    # A text in place of the list reads as its characters; nulls read ``None``.
    tags = F.transform(
        F.when(kind_of(document, "hashtags") == "STRING",
               F.regexp_extract_all(field(document, "hashtags", "string"), F.lit("(?s)."), F.lit(0)))
        .otherwise(field(document, "hashtags", "array<string>")),
        lambda tag: F.coalesce(tag, F.lit("None")),
    )
    return _loadable(documents, "packaging").select(
        "project_id",
        field(document, "clip_id", "bigint").alias("clip_id"),
        *[as_text(document, name).alias(name) for name in TEXT_FIELDS],
        F.coalesce(tags, F.array().cast("array<string>")).alias("hashtags"),
    )


def normalize_segments(raw: DataFrame, position: str = "raw_pos") -> DataFrame:
    """Recognizer rows (seconds, untrimmed text) as segments numbered from 0 in each source."""
    return number_rows(raw, position, "idx").select(
        "source_id",
        "idx",
        timing.ms_of(F.col("start")).alias("start_ms"),
        timing.ms_of(F.col("end")).alias("end_ms"),
        strip(F.col("text")).alias("text"),
    )


def transcript_headers(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Duration (last end, 0 without segments) and language (``en`` unless known) per source."""
    ends = segments.groupBy("source_id").agg(F.max_by("end_ms", "idx").alias("end_ms"))
    return sources.select("source_id", "language").join(ends, "source_id", "left").select(
        "source_id",
        F.coalesce(timing.seconds(F.col("end_ms")), F.lit(0.0)).alias("duration"),
        F.coalesce("language", F.lit("en")).alias("language"),
    )
