"""Responses of scorers and packagers: parsing, validation, failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.functions.text import has_text, strip
from sparkreel.operators.candidates import missing_per_batch
from sparkreel.plans.lineage import computed_once

# Fields of a packaging response.
TEXT_FIELDS = ["title", "hook", "caption", "description", "thumbnail_text", "content_angle"]
REQUIRED_FIELDS = TEXT_FIELDS + ["hashtags"]
# Words in an error message that tell its class, first match wins.
INGESTION_MARKERS = {
    "unavailable": ["private", "unavailable", "removed"],
    "network": ["network", "unable to download"],
}
AUDIO_MARKERS = {"corrupt": ["corrupt", "invalid"]}
SCORING_MARKERS = {
    "rate_limit": ["429", "resource_exhausted"],
    "transient": [
        "500", "502", "503", "504", "unavailable", "timeout", "timed out", "connection reset",
        "connection error",
    ],
}
RETRYABLE_MARKERS = [
    "408", "429", "500", "502", "503", "504", "timeout", "timed out", "temporarily unavailable",
    "service unavailable", "connection reset", "connection aborted",
]
PACKAGING_RETRY_MARKERS = [
    "503", "502", "504", "429", "408", "unavailable", "timeout", "timed out",
]
# Hashed places that clips mark.
PLACES = 1 << 26


def last_key_wins(spark: SparkSession) -> None:
    """Lets the session read JSON objects that repeat a key; the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def framed(raw: Column) -> Column:
    """A text parsed as the first of two elements, the second of which is its own digest.

    The parser stops after the first value; another value or an early end in the text moves the
    digest away or drops it.
    """
    return F.try_parse_json(
        F.concat(F.lit("["), raw, F.lit(',"'), F.sha2(raw, 256), F.lit('"]')))


def unframed(pair: Column, raw: Column) -> Column:
    """The JSON value that a text consists of, NULL if it is none or anything stands behind it."""
    return F.when(
        F.try_variant_get(pair, "$[1]", "string") == F.sha2(raw, 256),
        F.try_variant_get(pair, "$[0]", "variant"))


def whole_document(raw: Column) -> Column:
    """The JSON value that a text consists of, NULL if it is none or anything stands behind it."""
    # Bound to a lambda variable, the text is parsed once.
    return F.transform(F.array(framed(raw)), lambda pair: unframed(pair, raw))[0]


# No shorter text fills a parsed value or holds a string beyond the parser's limit.
LARGE_BYTES = 1 << 24


def parse_error(raw: Column) -> Column:
    """Why text did not become a document: too large for one value, or no JSON at all."""
    large = (F.octet_length(raw) >= LARGE_BYTES) & F.get_json_object(raw, "$").isNotNull()
    return F.when(large, "document too large").otherwise("invalid JSON")


def field(document: Column, name: str, kind: str) -> Column:
    """A field of a parsed document; NULL when absent or not readable as that type."""
    return F.try_variant_get(document, f"$.{name}", kind)


def kind_of(document: Column, name: str) -> Column:
    """Type name of a field, VOID for JSON null, NULL when absent."""
    return F.schema_of_variant(field(document, name, "variant"))


def as_text(document: Column, name: str, default: str | None = None) -> Column:
    """A field as text: JSON null reads ``None``, an absent field gives the default."""
    kind = kind_of(document, name)
    value = field(document, name, "string")
    return (
        F.when(kind.isNull(), F.lit(default))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(value))
        # A number written with a point keeps it, as in 5.0.
        .when(kind.startswith("DECIMAL") & ~value.contains("."), F.concat(value, F.lit(".0")))
        .otherwise(value)
    )


def _items(document: Column) -> Column:
    """Elements of a JSON array, NULL for anything else."""
    return F.try_variant_get(document, "$", "array<variant>")


def _item_error(item: Column) -> Column:
    score = field(item, "score", "double")
    return (
        F.when(~F.schema_of_variant(item).startswith("OBJECT"), "item is not an object")
        .when(field(item, "candidate_id", "bigint").isNull(), "bad candidate_id")
        .when(score.isNull(), "bad score")
        .when(~score.between(0.0, 10.0), "score out of range")
    )


def parse_evaluations(responses: DataFrame) -> DataFrame:
    """Scoring responses (``raw`` JSON arrays) as evaluations.

    One malformed item rejects its whole response: such a response yields one row with ``error``
    and without values. ``item_pos`` is the position in the response.
    """
    last_key_wins(responses.sparkSession)
    kept = [name for name in responses.columns if name != "raw"]
    parsed = computed_once(
        computed_once(responses, "document", whole_document(F.col("raw"))),
        "items", _items(F.col("document")),
    )
    wrong = F.filter(F.transform("items", _item_error), lambda error: error.isNotNull())
    error = (
        F.when(F.col("document").isNull(), parse_error(F.col("raw")))
        .when(F.col("items").isNull(), "not an array")
        .otherwise(F.get(wrong, F.lit(0)))
    )
    checked = computed_once(parsed, "error", error)
    return (
        checked.withColumn("items", F.when(F.col("error").isNull(), F.col("items")))
        .select(
            *[F.col(name).alias(f"response_{name}" if name == "candidate_id" else name)
              for name in kept],
            "error",
            F.posexplode_outer("items").alias("item_pos", "item"),
        )
        .filter(F.col("item").isNotNull() | F.col("error").isNotNull())
        .select(
            "*",
            field(F.col("item"), "candidate_id", "bigint").alias("candidate_id"),
            field(F.col("item"), "score", "double").alias("score"),
            as_text(F.col("item"), "reason", "").alias("reason"),
            field(F.col("item"), "suggested_title", "string").alias("suggested_title"),
        )
        .withColumn("reason", F.when(F.col("error").isNull(), F.col("reason")))
        .drop("item")
    )


def returned_ids(evaluations: DataFrame, batch: Column) -> DataFrame:
    """``source_id, batch, ids``: the distinct ids that came back in each batch, in order."""
    return evaluations.groupBy("source_id", batch.alias("batch")).agg(
        F.sort_array(F.collect_set("candidate_id")).alias("ids"))


def incomplete_batches(
    candidates: DataFrame, evaluations: DataFrame, batch_size: int = 40
) -> DataFrame:
    """Batches whose response must be refused, with the ids it left out."""
    return missing_per_batch(candidates, evaluations, batch_size).select(
        "source_id",
        "batch",
        F.array_join(F.transform("missing_ids", lambda i: i.cast("string")), ",")
        .alias("missing_ids"),
    )


def missing_fields(raw: Column) -> Column:
    """Required packaging fields a JSON object lacks, in alphabetical order."""
    present = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(name) for name in sorted(REQUIRED_FIELDS)]), present)


def packaging_errors(raw: Column, document: Column) -> Column:
    """Everything wrong with a packaging response and its value; an empty array means valid."""
    # Bound to a lambda variable, the keys are listed once.
    return F.transform(
        F.array(missing_fields(raw)), lambda absent: _packaging_errors(document, absent))[0]


def _packaging_errors(document: Column, absent: Column) -> Column:

    def text_error(name: str) -> Column:
        kind = kind_of(document, name)
        blank = strip(field(document, name, "string")) == ""
        return F.when(kind != "STRING", f"{name} must be a string").when(
            blank, f"{name} cannot be empty"
        )

    tags = kind_of(document, "hashtags")
    odd_tag = F.exists(
        field(document, "hashtags", "array<variant>"),
        lambda tag: F.coalesce(F.schema_of_variant(tag), F.lit("VOID")) != "STRING",
    )
    tag_error = F.when(~tags.startswith("ARRAY"), "hashtags must be a list").when(
        odd_tag, "every hashtag must be a string"
    )
    found = F.array_compact(
        F.array(
            F.when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ","))),
            *[text_error(name) for name in TEXT_FIELDS],
            tag_error,
        )
    )
    return (
        F.when(document.isNull(), F.array(F.lit("invalid JSON")))
        .when(~F.schema_of_variant(document).startswith("OBJECT"),
              F.array(F.lit("not an object")))
        .otherwise(found)
    )


def validate_packaging(responses: DataFrame) -> DataFrame:
    """Packaging responses (``raw``) with ``errors``."""
    last_key_wins(responses.sparkSession)
    parsed = computed_once(responses, "document", whole_document(F.col("raw")))
    return computed_once(
        parsed, "errors", packaging_errors(F.col("raw"), F.col("document"))).drop("document")


def stored_packaging_error(document: Column) -> Column:
    """Why a stored packaging document cannot be loaded (looser than a fresh response)."""
    absent = F.array_compact(
        F.array(
            F.when(field(document, "clip_id", "bigint").isNull(), F.lit("clip_id")),
            *[F.when(kind_of(document, name).isNull(), F.lit(name)) for name in TEXT_FIELDS],
        )
    )
    tags = kind_of(document, "hashtags")
    return (
        F.when(document.isNull(), F.lit("invalid JSON"))
        .when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ",")))
        .when(tags.isNotNull() & ~tags.startswith("ARRAY") & (tags != "STRING"),
              F.lit("hashtags is not a list"))
    )


def invalid_packaging(stored: DataFrame) -> DataFrame:
    """Stored packaging (``raw``) that has to be made again, with the reason."""
    last_key_wins(stored.sparkSession)
    parsed = computed_once(stored, "document", whole_document(F.col("raw")))
    return computed_once(parsed, "error", stored_packaging_error(F.col("document"))).filter(
        F.col("error").isNotNull()).drop("raw", "document")


def _near(clips: DataFrame, content: DataFrame) -> DataFrame:
    """The content without most of the candidates that are no clip, before its text is shuffled.

    Clips mark hashed places, 64 to a row, so the broadcast side is bounded for any number of them.
    """
    place = F.pmod(
        F.xxhash64(F.col("source_id").cast("string"), F.col("candidate_id").cast("string")),
        F.lit(PLACES))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    marks = (
        clips.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(bit).alias("marks")))
    return (
        content.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
        .join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(bit) != 0)
        .drop("word", "place", "marks"))


def clip_transcripts(clips: DataFrame, content: DataFrame) -> DataFrame:
    """Clips with the text of their candidate and, where that is missing or blank, the error."""
    order = [name for name in ("candidate_pos", "start_ms", "end_ms") if name in content.columns]
    first = F.struct(*order, "transcript_text")  # the first candidate given under an id
    texts = _near(clips, content).groupBy("source_id", "candidate_id").agg(
        F.min_by("transcript_text", first).alias("transcript_text")
    )
    error = F.when(F.col("transcript_text").isNull(), "candidate not found").when(
        ~has_text(F.col("transcript_text")), "candidate has no text"
    )
    return (
        clips.select("source_id", "clip_id", "candidate_id")
        .join(texts, ["source_id", "candidate_id"], "left")
        .withColumn("error", error)
    )


def unpackageable_clips(clips: DataFrame, content: DataFrame) -> DataFrame:
    return clip_transcripts(clips, content).filter("error IS NOT NULL").drop("transcript_text")


def _contains_any(message: Column, markers: list[str]) -> Column:
    return reduce(Column.__or__, [message.contains(marker) for marker in markers])


def _classed(message: Column, markers: dict[str, list[str]], other: str) -> Column:
    chosen = F.lit(other)
    for name, words in reversed(markers.items()):
        chosen = F.when(_contains_any(message, words), name).otherwise(chosen)
    return chosen


def classify_failures(attempts: DataFrame) -> DataFrame:
    """An attempt log (``message``) with the class of each failure per stage, and whether to retry."""
    message = F.lower("message")
    return (
        attempts.withColumn("ingestion_class", _classed(message, INGESTION_MARKERS, "other"))
        .withColumn("audio_class", _classed(message, AUDIO_MARKERS, "other"))
        .withColumn("scoring_class", _classed(message, SCORING_MARKERS, "fatal"))
        .withColumn("retryable", _contains_any(message, RETRYABLE_MARKERS))
        .withColumn("packaging_retry", _contains_any(message, PACKAGING_RETRY_MARKERS))
    )


def failure_counts(attempts: DataFrame) -> DataFrame:
    keys = ["ingestion_class", "audio_class", "scoring_class", "retryable", "packaging_retry"]
    return classify_failures(attempts).groupBy(*keys).agg(F.count(F.lit(1)).alias("failures"))
