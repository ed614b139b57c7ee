"""Scorers and packagers plugged into the engine; their output always goes through validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.operators.candidates import BATCH_SIZE, batch_number, evaluation_payloads
from sparkreel.operators.catalog import packaging_title, scoring_title
from sparkreel.operators.responses import (
    TEXT_FIELDS, as_text, classify_failures, clip_transcripts, field, last_key_wins,
    packaging_errors, parse_evaluations, whole_document,
)
from sparkreel.plans.lineage import computed_once, cut_lineage

Responder = Callable[[str, str], str]
# Fixed value: how often a service is asked for one answer.
ATTEMPTS = 3


def _asking(
    respond: Responder, title: str, payload: str
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs a responder over the requests of a partition, one Arrow batch at a time.

    A batch is bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``. A call that fails becomes
    a row with the ``message`` of the failure.
    """

    def ask(t: str, p: str) -> tuple[str | None, str | None]:
        try:
            return respond(t, p), None
        except Exception as error:  # whatever a service may raise is a row, not a lost task
            return None, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [ask(t, p) for t, p in zip(frame[title], frame[payload], strict=True)]
            yield frame.drop(columns=[title, payload]).assign(
                raw=pd.Series([raw for raw, _ in got], frame.index, dtype=object),
                message=pd.Series([message for _, message in got], frame.index, dtype=object))

    return run


@dataclass(frozen=True)
class Asked:
    """``answers``: keys and ``raw``; ``failed``: keys and ``message`` of requests that got no
    answer; ``attempts``: every call, with its number and its ``message`` where it failed."""

    answers: DataFrame
    failed: DataFrame
    attempts: DataFrame


def ask(requests: DataFrame, responder: Responder, most: int = ATTEMPTS) -> Asked:
    """Asks ``responder`` for every request (``title, payload`` beside its keys), inside the tasks.

    Failures that may pass (see ``classify_failures``) are asked again, ``most`` times in all; each
    round is stored before the next, so nobody is asked twice for an answer that has come.
    """
    keys = [name for name in requests.columns if name not in ("title", "payload")]
    kinds = ", ".join(f"{name} {requests.schema[name].dataType.simpleString()}" for name in keys)
    waiting, rounds = requests, []
    for attempt in range(1, most + 1):
        got = cut_lineage(waiting.mapInPandas(
            _asking(responder, "title", "payload"), f"{kinds}, raw string, message string"))
        rounds.append(got.withColumn("attempt", F.lit(attempt)))
        again = classify_failures(got.filter("message IS NOT NULL")).filter("retryable").select(*keys)
        if attempt == most or again.isEmpty():
            break
        waiting = requests.join(again, keys, "left_semi")
    every = reduce(DataFrame.unionAll, rounds)
    last = every.groupBy(*keys).agg(F.max_by("message", "attempt").alias("message"))
    return Asked(
        every.filter("message IS NULL").select(*keys, "raw"),
        last.filter("message IS NOT NULL"),
        every.select(*keys, "attempt", "message"))


def score_requests(
    content: DataFrame, sources: DataFrame, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """One request per batch of candidates: ``source_id, batch, title, payload``."""
    titles = sources.select("source_id", scoring_title(F.col("title")).alias("title"))
    return evaluation_payloads(content, batch_size).join(titles, "source_id", "left").select(
        "source_id", "batch", F.coalesce("title", F.lit("Unknown")).alias("title"), "payload"
    )


def score_candidates(
    content: DataFrame,
    scorer: Column | Callable[[DataFrame], DataFrame] | Responder,
    *,
    sources: DataFrame | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Evaluations of candidates, with ``error`` where a response was malformed.

    ``scorer`` is a score Column over the candidates, or, with ``sources``, a responder
    ``(title, payload) -> raw JSON`` called per batch inside the tasks; otherwise a function from
    candidates to ``source_id, raw`` responses, with their number in ``batch`` if they have one.
    A response that leaves out ids it was asked for is refused: one row with ``error``. For a
    function the answers of a source count together. ``eval_pos`` numbers a source's evaluations.
    """
    if isinstance(scorer, Column):
        score = scorer.cast("double")
        wrong = F.when(score.isNull() | ~score.between(0.0, 10.0), "score out of range")
        return content.select(
            "source_id",
            F.col("candidate_id").alias("eval_pos"),
            "candidate_id",
            score.alias("score"),
            F.lit("").alias("reason"),
            F.lit(None).cast("string").alias("suggested_title"),
            wrong.alias("error"),
        )
    if sources is None:
        responses = scorer(content)
        if "batch" not in responses.columns:
            # Responses without a number are taken in the order of their text.
            along = Window.partitionBy("source_id").orderBy("raw")
            responses = responses.withColumn("batch", F.row_number().over(along).cast("bigint"))
        scope = ["source_id"]
        responses, failed = cut_lineage(responses), None
    else:
        asked = ask(score_requests(content, sources, batch_size), scorer)
        responses, failed = asked.answers, asked.failed
        scope = ["source_id", "batch"]
    parsed = parse_evaluations(responses)
    left_out = _left_out(content, parsed, scope, batch_size)
    along = Window.partitionBy("source_id").orderBy("batch", "item_pos")
    accepted = (
        parsed.join(left_out, scope, "left_anti")
        .withColumn("eval_pos", F.row_number().over(along).cast("bigint")))
    refused = left_out.join(parsed.filter("error IS NULL").select(*scope).distinct(), scope)
    names = ["source_id", "eval_pos", "candidate_id", "score", "reason", "suggested_title", "error"]
    nothing = F.lit(None)

    def without_values(rows: DataFrame, error: Column) -> DataFrame:
        return rows.select(
            "source_id", nothing.cast("bigint").alias("eval_pos"),
            nothing.cast("bigint").alias("candidate_id"), nothing.cast("double").alias("score"),
            nothing.cast("string").alias("reason"),
            nothing.cast("string").alias("suggested_title"), error.alias("error"))

    found = accepted.select(*names).unionByName(
        without_values(refused, F.concat(F.lit("missing candidate ids: "), "ids")))
    if failed is None:
        return found
    return found.unionByName(
        without_values(failed, F.concat(F.lit("no answer: "), "message")))


def _left_out(
    content: DataFrame, parsed: DataFrame, scope: list[str], batch_size: int
) -> DataFrame:
    """Requests (by ``scope``) whose valid response lacks ids that were asked for, and those ids."""
    asked = content.select(
        "source_id", "candidate_id", batch_number(batch_size).alias("batch"))
    given = parsed.filter("candidate_id IS NOT NULL").select(*scope, "candidate_id").distinct()
    answered = parsed.filter("error IS NULL").select(*scope).distinct()
    return (
        asked.join(answered, scope, "left_semi").join(given, [*scope, "candidate_id"], "left_anti")
        .groupBy(*scope)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("candidate_id")),
                                      lambda i: i.cast("string")), ",").alias("ids")))


def package_requests(clips: DataFrame, content: DataFrame, sources: DataFrame) -> DataFrame:
    """One request per packageable clip: ``source_id, clip_id, title, payload``."""
    texts = clip_transcripts(clips, content).filter("error IS NULL").select(
        "source_id", "clip_id", "transcript_text"
    )
    titles = sources.select(
        "source_id", packaging_title(F.col("title"), F.col("location")).alias("source_title")
    )
    payload = F.to_json(
        F.struct(
            "clip_id",
            timing.seconds(F.col("start_ms")).alias("start"),
            timing.seconds(F.col("end_ms")).alias("end"),
            timing.duration_seconds(F.col("start_ms"), F.col("end_ms"), 2).alias("duration"),
            F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("None")).alias("title"),
            "reason",
            "transcript_text",
        )
    )
    return (
        clips.join(texts, ["source_id", "clip_id"])
        .join(titles, "source_id", "left")
        .select("source_id", "clip_id", F.col("source_title").alias("title"),
                payload.alias("payload"))
    )


def read_packaging_responses(responses: DataFrame) -> DataFrame:
    """Valid responses as packaging rows; invalid ones carry ``errors`` and no values."""
    last_key_wins(responses.sparkSession)
    document = F.col("document")
    parsed = computed_once(responses, "document", whole_document(F.col("raw")))
    checked = computed_once(parsed, "errors", packaging_errors(F.col("raw"), document))
    valid = F.size("errors") == 0
    return checked.select(
        "source_id",
        "clip_id",
        *[F.when(valid, as_text(document, name)).alias(name) for name in TEXT_FIELDS],
        F.when(valid, field(document, "hashtags", "array<string>")).alias("hashtags"),
        "errors",
    )


def package_clips(
    clips: DataFrame,
    content: DataFrame,
    packager: Responder | Callable[[DataFrame], DataFrame],
    sources: DataFrame,
    *,
    per_request: bool = True,
) -> DataFrame:
    """Publishing metadata of clips: a responder per clip, or (``per_request=False``) a function
    from requests to ``source_id, clip_id, raw``.

    Answers are stored before they are read. What was refused or never answered is a row with
    ``errors`` and without values.
    """
    requests = package_requests(clips, content, sources)
    if not per_request:
        return read_packaging_responses(cut_lineage(packager(requests)))
    asked = ask(requests, packager)
    read = read_packaging_responses(asked.answers)
    failed = asked.failed.select(
        "source_id", "clip_id", F.array(F.concat(F.lit("no answer: "), "message")).alias("errors"))
    return read.unionByName(failed, allowMissingColumns=True)
