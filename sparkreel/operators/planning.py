"""Choice of the clips of each source: best scores first, no heavy overlaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.plans.lineage import cut_lineage

# Ranked evaluations of one source that are folded in one go.
RANK_BLOCK = 1_000


@dataclass(frozen=True)
class PlanningOptions:
    """Score, length and overlap rules; times in seconds."""

    min_score: float = 7.0
    max_clips: int = 10
    min_duration: float = 15.0
    max_duration: float = 180.0
    overlap_threshold: float = 0.5

    def __post_init__(self) -> None:
        if self.max_clips < 1:
            raise ValueError("max_clips must be at least 1")
        if not 0 < self.min_duration <= self.max_duration:
            raise ValueError("durations must satisfy 0 < min_duration <= max_duration")
        if not 0 < self.overlap_threshold <= 1:
            raise ValueError("overlap_threshold must lie in (0, 1]")


DEFAULTS = PlanningOptions()


def eligible_evaluations(evaluations: DataFrame, min_score: float = 7.0) -> DataFrame:
    return evaluations.filter(F.col("score") >= min_score)


def rank_evaluations(evaluations: DataFrame) -> DataFrame:
    """Evaluations of each source, best score first, equal scores in their given order."""
    return evaluations.orderBy("source_id", F.col("score").desc(), "eval_pos")


def within_duration(windows: DataFrame, options: PlanningOptions = DEFAULTS) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    return windows.filter(
        length.between(timing.to_ms(options.min_duration), timing.to_ms(options.max_duration))
    )


def latest_candidates(candidates: DataFrame, position: str = "candidate_pos") -> DataFrame:
    """One window per candidate id, the last given one.

    Without a column ``position`` rows have no order; then the latest window is taken.
    """
    order = [name for name in (position, "start_ms", "end_ms") if name in candidates.columns]
    return (
        candidates.groupBy("source_id", "candidate_id")
        .agg(F.max_by(F.struct("start_ms", "end_ms"), F.struct(*order)).alias("w"))
        .select("source_id", "candidate_id", "w.*")
    )


def evaluated_candidates(
    candidates: DataFrame, evaluations: DataFrame, position: str = "candidate_pos"
) -> DataFrame:
    """Evaluations with the times of their candidates; unknown candidates fall away."""
    return evaluations.join(
        latest_candidates(candidates, position), ["source_id", "candidate_id"]
    )


_CLIP = (
    "array<struct<rank:double,eval_pos:bigint,candidate_id:bigint,start_ms:bigint,end_ms:bigint,"
    "score:double,reason:string,title:string>>"
)


def _overlaps_any(kept: Column, start: Column, end: Column, threshold: float) -> Column:
    return F.exists(
        kept,
        lambda clip: timing.overlap_ratio(start, end, clip["start_ms"], clip["end_ms"])
        >= threshold,
    )


def _select(ranked: Column, kept: Column, options: PlanningOptions) -> Column:
    """Kept clips after walking ranked ones in order."""

    def step(state: Column, clip: Column) -> Column:
        full = F.size(state) >= options.max_clips
        clash = _overlaps_any(state, clip["start_ms"], clip["end_ms"], options.overlap_threshold)
        return F.when(full | clash, state).otherwise(F.array_append(state, clip))

    return F.aggregate(ranked, kept, step)


def _in_rank_order(clips: DataFrame) -> DataFrame:
    ranked = F.struct("rank", "eval_pos", "candidate_id", "start_ms", "end_ms",
                      "score", "reason", "title")
    return clips.groupBy("source_id").agg(
        F.sort_array(F.collect_list(ranked)).cast(_CLIP).alias("ranked")
    )


def _first_block(clips: DataFrame, block: int) -> DataFrame:
    along = Window.partitionBy("source_id").orderBy("rank", "eval_pos", "candidate_id")
    return clips.withColumn("n", F.row_number().over(along)).filter(F.col("n") <= block).drop("n")


def _select_in_blocks(clips: DataFrame, options: PlanningOptions, block: int) -> DataFrame:
    """Selection for sources of any size: a block of ranks at a time.

    What follows a block only matters where the source is not full yet and the row clashes with
    no kept clip, so every further round keeps at least one clip per open source and at most
    ``max_clips`` rounds run; sources within one block need none.
    """
    none = F.array().cast(_CLIP)
    chosen = cut_lineage(
        _in_rank_order(_first_block(clips, block)).select(
            "source_id",
            _select(F.col("ranked"), none, options).alias("kept"),
            F.element_at("ranked", -1).alias("reached"),
            (F.size("ranked") >= block).alias("more"),
        )
    )
    rest = clips
    while True:
        open_sources = chosen.filter(F.col("more") & (F.size("kept") < options.max_clips))
        rest = cut_lineage(
            rest.join(open_sources.select("source_id", "kept", "reached"), "source_id")
            .filter(
                F.struct("rank", "eval_pos", "candidate_id")
                > F.struct("reached.rank", "reached.eval_pos", "reached.candidate_id")
            )
            .filter(
                ~_overlaps_any(F.col("kept"), F.col("start_ms"), F.col("end_ms"),
                               options.overlap_threshold)
            )
            .drop("kept", "reached")
        )
        if rest.isEmpty():
            return chosen.select("source_id", "kept")
        further = _in_rank_order(_first_block(rest, block))
        chosen = cut_lineage(
            chosen.join(further, "source_id", "left").select(
                "source_id",
                F.when(F.col("ranked").isNull(), F.col("kept"))
                .otherwise(_select(F.col("ranked"), F.col("kept"), options)).alias("kept"),
                F.coalesce(F.element_at("ranked", -1), "reached").alias("reached"),
                F.coalesce(F.size("ranked") >= block, F.lit(False)).alias("more"),
            )
        )


def plan_clips(
    candidates: DataFrame,
    evaluations: DataFrame,
    options: PlanningOptions = DEFAULTS,
    *,
    candidates_per_source: int | None = None,
    block: int = RANK_BLOCK,
) -> DataFrame:
    """The strongest clips of each source that do not overlap heavily, numbered by rank.

    Evaluations are first reduced to the best one per candidate (a second one would clash with
    itself). Equal ranks go by ``eval_pos``, then by ``candidate_id``, so the order is total and
    both ways of choosing agree. ``candidates_per_source`` is a known bound, such as ``max_candidates`` of discovery;
    when it fits one block the plan stays lazy, otherwise sources are worked off in blocks.
    """
    best = (
        eligible_evaluations(evaluations, options.min_score)
        .withColumn("rank", -F.col("score"))
        .groupBy("source_id", "candidate_id")
        .agg(
            F.min(
                F.struct("rank", "eval_pos", "score", "reason",
                         F.col("suggested_title").alias("title"))
            ).alias("e")
        )
        .select("source_id", "candidate_id", "e.*")
    )
    clips = within_duration(
        best.join(latest_candidates(candidates), ["source_id", "candidate_id"]), options
    )
    if candidates_per_source is not None and candidates_per_source <= block:
        chosen = _in_rank_order(clips).select(
            "source_id", _select(F.col("ranked"), F.array().cast(_CLIP), options).alias("kept")
        )
    else:
        chosen = _select_in_blocks(cut_lineage(clips), options, block)
    return chosen.select("source_id", F.posexplode("kept").alias("position", "clip")).select(
        "source_id",
        (F.col("position") + 1).cast("bigint").alias("clip_id"),
        "clip.candidate_id",
        "clip.start_ms",
        "clip.end_ms",
        F.col("clip.score").alias("final_score"),
        "clip.reason",
        "clip.title",
    )
