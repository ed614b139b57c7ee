"""Candidate windows: where a clip could start and end in each source."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.operators.segments import is_natural_start, with_pauses, with_text_flag
from sparkreel.plans.lineage import cut_lineage

# Rows of the per-source index that locates the tail: one per this many segments.
INDEX_RUN = 1_024


@dataclass(frozen=True)
class DiscoveryOptions:
    """Window lengths, pauses and limits; times in seconds."""

    min_seconds: float = 30.0
    max_seconds: float = 90.0
    target_seconds: float = 55.0
    pause_threshold: float = 0.8
    overlap_threshold: float = 0.85
    boundary_tolerance: float = 8.0
    min_advance_seconds: float = 25.0
    min_progress_ratio: float = 0.5
    max_candidates: int = 40
    final_tail_min_seconds: float = 45.0

    def __post_init__(self) -> None:
        rules = {
            "min_seconds must be positive": self.min_seconds > 0,
            "max_seconds must exceed min_seconds": self.max_seconds > self.min_seconds,
            "target_seconds must lie between min_seconds and max_seconds":
                self.min_seconds <= self.target_seconds <= self.max_seconds,
            "pause_threshold cannot be negative": self.pause_threshold >= 0,
            "overlap_threshold must lie in (0, 1]": 0 < self.overlap_threshold <= 1,
            "boundary_tolerance cannot be negative": self.boundary_tolerance >= 0,
            "min_advance_seconds must be positive": self.min_advance_seconds > 0,
            "min_progress_ratio must lie in (0, 1]": 0 < self.min_progress_ratio <= 1,
            "max_candidates must be positive": self.max_candidates > 0,
            "final_tail_min_seconds must be at least min_seconds":
                self.final_tail_min_seconds >= self.min_seconds,
        }
        for message, holds in rules.items():
            if not holds:
                raise ValueError(message)

    @property
    def min_ms(self) -> int:
        return timing.to_ms(self.min_seconds)

    @property
    def max_ms(self) -> int:
        return timing.to_ms(self.max_seconds)

    @property
    def target_ms(self) -> int:
        return timing.to_ms(self.target_seconds)

    @property
    def pause_ms(self) -> int:
        return timing.to_ms(self.pause_threshold)

    @property
    def tolerance_ms(self) -> int:
        return timing.to_ms(self.boundary_tolerance)

    @property
    def advance_ms(self) -> int:
        return max(1, timing.to_ms(self.min_advance_seconds))

    @property
    def tail_ms(self) -> int:
        return timing.to_ms(self.final_tail_min_seconds)

    @property
    def start_buckets(self) -> int:
        """How many non-empty start buckets of ``advance_ms`` can decide a source's chain.

        A window starting past every kept end, and further than the tolerance from the last kept
        start, is never a duplicate; each visit moves on by at least ``advance_ms``. So at most
        ``reach`` rejected windows stand between two kept ones. From one visit to the next the
        chain skips no more than the longest advance, which touches ``skipped`` buckets.
        """
        reach = math.ceil(max(self.max_ms, self.tolerance_ms + 1) / self.advance_ms) + 1
        longest = max(self.advance_ms, math.ceil(self.min_progress_ratio * self.max_ms))
        skipped = longest // self.advance_ms + 2
        return self.max_candidates * reach * skipped


DEFAULTS = DiscoveryOptions()


def _timed(segments: DataFrame) -> DataFrame:
    """The narrow columns discovery works on."""
    return with_text_flag(segments).select("source_id", "idx", "start_ms", "end_ms", "has_text")


def candidate_end_pairs(
    segments: DataFrame, options: DiscoveryOptions = DEFAULTS, *, from_zero: bool = False
) -> DataFrame:
    """Natural starts joined with every segment at which a window from there may end.

    A range join on time: ends fall in buckets as wide as the longest window and each start asks
    its own bucket and the next, so the join key is (source, bucket) and long sources spread out.
    ``from_zero`` also returns the ends before the shortest allowed window, flagged.
    """
    paused = with_pauses(_timed(segments))
    width = options.max_ms
    starts = paused.filter(is_natural_start(options.pause_ms)).select(
        "source_id",
        F.col("idx").alias("start_idx"),
        F.col("start_ms").alias("window_start_ms"),
        F.explode(
            F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("start_ms") / width) + 1)
        ).alias("bucket"),
    )
    ends = paused.select(
        "source_id",
        F.floor(F.col("end_ms") / width).alias("bucket"),
        F.col("idx").alias("end_idx"),
        "end_ms",
        "pause_after_ms",
        "has_text",
    )
    duration = F.col("end_ms") - F.col("window_start_ms")
    lowest = 0 if from_zero else options.min_ms
    return (
        starts.join(ends, ["source_id", "bucket"])
        .filter(
            (F.col("end_idx") >= F.col("start_idx")) & duration.between(lowest, options.max_ms)
        )
        .select(
            "source_id",
            "start_idx",
            F.col("window_start_ms").alias("start_ms"),
            "end_idx",
            "end_ms",
            "has_text",
            (duration >= options.min_ms).alias("long_enough"),
            timing.end_score(
                duration, F.col("pause_after_ms"), options.target_ms, options.pause_ms
            ).alias("score_ms"),
        )
    )


def best_end_of_pairs(pairs: DataFrame) -> DataFrame:
    """Per start: the highest score, ties to the earliest end; else the latest end in range.

    Scores and positions are ranked as one BIGINT (a score takes less than 32 bits, as does the
    number of segments in a window), so that pairs are hashed into one row per start, not sorted.
    """
    scored = F.col("long_enough") & F.col("score_ms").isNotNull()
    rank = F.when(
        scored,
        F.col("score_ms").cast("bigint") * (1 << 32) - (F.col("end_idx") - F.col("start_idx")))
    late = F.when(F.col("long_enough"), F.col("end_idx"))
    chosen = {
        name: F.coalesce(F.max_by(name, rank), F.max_by(name, late)).alias(name)
        for name in ("end_idx", "end_ms")}
    return pairs.groupBy("source_id", "start_idx", "start_ms").agg(
        *chosen.values(),
        F.min(F.when(F.col("has_text"), F.col("end_idx"))).alias("text_idx"),
    )


def window_ends(segments: DataFrame, options: DiscoveryOptions = DEFAULTS) -> DataFrame:
    """Each natural start with its best end; ``end_idx`` is NULL where no end is in range.

    ``text_idx`` is the first segment with text from the start on, within the longest window.

    Up to the target length the score grows with the end time, beyond it the score falls, so in
    both halves the ranking of ends does not depend on the start. That turns the range join into
    two sliding maxima over one sort by time: starts and ends become points on a line, cut into
    tiles per source, with an end repeated in the tile before when starts there can reach it.
    """
    if options.pause_ms == 0:
        # Without a pause in front of a start, earlier segments can end inside its window; only
        # the pair join tells them apart.
        pairs = best_end_of_pairs(candidate_end_pairs(segments, options, from_zero=True))
        starts = _timed(segments).select(
            "source_id", F.col("idx").alias("start_idx"), "start_ms"
        )
        return starts.join(pairs, ["source_id", "start_idx", "start_ms"], "left")

    tile = max(10 * options.max_ms, 600_000)
    no_end = F.lit(None).cast("bigint")
    start_point = F.struct(
        F.floor(F.col("start_ms") / tile).alias("tile"),
        F.col("start_ms").alias("t"),
        F.lit(True).alias("is_start"),
    )
    first_tile = F.floor(F.greatest(F.col("end_ms") - options.max_ms, F.lit(0)) / tile)
    end_points = F.transform(
        F.sequence(first_tile, F.floor(F.col("end_ms") / tile)),
        lambda at: F.struct(
            at.alias("tile"), F.col("end_ms").alias("t"), F.lit(False).alias("is_start")
        ),
    )
    points = (
        with_pauses(_timed(segments))
        .withColumn("bonus", timing.end_bonus(F.col("pause_after_ms"), options.pause_ms))
        .withColumn(
            "point",
            F.explode(
                F.when(
                    is_natural_start(options.pause_ms),
                    F.concat(F.array(start_point), end_points),
                ).otherwise(end_points)
            ),
        )
        .select("source_id", "point.*", "idx", "bonus", "has_text")
    )
    along = Window.partitionBy("source_id", "tile").orderBy("t")
    an_end = ~F.col("is_start")
    scored = an_end & F.col("bonus").isNotNull()

    def top(rank: Column) -> Column:
        return F.max(F.when(scored, F.struct(rank.alias("rank"), (-F.col("idx")).alias("order"),
                                             F.col("t").alias("end_ms"))))

    up_to_target = along.rangeBetween(options.min_ms, options.target_ms)
    past_target = along.rangeBetween(options.target_ms, options.max_ms)
    in_range = along.rangeBetween(options.min_ms, options.max_ms)
    reached = along.rangeBetween(0, options.max_ms)
    latest = F.max(F.when(an_end, F.struct("idx", F.col("t").alias("end_ms"))))
    ranked = points.select(
        "source_id", "idx", F.col("t").alias("start_ms"), "is_start",
        top(F.col("t") + F.col("bonus")).over(up_to_target).alias("low"),
        top(F.col("bonus") - F.col("t")).over(past_target).alias("high"),
        latest.over(in_range).alias("latest"),
        F.min(F.when(an_end & F.col("has_text"), F.col("idx"))).over(reached).alias("text_idx"),
    ).filter("is_start")
    low_score = F.col("low.rank") - F.col("start_ms") - options.target_ms
    high_score = F.col("high.rank") + F.col("start_ms") + options.target_ms

    def as_end(side: str) -> Column:
        return F.struct(
            (-F.col(f"{side}.order")).alias("idx"), F.col(f"{side}.end_ms").alias("end_ms")
        )

    end = (
        F.when(F.col("high").isNull() | (low_score >= high_score), as_end("low"))
        .otherwise(as_end("high"))
    )
    end = F.when(F.col("low").isNotNull(), end).when(F.col("high").isNotNull(), as_end("high"))
    chosen = F.coalesce(end, F.col("latest"))
    return ranked.select(
        "source_id",
        F.col("idx").alias("start_idx"),
        "start_ms",
        F.coalesce(chosen.getField("idx"), no_end).alias("end_idx"),
        F.coalesce(chosen.getField("end_ms"), no_end).alias("end_ms"),
        "text_idx",
    )


def _visitable(options: DiscoveryOptions) -> Column:
    """Starts the chain does not step over: no end at all, or a window with text and in bounds."""
    length = timing.centisecond_duration(F.col("start_ms"), F.col("end_ms"))
    holds_text = F.coalesce(F.col("text_idx") <= F.col("end_idx"), F.lit(False))
    return F.col("end_idx").isNull() | (
        holds_text & length.between(options.min_ms, options.max_ms)
    )


# Start buckets of a tile, of which one row is looked at to find where a chain must end.
BUCKETS_PER_TILE = 256

_WINDOW = "struct<start_idx:bigint,start_ms:bigint,end_idx:bigint,end_ms:bigint>"


def _duplicate_of_any(kept: Column, window: Column, options: DiscoveryOptions) -> Column:
    return F.exists(
        kept,
        lambda other: timing.near_duplicate(
            window["start_ms"], window["end_ms"], other["start_ms"], other["end_ms"],
            options.overlap_threshold, options.tolerance_ms,
        ),
    )


def near_starts(starts: DataFrame, buckets: int) -> DataFrame:
    """Starts in the tiles of a source that hold its first ``buckets`` non-empty buckets (``place``).

    The tiles are found from one row each. Whatever the source's length, no more rows meet by source
    afterwards than those of the buckets wanted and of one more tile.
    """
    tile = F.floor(F.col("place") / BUCKETS_PER_TILE).alias("tile")
    filled = starts.select("source_id", "place").distinct().groupBy("source_id", tile).agg(
        F.count("*").alias("filled"))
    earlier = Window.partitionBy("source_id").orderBy("tile").rowsBetween(
        Window.unboundedPreceding, -1)
    near = filled.withColumn("before", F.coalesce(F.sum("filled").over(earlier), F.lit(0))).filter(
        F.col("before") < buckets).select("source_id", "tile")
    return starts.select("*", tile).join(near, ["source_id", "tile"], "left_semi").drop("tile")


def _chain(ends: DataFrame, options: DiscoveryOptions) -> DataFrame:
    """Greedy walk over the starts of each source: ``source_id, kept ARRAY<window>``.

    Only the first ``start_buckets`` non-empty buckets of a source can matter, so the collected
    array is bounded whatever the source's length.
    """
    starts = ends.filter(_visitable(options)).withColumn(
        "place", F.floor(F.col("start_ms") / options.advance_ms))
    along = Window.partitionBy("source_id").orderBy("place")
    starts = (
        near_starts(cut_lineage(starts), options.start_buckets)
        .withColumn("bucket", F.dense_rank().over(along))
        .filter(F.col("bucket") <= options.start_buckets)
    )
    if options.pause_ms == 0:
        # Starts may share a time when pauses do not part them; the chain visits the first alone.
        starts = starts.groupBy("source_id", "start_ms").agg(
            F.min(F.struct("start_idx", "end_idx", "end_ms")).alias("w")
        ).select("source_id", "start_ms", "w.*")
    walked = starts.groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("start_idx", "start_ms", "end_idx", "end_ms")))
        .alias("windows")
    )
    initial = F.struct(
        F.lit(False).alias("stopped"),
        F.lit(float("-inf")).alias("next_ms"),
        F.array().cast(f"array<{_WINDOW}>").alias("kept"),
    )

    def visit(state: Column, window: Column) -> Column:
        passed = (
            state["stopped"]
            | (F.size(state["kept"]) >= options.max_candidates)
            | (window["start_ms"] < state["next_ms"])
        )
        length = timing.centisecond_duration(window["start_ms"], window["end_ms"])
        advance = F.greatest(
            F.lit(float(options.advance_ms)), length * F.lit(options.min_progress_ratio)
        )
        kept = F.when(_duplicate_of_any(state["kept"], window, options), state["kept"]).otherwise(
            F.array_append(state["kept"], window)
        )
        return (
            F.when(passed, state)
            .when(
                window["end_idx"].isNull(),
                F.struct(F.lit(True).alias("stopped"), state["next_ms"].alias("next_ms"),
                         state["kept"].alias("kept")),
            )
            .otherwise(
                F.struct(F.lit(False).alias("stopped"),
                         (window["start_ms"] + advance).alias("next_ms"), kept.alias("kept"))
            )
        )

    return walked.select("source_id", F.aggregate("windows", initial, visit)["kept"].alias("kept"))


def segment_index(segments: DataFrame) -> DataFrame:
    """One row per run of segments: its bounds and whether it holds text."""
    return (
        _timed(segments)
        .groupBy("source_id", F.floor(F.col("idx") / INDEX_RUN).alias("run"))
        .agg(
            F.min_by("start_ms", "idx").alias("first_start_ms"),
            F.max("start_ms").alias("latest_start_ms"),
            F.max("idx").alias("last_idx"),
            F.max_by("end_ms", "idx").alias("last_end_ms"),
            F.bool_or("has_text").alias("has_text"),
        )
    )


def source_extents(index: DataFrame) -> DataFrame:
    """First start, last position, last end and text flag of each source."""
    return index.groupBy("source_id").agg(
        F.min_by("first_start_ms", "run").alias("first_start_ms"),
        F.max("last_idx").alias("last_idx"),
        F.max_by("last_end_ms", "run").alias("last_end_ms"),
        F.bool_or("has_text").alias("has_text"),
    )


def tail_bounds(
    segments: DataFrame, covered: DataFrame, max_ms: int, index: DataFrame | None = None
) -> DataFrame:
    """Window over what follows a covered time: ``covered(source_id, covered_ms)``.

    Starts at the first segment at or after that time and ends with the last segment that stays
    within ``max_ms``; no row where even the first segment is too long. The index tells the run of
    the first segment and how far the window can reach, so one scan reads the few runs of it.
    """
    index = segment_index(segments) if index is None else index
    runs = index.select("source_id", "run", "first_start_ms", "latest_start_ms")
    first = (
        runs.join(covered.select("source_id", "covered_ms"), "source_id")
        .filter(F.col("latest_start_ms") >= F.col("covered_ms"))
        .groupBy("source_id")
        .agg(F.min(F.struct("run", "latest_start_ms")).alias("first"),
             F.first("covered_ms").alias("covered_ms"))
    )
    # A window starts at the latest start of its first run or before, and no end precedes its start.
    wanted = (
        runs.join(first, "source_id")
        .filter((F.col("run") == F.col("first.run")) | (F.col("run") > F.col("first.run")) & (
            F.col("first_start_ms") <= F.col("first.latest_start_ms") + max_ms))
        .select("source_id", "run", "covered_ms", (F.col("run") == F.col("first.run")).alias("opens"))
    )
    rows = _timed(segments).withColumn("run", F.floor(F.col("idx") / INDEX_RUN)).join(
        wanted, ["source_id", "run"])
    may_open = F.col("opens") & (F.col("start_ms") >= F.col("covered_ms"))
    opening = F.min(F.when(may_open, F.struct("idx", "start_ms"))).over(
        Window.partitionBy("source_id"))
    return (
        rows.withColumn("tail", opening)
        .filter((F.col("idx") >= F.col("tail.idx"))
                & (F.col("end_ms") - F.col("tail.start_ms") <= max_ms))
        .groupBy("source_id", F.col("tail.idx").alias("start_idx"),
                 F.col("tail.start_ms").alias("start_ms"))
        .agg(
            F.max("idx").alias("end_idx"),
            F.max_by("end_ms", "idx").alias("end_ms"),
            F.bool_or("has_text").alias("has_text"),
        )
    )


def discover_candidates(
    segments: DataFrame, options: DiscoveryOptions = DEFAULTS
) -> DataFrame:
    """Candidate windows of every source, numbered from 1 in order of discovery.

    A chain of natural windows that drops near-duplicates, then one window over a long uncovered
    tail, then the whole transcript where nothing was found. ``origin`` tells which. A source
    without any text has no row (see ``unusable_transcripts``). Starts and chains are computed when
    this is called and kept in the shared folder.
    """
    # One row per run, read by the chain and by the tails.
    index = cut_lineage(segment_index(segments))
    empty = F.array().cast(f"array<{_WINDOW}>")
    # Both the tails and the result read the chain; it is walked once.
    chained = cut_lineage(
        source_extents(index)
        .join(_chain(window_ends(segments, options), options), "source_id", "left")
        .withColumn("kept", F.coalesce("kept", empty))
        .withColumn(
            "covered_ms",
            F.greatest(
                F.array_max(F.transform("kept", lambda w: w["end_ms"])), F.col("first_start_ms")
            ),
        )
    )
    open_tail = (F.size("kept") < options.max_candidates) & (
        F.col("last_end_ms") - F.col("covered_ms") >= options.tail_ms
    )
    tails = tail_bounds(
        segments, chained.filter(open_tail), options.max_ms, index
    ).filter("has_text").select(
        "source_id", F.struct("start_idx", "start_ms", "end_idx", "end_ms").alias("tail")
    )
    whole = F.struct(
        F.lit(0).cast("bigint").alias("start_idx"), F.col("first_start_ms").alias("start_ms"),
        F.col("last_idx").alias("end_idx"), F.col("last_end_ms").alias("end_ms"),
    )
    tail_holds = (
        F.col("tail").isNotNull()
        & (F.col("last_end_ms") - F.col("tail.start_ms") >= options.min_ms)
        & ~_duplicate_of_any(F.col("kept"), F.col("tail"), options)
    )

    def labelled(windows: Column, origin: str) -> Column:
        return F.transform(
            windows,
            lambda w: F.struct(
                w["start_idx"].alias("start_idx"), w["start_ms"].alias("start_ms"),
                w["end_idx"].alias("end_idx"), w["end_ms"].alias("end_ms"),
                F.lit(origin).alias("origin"),
            ),
        )

    found = (
        F.when(tail_holds, F.concat(labelled(F.col("kept"), "chain"),
                                    labelled(F.array("tail"), "tail")))
        .when(F.size("kept") > 0, labelled(F.col("kept"), "chain"))
        .when(F.col("has_text"), labelled(F.array(whole), "whole"))
    )
    return (
        chained.join(tails, "source_id", "left")
        .select("source_id", F.posexplode(found).alias("position", "w"))
        .select(
            "source_id",
            (F.col("position") + 1).cast("bigint").alias("candidate_id"),
            "w.start_ms", "w.end_ms", "w.start_idx", "w.end_idx", "w.origin",
        )
    )


def near_duplicate_pairs(windows: DataFrame, options: DiscoveryOptions = DEFAULTS) -> DataFrame:
    """Pairs of windows of a source that count as the same narrative.

    Near-duplicates lie close in time, so windows meet in the time tiles they touch (widened by
    the tolerance) and a pair is reported in the first tile both share.
    """
    tile = options.max_ms + options.tolerance_ms
    first = F.floor(F.greatest(F.col("start_ms") - options.tolerance_ms, F.lit(0)) / tile)
    tiled = windows.select("source_id", "start_idx", "start_ms", "end_ms").withColumn(
        "first_tile", first
    ).withColumn(
        "tile",
        F.explode(F.sequence("first_tile", F.floor((F.col("end_ms") + options.tolerance_ms) / tile))),
    )
    left, right = tiled.alias("a"), tiled.alias("b")
    same = timing.near_duplicate(
        F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms"),
        options.overlap_threshold, options.tolerance_ms,
    )
    return (
        left.join(
            right,
            (F.col("a.source_id") == F.col("b.source_id"))
            & (F.col("a.tile") == F.col("b.tile"))
            & (F.col("a.start_idx") < F.col("b.start_idx"))
            & (F.col("a.tile") == F.greatest("a.first_tile", "b.first_tile"))
            & same,
        )
        .select(
            F.col("a.source_id").alias("source_id"),
            F.col("a.start_idx").alias("start_idx"),
            F.col("b.start_idx").alias("other_start_idx"),
            timing.overlap_ratio(
                F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms"),
                rounded=True,
            ).alias("overlap"),
        )
    )


def next_natural_starts(
    windows: DataFrame, options: DiscoveryOptions = DEFAULTS
) -> DataFrame:
    """For each window, the natural start that follows after enough progress (NULL: none).

    ``windows`` are natural starts with their ends. A forward as-of lookup: inside a time tile by
    a window function, past the tile from the first start of the next tile that has one.
    """
    tile = 10 * options.max_ms
    length = timing.centisecond_duration(F.col("start_ms"), F.col("end_ms"))
    earliest = F.col("start_ms") + F.greatest(
        F.lit(float(options.advance_ms)), length * F.lit(options.min_progress_ratio)
    )
    start = F.struct(F.col("start_ms"), F.col("start_idx"))
    points = windows.select(
        "source_id",
        "start_idx",
        F.explode(
            F.array(
                F.struct(F.col("start_ms").cast("double").alias("t"), start.alias("start")),
                F.struct(
                    F.when(F.col("end_ms").isNotNull(), earliest).alias("t"),
                    F.lit(None).cast("struct<start_ms:bigint,start_idx:bigint>").alias("start"),
                ),
            )
        ).alias("point"),
    ).select("source_id", "start_idx", "point.*").filter("t IS NOT NULL").withColumn(
        "tile", F.floor(F.col("t") / tile)
    )
    # Probes sort before the starts of the same time.
    nearest = F.expr(
        "lead(start) IGNORE NULLS OVER "
        "(PARTITION BY source_id, tile ORDER BY t, start IS NOT NULL)"
    )
    following_tile = points.groupBy("source_id", "tile").agg(F.min("start").alias("first")).select(
        "source_id",
        "tile",
        F.expr("lead(first) IGNORE NULLS OVER (PARTITION BY source_id ORDER BY tile)")
        .alias("later"),
    )
    return (
        points.withColumn("nearest", nearest)
        .filter("start IS NULL")
        .join(following_tile, ["source_id", "tile"])
        .select(
            "source_id",
            "start_idx",
            F.coalesce("nearest", "later").getField("start_idx").alias("next_start_idx"),
        )
    )


def covered_ends(candidates: DataFrame, extents: DataFrame) -> DataFrame:
    """How far the accepted windows of each source reach; its first start where there are none."""
    reached = candidates.groupBy("source_id").agg(F.max("end_ms").alias("end_ms"))
    return extents.join(reached, "source_id", "left").select(
        "source_id",
        F.greatest(F.col("end_ms"), F.col("first_start_ms")).alias("covered_ms"),
    )
