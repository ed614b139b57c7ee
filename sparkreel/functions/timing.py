"""Time columns. Engine time is BIGINT milliseconds from the start of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pause reported before a first segment, and the longest pause that earns a bonus.
FIRST_PAUSE_MS = 999_000
BONUS_PAUSE_MS = 3_000
BONUS_WEIGHT = 3


def to_ms(seconds: float) -> int:
    """A parameter in seconds as whole milliseconds."""
    return round(seconds * 1000)


def seconds(ms: Column) -> Column:
    return ms.cast("double") / F.lit(1000.0)


def ms_of(second: Column) -> Column:
    """A seconds column as whole milliseconds."""
    return F.round(second.cast("double") * 1000).cast("bigint")


def duration_seconds(start_ms: Column, end_ms: Column, digits: int) -> Column:
    return F.round(seconds(end_ms - start_ms), digits)


def centisecond_duration(start_ms: Column, end_ms: Column) -> Column:
    """Window length rounded to two decimals of a second, in ms."""
    return (F.round((end_ms - start_ms) / F.lit(10.0)) * 10).cast("bigint")


def fixed_seconds(ms: Column, digits: int) -> Column:
    """Milliseconds printed as seconds with one or two decimals, halves rounded up."""
    scale = 10**digits
    units = F.floor((ms + 500 // scale) / (1000 // scale))
    return F.format_string(f"%d.%0{digits}d", F.floor(units / scale), units % scale)


def overlap_ratio(
    start_a: Column, end_a: Column, start_b: Column, end_b: Column, *, rounded: bool = False
) -> Column:
    """Shared time over the shorter length; 0 when disjoint or when the shorter has no length.

    ``rounded`` takes lengths rounded to two decimals, as discovery does; planning takes raw ones.
    """
    length = centisecond_duration if rounded else (lambda start, end: end - start)
    shared = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    shorter = F.least(length(start_a, end_a), length(start_b, end_b))
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(F.lit(0.0))


def near_duplicate(
    start_a: Column, end_a: Column, start_b: Column, end_b: Column,
    overlap_threshold: float, tolerance_ms: int,
) -> Column:
    """Heavy overlap, or both boundaries close."""
    close = (F.abs(start_a - start_b) <= tolerance_ms) & (F.abs(end_a - end_b) <= tolerance_ms)
    overlap = overlap_ratio(start_a, end_a, start_b, end_b, rounded=True)
    return (overlap >= overlap_threshold) | close


def end_bonus(pause_after_ms: Column, pause_ms: int) -> Column:
    """Bonus of ending at a segment: none for the last one, NULL where the pause is too short."""
    return F.when(pause_after_ms.isNull(), F.lit(0).cast("bigint")).when(
        pause_after_ms >= pause_ms, F.least(pause_after_ms, F.lit(BONUS_PAUSE_MS)) * BONUS_WEIGHT
    )


def end_score(duration_ms: Column, pause_after_ms: Column, target_ms: int, pause_ms: int) -> Column:
    """Score (in ms) of ending a window there; NULL where no natural end."""
    return end_bonus(pause_after_ms, pause_ms) - F.abs(duration_ms - target_ms)


def subtitle_time(second: Column) -> Column:
    """Seconds as H:MM:SS.cc, half-even centiseconds, negatives as zero."""
    total = F.rint(F.greatest(second, F.lit(0.0)) * 100).cast("bigint")

    def unit(size: int, modulus: int) -> Column:
        return F.floor(total / size) % modulus

    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(total / 360000), unit(6000, 60), unit(100, 60), total % 100
    )
