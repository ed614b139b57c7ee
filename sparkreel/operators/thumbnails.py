"""Thumbnail plans: which frame, which text, which look."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import strip

# Frame positions as shares of the clip length.
FRAME_POSITIONS = (0.10, 0.25, 0.40, 0.55, 0.70, 0.85)


# What numeric options may be: the smallest value, whether it is allowed itself, the largest value.
PERMITTED = {
    "width": (0, False, None), "height": (0, False, None), "font_size": (0, False, None),
    "text_stroke_width": (0, True, None), "visual_center_x": (0, True, 1),
    "visual_center_y": (0, True, 1), "visual_scale": (0, False, None),
    "text_width_fraction": (0, False, 1),
}
NOT_BLANK = ("font_name", "background_color", "background_accent_color")


def _check(options: object) -> None:
    for name, value in asdict(options).items():
        if name in NOT_BLANK and not value.strip():
            raise ValueError(f"{name} must not be empty")
        if name in PERMITTED:
            low, touching, high = PERMITTED[name]
            if value < low or (value == low and not touching) or (high is not None and value > high):
                raise ValueError(f"{name} = {value} is out of range")


# Field names and defaults of a thumbnail's style and composition.
@dataclass(frozen=True)
class ThumbnailStyle:
    width: int = 1080
    height: int = 1920
    font_name: str = "Arial"
    font_size: int = 88
    font_weight: str = "bold"
    text_color: str = "#FFFFFF"
    text_stroke_color: str = "#000000"
    text_stroke_width: int = 4
    background_mode: str = "gradient"
    background_color: str = "#111111"
    background_accent_color: str = "#333333"
    text_position: str = "bottom"

    def __post_init__(self) -> None:
        _check(self)


@dataclass(frozen=True)
class ThumbnailComposition:
    visual_center_x: float = 0.5
    visual_center_y: float = 0.42
    visual_scale: float = 1.0
    horizontal_anchor: str = "center"
    vertical_anchor: str = "center"
    text_width_fraction: float = 0.82

    def __post_init__(self) -> None:
        _check(self)


def frame_timestamps(
    duration: Column, positions: Sequence[float] = FRAME_POSITIONS
) -> Column:
    """Candidate frame times, in seconds, away from both ends of a clip."""
    rising = list(positions) == sorted(set(positions))
    if not positions or not rising or not all(0 < p < 1 for p in positions):
        raise ValueError("positions must rise strictly between 0 and 1")
    return F.array(*[duration * F.lit(float(position)) for position in positions])


def middle_frame(frames: Column) -> Column:
    return F.get(frames, F.floor(F.size(frames) / 2).cast("int"))


def thumbnail_plans(
    packaging: DataFrame,
    clips: DataFrame,
    *,
    select: Callable[[Column], Column] = middle_frame,
    positions: Sequence[float] = FRAME_POSITIONS,
    style: ThumbnailStyle | None = None,
    composition: ThumbnailComposition | None = None,
) -> DataFrame:
    """One plan per packaged clip; ``select`` picks a frame out of the array of candidates.

    Clips without length or text cannot be planned and are left out.
    """

    def literal(values: object) -> Column:
        return F.struct(*[F.lit(value).alias(name) for name, value in asdict(values).items()])

    duration = timing.seconds(F.col("end_ms") - F.col("start_ms"))
    text = strip(F.col("thumbnail_text"))
    return (
        packaging.select("source_id", "clip_id", "thumbnail_text")
        .join(clips.select("source_id", "clip_id", "start_ms", "end_ms"), ["source_id", "clip_id"])
        .filter((F.col("end_ms") > F.col("start_ms")) & (text != "") & (F.col("clip_id") >= 0))
        .select(
            "source_id",
            "clip_id",
            select(frame_timestamps(duration, positions)).alias("frame_timestamp"),
            text.alias("text"),
            literal(composition or ThumbnailComposition()).alias("composition"),
            literal(style or ThumbnailStyle()).alias("style"),
        )
    )
