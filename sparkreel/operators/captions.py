"""Timed captions of clips, subtitle documents and edit plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import escape_dialogue, single_spaced, strip, word_count
from sparkreel.plans.lineage import computed_once

# Clips and segments meet in tiles of this length.
TILE_MS = 300_000
# Before they are shuffled, segments are held against a hashed set of the slots that clips touch.
SLOT_MS = 15_000
PLACES = 1 << 26

# Subtitle alignment code by horizontal and vertical position.
ALIGNMENT_CODES = {
    "left": {"top": 7, "center": 4, "lower_middle": 4, "bottom": 1},
    "center": {"top": 8, "center": 5, "lower_middle": 2, "bottom": 2},
    "right": {"top": 9, "center": 6, "lower_middle": 6, "bottom": 3},
}
# The subtitle document around the style values and dialogue lines.
DOCUMENT_TOP = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\n"
    "ScaledBorderAndShadow: yes\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, "
    "Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, "
    "Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
)
STYLE_COLOURS = "&H00FFFFFF,&H00FFFFFF,&H00000000,&H80000000"
STYLE_SCALING = "0,0,0,100,100,0,0,1"
EVENTS_TOP = (
    "\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


# Field names and defaults of captions.
@dataclass(frozen=True)
class CaptionOptions:
    max_words: int = 6
    max_characters: int = 32
    max_lines: int = 2
    font_name: str = "Arial"
    font_size: int = 54
    font_weight: str = "bold"
    horizontal_alignment: str = "center"
    vertical_position: str = "lower_middle"
    horizontal_margin: int = 80
    vertical_margin: int = 500
    outline_width: int = 4
    shadow: bool = True

    def __post_init__(self) -> None:
        if self.vertical_position not in ALIGNMENT_CODES.get(self.horizontal_alignment, {}):
            raise ValueError(
                f"unknown caption position {self.horizontal_alignment}/{self.vertical_position}"
            )


# Field names and defaults of an edit.
@dataclass(frozen=True)
class EditOptions:
    canvas_width: int = 1080
    canvas_height: int = 1920
    blur_radius: float = 32.0
    background_brightness: float = 0.58
    foreground_scale: float = 1.0
    video_codec: str = "libx264"
    audio_codec: str = "aac"
    crf: int = 18
    audio_bitrate: str = "128k"
    output_format: str = "mp4"

    def __post_init__(self) -> None:
        if self.canvas_width <= 0 or self.canvas_height <= 0:
            raise ValueError("canvas sizes must be positive")
        if self.blur_radius < 0:
            raise ValueError("blur_radius must not be negative")
        if not 0 < self.background_brightness <= 1:
            raise ValueError("background_brightness must lie in (0, 1]")
        if self.foreground_scale <= 0:
            raise ValueError("foreground_scale must be positive")


DEFAULTS = CaptionOptions()


def _place(slot: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("source_id").cast("string"), slot.cast("bigint")), F.lit(PLACES))


def near_clips(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments without most of those that no clip overlaps.

    Clips mark the slots in which a segment may begin that is no longer than a slot and overlaps
    them. The marks are the bits of ``PLACES`` places, 64 to a row, so the broadcast side is bounded
    for any number of clips; hash collisions and long segments only leave more rows in.
    """
    before = F.floor(F.col("start_ms") / SLOT_MS) - 1
    slots = clips.select("source_id", F.explode(F.sequence(
        before, F.greatest(before, F.floor(F.col("end_ms") / SLOT_MS)))).alias("slot"))
    place = F.col("place")
    marks = slots.select(_place(F.col("slot")).alias("place")).groupBy(
        F.shiftright(place, 6).alias("word")
    ).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("marks"))
    marked = F.expr("(marks & shiftleft(1L, CAST(place % 64 AS INT))) <> 0")
    long = F.col("end_ms") - F.col("start_ms") > SLOT_MS
    return (
        segments.withColumn("place", _place(F.floor(F.col("start_ms") / SLOT_MS)))
        .withColumn("word", F.shiftright(place, 6))
        .join(F.broadcast(marks), "word", "left")
        .filter(marked | long)
        .drop("word", "place", "marks")
    )


def segments_in_clips(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Each clip with the segments that overlap it in time.

    Both sides are spread over the time tiles they touch and meet on (source, tile); a pair is
    kept in the first tile the two share. Clips are read twice, first to leave out most segments
    before their text is shuffled. A tile holds few clips, so the join hashes them and sorts nothing.
    """

    def tiled(rows: DataFrame, start: str, end: str, first: str) -> DataFrame:
        low = F.floor(F.col(start) / TILE_MS)
        high = F.greatest(low, F.floor(F.col(end) / TILE_MS))
        return rows.withColumn(first, low).withColumn("tile", F.explode(F.sequence(low, high)))

    clip_rows = tiled(
        clips.select("source_id", "clip_id", F.col("start_ms").alias("clip_start_ms"),
                     F.col("end_ms").alias("clip_end_ms")),
        "clip_start_ms", "clip_end_ms", "clip_tile",
    )
    segment_rows = tiled(
        near_clips(clips, segments.select("source_id", "idx", "start_ms", "end_ms", "text")),
        "start_ms", "end_ms", "segment_tile",
    )
    return (
        segment_rows.join(clip_rows.hint("shuffle_hash"), ["source_id", "tile"])
        .filter(
            (F.col("end_ms") > F.col("clip_start_ms"))
            & (F.col("start_ms") < F.col("clip_end_ms"))
            & (F.col("tile") == F.greatest("segment_tile", "clip_tile"))
        )
        .drop("tile", "segment_tile", "clip_tile")
    )


def clip_relative(pairs: DataFrame) -> DataFrame:
    """Segments cut to their clip, in time from its start; empty and blank ones are dropped."""
    start = F.greatest("start_ms", "clip_start_ms") - F.col("clip_start_ms")
    end = F.least("end_ms", "clip_end_ms") - F.col("clip_start_ms")
    text = strip(F.col("text"))
    return pairs.filter((end > start) & (text != "")).select(
        "source_id", "clip_id", "idx",
        start.alias("start_ms"), end.alias("end_ms"), text.alias("text"),
    )


def packing_pattern(max_words: int, max_characters: int) -> str:
    """Matches one chunk at the end of the previous one: as many words as fit, at least one."""
    if max_words < 1 or max_characters < 1:
        raise ValueError("a chunk must hold at least one word and one character")
    word = "[^ ]++"
    # Naming a character beyond 16 bits makes the look-behind count whole characters.
    character = "[\\x00-\U0010ffff]"
    fitting = rf"(?:{word} ){{0,{max_words - 1}}}{word}(?<=\G{character}{{1,{max_characters}}})"
    return rf"(?:{fitting}|{word})(?: |$)"


def chunked(text: Column, max_words: int, max_characters: int) -> Column:
    """Text packed into chunks: ``array<struct(text, first_word, words)>``.

    A chunk ends when it has ``max_words`` words or the next word would not fit; a word longer
    than a whole chunk stands alone. One regular expression packs the text, then only the chunks
    are folded to count the words before each.
    """
    return packed(single_spaced(text), max_words, max_characters)


def packed(spaced: Column, max_words: int, max_characters: int) -> Column:
    """The same of a text whose words are parted by one space each."""
    pieces = F.transform(
        F.regexp_extract_all(
            spaced, F.lit(packing_pattern(max_words, max_characters)), F.lit(0)
        ),
        lambda piece: F.rtrim(piece),
    )
    empty = F.struct(
        F.array().cast("array<struct<text:string,first_word:int,words:int>>").alias("done"),
        F.lit(0).alias("seen"),
    )

    def add(state: Column, piece: Column) -> Column:
        count = word_count(piece)
        chunk = F.struct(piece.alias("text"), state["seen"].alias("first_word"),
                         count.alias("words"))
        return F.struct(F.array_append(state["done"], chunk).alias("done"),
                        (state["seen"] + count).alias("seen"))

    return F.aggregate(pieces, empty, add, lambda state: state["done"])


def caption_chunks(rows: DataFrame, options: CaptionOptions = DEFAULTS) -> DataFrame:
    """Text rows split into caption chunks, ``chunk_idx`` counting from 0 within each row."""
    return _with_chunks(rows, options).drop("_spaced")


def _with_chunks(rows: DataFrame, options: CaptionOptions) -> DataFrame:
    """The same with ``_spaced``, the text the chunks were packed from.

    Spark would filter rows by the size of what is exploded, with a copy of the packing in each such
    filter; so texts are spaced and packed below a generator, once each.
    """
    rows = computed_once(rows, "_spaced", single_spaced(F.col("text")))
    rows = computed_once(
        rows, "_chunks", packed(F.col("_spaced"), options.max_words, options.max_characters))
    return rows.select("*", F.posexplode("_chunks").alias("chunk_idx", "chunk")).drop(
        "_chunks").withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def time_captions(rows: DataFrame, options: CaptionOptions = DEFAULTS) -> DataFrame:
    """Chunks of each text row, timed in proportion to their words.

    Each row's chunks carry the words before them, so the times need no window function.
    """
    chunks = _with_chunks(rows, options).withColumn("total_words", word_count(F.col("_spaced")))
    start = timing.seconds(F.col("start_ms"))
    length = timing.seconds(F.col("end_ms")) - start
    total_words = F.nullif(F.col("total_words"), F.lit(0))
    chunk = F.col("chunk")
    return chunks.select(
        *[name for name in rows.columns if name not in ("text", "start_ms", "end_ms")],
        "chunk_idx",
        (start + length * chunk["first_word"] / total_words).alias("start_time"),
        (start + length * (chunk["first_word"] + chunk["words"]) / total_words).alias("end_time"),
        chunk["text"].alias("text"),
        chunk["words"].cast("bigint").alias("words"),
    )


def captions(
    clips: DataFrame, segments: DataFrame, options: CaptionOptions = DEFAULTS
) -> DataFrame:
    """Clip-relative captions: ``source_id, clip_id, idx, chunk_idx, start_time, end_time, text``."""
    return time_captions(clip_relative(segments_in_clips(clips, segments)), options)


def captions_per_clip(timed: DataFrame) -> DataFrame:
    """Ordered caption list of each clip."""
    ordered = F.sort_array(
        F.collect_list(F.struct("idx", "chunk_idx", "start_time", "end_time", "text"))
    )
    return timed.groupBy("source_id", "clip_id").agg(ordered.alias("ordered")).select(
        "source_id",
        "clip_id",
        F.transform(
            "ordered",
            lambda c: F.struct(
                c["start_time"].alias("start_time"), c["end_time"].alias("end_time"),
                c["text"].alias("text"), F.lit(False).alias("emphasis"),
            ),
        ).alias("captions"),
    )


def alignment_code(horizontal: Column, vertical: Column) -> Column:
    """Subtitle alignment 1..9; NULL for an unknown position."""
    entries = [
        F.lit(item)
        for side, codes in ALIGNMENT_CODES.items()
        for place, code in codes.items()
        for item in (f"{side}/{place}", code)
    ]
    return F.try_element_at(F.create_map(*entries), F.concat_ws("/", horizontal, vertical))


def vertical_margin(vertical: Column, margin: Column) -> Column:
    """The margin, except that centred captions have none."""
    return F.when(vertical.isin("lower_middle", "bottom", "top"), margin).otherwise(F.lit(0))


def style_line(options: CaptionOptions = DEFAULTS) -> str:
    """The style line of a subtitle document."""
    code = ALIGNMENT_CODES[options.horizontal_alignment][options.vertical_position]
    margin = 0 if options.vertical_position == "center" else options.vertical_margin
    values = [
        "Default", options.font_name, options.font_size, STYLE_COLOURS,
        int(options.font_weight == "bold"), STYLE_SCALING, options.outline_width,
        int(options.shadow), code, options.horizontal_margin, options.horizontal_margin, margin, 1,
    ]
    return "Style: " + ",".join(map(str, values)) + "\n"


def dialogue_line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Dialogue: 0,"), timing.subtitle_time(start), F.lit(","), timing.subtitle_time(end),
        F.lit(",Default,,0,0,0,,"), escape_dialogue(text), F.lit("\n"),
    )


def subtitle_documents(
    clips: DataFrame, timed: DataFrame, options: CaptionOptions = DEFAULTS
) -> DataFrame:
    """One subtitle document per clip, clips without captions included."""
    lines = timed.groupBy("source_id", "clip_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "idx", "chunk_idx",
                    dialogue_line(F.col("start_time"), F.col("end_time"), F.col("text"))
                    .alias("line"),
                )
            )
        ).alias("lines")
    )
    body = F.coalesce(F.array_join(F.transform("lines", lambda row: row["line"]), ""), F.lit(""))
    top = DOCUMENT_TOP + style_line(options) + EVENTS_TOP
    return clips.select("source_id", "clip_id").join(lines, ["source_id", "clip_id"], "left").select(
        "source_id", "clip_id", F.concat(F.lit(top), body).alias("document")
    )


def _literal_struct(**values: object) -> Column:
    return F.struct(
        *[
            (value if isinstance(value, Column) else F.lit(value)).alias(name)
            for name, value in values.items()
        ]
    )


def edit_plans(
    clips: DataFrame,
    timed: DataFrame,
    caption_options: CaptionOptions = DEFAULTS,
    edit: EditOptions | None = None,
) -> DataFrame:
    """Composition, captions and render settings of each clip."""
    edit = edit or EditOptions()
    composition = _literal_struct(
        canvas=_literal_struct(width=edit.canvas_width, height=edit.canvas_height),
        background=_literal_struct(
            source="same_video", blur_radius=edit.blur_radius,
            brightness=edit.background_brightness,
        ),
        foreground=_literal_struct(preserve_aspect_ratio=True, scale=edit.foreground_scale),
    )
    style = _literal_struct(
        **{
            name: getattr(caption_options, name)
            for name in (
                "font_size", "font_name", "font_weight", "horizontal_alignment",
                "vertical_position", "horizontal_margin", "vertical_margin", "max_lines",
                "outline_width", "shadow",
            )
        }
    )
    render = _literal_struct(
        video_codec=edit.video_codec, audio_codec=edit.audio_codec, crf=edit.crf,
        audio_bitrate=edit.audio_bitrate, output_format=edit.output_format,
    )
    none = F.array().cast("array<struct<start_time:double,end_time:double,text:string,emphasis:boolean>>")
    return (
        clips.select("source_id", "clip_id")
        .join(captions_per_clip(timed), ["source_id", "clip_id"], "left")
        .select(
            "source_id",
            F.format_string("clip_%02d", "clip_id").alias("clip_name"),
            composition.alias("composition"),
            _literal_struct(
                segments=F.coalesce("captions", none), style=style, enabled=True
            ).alias("captions"),
            render.alias("render_config"),
        )
    )
