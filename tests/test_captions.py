from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import escape_dialogue
from sparkreel.operators import captions as ops
from sparkreel.operators.captions import CaptionOptions
from sparkreel.schemas import SEGMENTS


def pack(text: str, max_words: int, max_characters: int) -> list[str]:
    chunks: list[list[str]] = []
    for word in text.split():
        open_chunk = chunks[-1] if chunks else None
        if open_chunk and len(open_chunk) < max_words and \
                len(" ".join([*open_chunk, word])) <= max_characters:
            open_chunk.append(word)
        else:
            chunks.append([word])
    return [" ".join(chunk) for chunk in chunks]


words = st.text(st.sampled_from("ab.é漢🎬{\\-"), min_size=1, max_size=40)
texts = st.lists(st.tuples(words, st.sampled_from([" ", "  ", "\t", "\n", " ", "  "])),
                 max_size=30).map(lambda parts: "".join(w + gap for w, gap in parts))


@settings(max_examples=6, deadline=None, database=None, phases=[Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=40, max_size=120), st.integers(1, 8), st.integers(1, 40))
def test_chunks_match_plain_packing(spark, batch, max_words, max_characters):
    frame = spark.createDataFrame(list(enumerate(batch)), "id int, text string")
    got = {
        row.id: row.chunks
        for row in frame.select(
            "id", ops.chunked(F.col("text"), max_words, max_characters).alias("chunks")
        ).collect()
    }
    for at, text in enumerate(batch):
        assert [chunk.text for chunk in got[at]] == pack(text, max_words, max_characters)
        counts = [len(chunk.text.split()) for chunk in got[at]]
        assert [chunk.words for chunk in got[at]] == counts
        assert [chunk.first_word for chunk in got[at]] == [
            sum(counts[:k]) for k in range(len(counts))]


def caption_rows(spark, rows, start, end, **options):
    segments = spark.createDataFrame(
        [(1, i, int(s * 1000), int(e * 1000), text) for i, (s, e, text) in enumerate(rows)],
        SEGMENTS)
    clips = spark.createDataFrame(
        [(1, 1, int(start * 1000), int(end * 1000))],
        "source_id bigint, clip_id bigint, start_ms bigint, end_ms bigint")
    timed = ops.captions(clips, segments, CaptionOptions(**options))
    return [(r.start_time, r.end_time, r.text)
            for r in timed.orderBy("idx", "chunk_idx").collect()]


def test_known_captions(spark):
    assert caption_rows(spark, [(0, 4, "This is a test caption.")], 0, 4) == [
        (0.0, 4.0, "This is a test caption.")]
    many = caption_rows(
        spark, [(0, 6, "one two three four five six seven eight nine ten eleven twelve")], 0, 6)
    assert len(many) > 1 and many[0][0] == 0.0 and many[-1][1] == 6.0
    assert caption_rows(spark, [(0, 2, ""), (2, 4, "   ")], 0, 4) == []
    assert caption_rows(spark, [(48, 52, "First part."), (53, 57, "Second part.")], 48, 57,
                        max_words=100) == [(0.0, 4.0, "First part."), (5.0, 9.0, "Second part.")]
    assert caption_rows(spark, [(45, 55, "Cut here.")], 48, 52) == [(0.0, 4.0, "Cut here.")]
    assert [row[2] for row in caption_rows(
        spark, [(10, 20, "Before"), (48, 52, "Inside"), (60, 70, "After")], 45, 55)] == ["Inside"]


def test_subtitle_times_and_escapes(spark):
    seconds = [0.0, 1.25, 65.5, 3661.75, -3.0, 0.025, 0.035]
    frame = spark.createDataFrame([(s,) for s in seconds], "s double")
    assert [r[0] for r in frame.select(timing.subtitle_time(F.col("s"))).collect()] == [
        "0:00:00.00", "0:00:01.25", "0:01:05.50", "1:01:01.75", "0:00:00.00", "0:00:00.02",
        "0:00:00.04"]
    text = spark.createDataFrame([("a\\b{c}\nd",)], "t string")
    assert text.select(escape_dialogue(F.col("t"))).first()[0] == "a\\\\b\\{c\\}\\Nd"


def test_document_has_style_and_dialogue(spark):
    assert ops.style_line().startswith("Style: Default,Arial,54,")
    assert ops.style_line().endswith(",1,4,1,2,80,80,500,1\n")
    clips = spark.createDataFrame([(1, 1, 0, 4000), (1, 2, 9000, 9500)],
                                  "source_id bigint, clip_id bigint, start_ms bigint, end_ms bigint")
    segments = spark.createDataFrame([(1, 0, 0, 4000, "Hi {you}")], SEGMENTS)
    documents = {r.clip_id: r.document for r in ops.subtitle_documents(
        clips, ops.captions(clips, segments)).collect()}
    assert documents[1].endswith("Dialogue: 0,0:00:00.00,0:00:04.00,Default,,0,0,0,,Hi \\{you\\}\n")
    assert documents[2].endswith("Effect, Text\n")


def test_segments_far_from_clips_are_not_shuffled(spark):
    segments = spark.range(20_000).selectExpr(
        "id % 4 AS source_id", "id div 4 AS idx", "(id div 4) * 4000 - 9000 AS start_ms",
        "(id div 4) * 4000 - 9000 + IF(id % 41 = 0, 95000, 3000) AS end_ms", "'x' AS text")
    clips = spark.createDataFrame(
        [(s, c, c * 900_000 + s * 7_001, c * 900_000 + s * 7_001 + 60_000)
         for s in range(4) for c in range(5)],
        "source_id int, clip_id bigint, start_ms bigint, end_ms bigint")
    kept = ops.near_clips(clips, segments)
    assert kept.columns == segments.columns and kept.count() < 3_000
    segments.createOrReplaceTempView("all_segments")
    clips.createOrReplaceTempView("all_clips")
    expected = spark.sql(
        "SELECT s.source_id, clip_id, idx FROM all_segments s JOIN all_clips c"
        " ON s.source_id = c.source_id AND s.end_ms > c.start_ms AND s.start_ms < c.end_ms")
    found = ops.segments_in_clips(clips, segments).select("source_id", "clip_id", "idx")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_texts_are_packed_once(spark):
    clips = spark.createDataFrame(
        [(1, 1, 0, 9000)], "source_id long, clip_id long, start_ms long, end_ms long")
    segments = spark.createDataFrame(
        [(1, 0, 0, 4000, "One two  three."), (1, 1, 4000, 8000, None)],
        "source_id long, idx long, start_ms long, end_ms long, text string")
    timed = ops.captions(clips, segments)
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == plan.count("regexp_extract_all") == 1
    assert [row.text for row in timed.collect()] == ["One two three."]
    chunks = ops.caption_chunks(segments)
    assert chunks.columns == [*segments.columns, "chunk_idx", "chunk"]
    assert [(r.idx, r.chunk_idx, r.chunk.text) for r in chunks.collect()] == [
        (0, 0, "One two three.")]
