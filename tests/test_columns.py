"""Identity, names, durations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparkreel.functions import identity
from sparkreel.functions.text import WHITESPACE, safe_filename
from sparkreel.operators import catalog, thumbnails
from sparkreel.schemas import CLIPS


def column(spark, values, make):
    frame = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r[0] for r in frame.orderBy("n").select(make(F.col("v"))).collect()]


def test_whitespace_is_that_of_python():
    assert sorted(WHITESPACE) == [c for c in map(chr, range(0x110000)) if c.isspace()]


def test_file_names(spark):
    titles = ["Test Clip", "A: Test / Clip?", "   ---   ", "x" * 90, "a\x01b|c", " .é."]
    assert column(spark, titles, safe_filename) == [
        "Test Clip", "A_ Test _ Clip", "untitled", "x" * 80, "a_b_c", "é"]
    clips = spark.createDataFrame([(1, 1, 1, 0, 1, 9.0, "", "A: Test / Clip?"),
                                   (1, 2, 2, 0, 1, 9.0, "", "")], CLIPS)
    assert [r.file_path for r in catalog.output_paths(clips).orderBy("clip_id").collect()] == [
        "clips/clip_01_A_ Test _ Clip.mp4", "clips/clip_02_Clip 2.mp4"]


def test_video_ids(spark):
    cases = {
        "https://www.youtube.com/watch?v=abcDEF_-123": "abcDEF_-123",
        "https://youtu.be/abcDEF_-123?si=x": "abcDEF_-123",
        "  HTTPS://user@M.YouTube.com:443/shorts/abcdef/extra": "abcdef",
        "https://youtube.com/watch?x=1&v=&v=second1&v=third12": "second1",
        "https://youtube.com/watch?v=%61bcdef": "abcdef",
        "https://youtube.com/watch?v=abcde": None,
        "https://youtube.com/watch?v=abcdef%0A": None,
        "https://youtube.com/embed/": None,
        "https://youtube.com/live/abcdef;p": "abcdef",
        "https://www.youtu.be//abcdef": "abcdef",
        "youtube.com/watch?v=abcdef": None,
        "https://example.com/watch?v=abcdef": None,
    }
    assert column(spark, list(cases), identity.video_id) == list(cases.values())


def test_one_project_for_every_spelling(spark):
    urls = ["https://www.youtube.com/watch?v=abcDEF_-123", "https://youtu.be/abcDEF_-123"]
    assert set(column(spark, urls, lambda c: identity.source_identity(c)["project_id"])) == {
        "youtube_abcDEF_-123"}


def test_local_and_unnamed_projects(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    listing = "https://www.youtube.com/playlist?list=1"
    paths = [f" {listing} ", "/Data//My Film (1).final.mp4", "/data/.mp4", "/data/???.mp4"]
    got = column(spark, paths, lambda c: identity.source_identity(c)["project_id"])
    assert got == [
        f"youtube_{digest(listing)}",
        "local_My_Film_1_final_" + digest("/data/my film (1).final.mp4"),
        "local_mp4_" + digest("/data/.mp4"),
        "local_local_file_" + digest("/data/???.mp4"),
    ]


def test_frames(spark):
    row = spark.range(1).select(
        thumbnails.frame_timestamps(F.lit(100.0)).alias("f")
    ).select("f", thumbnails.middle_frame(F.col("f")).alias("m")).first()
    assert [round(t, 9) for t in row.f] == [10, 25, 40, 55, 70, 85]
    assert round(row.m, 9) == 55
