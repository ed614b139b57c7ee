"""Texts of clips and candidates."""

import random
import time

from sparkreel.operators import candidates as content_ops
from sparkreel.operators.responses import clip_transcripts
from sparkreel.schemas import CANDIDATES, SEGMENTS


def test_only_texts_of_clips_are_shuffled(spark):
    rng, size = random.Random(5), 1 << 18
    rows = [(1, i, rng.randbytes(size // 2).hex()) for i in range(40)]
    content = spark.createDataFrame(rows, "source_id long, candidate_id long, transcript_text string")
    clips = spark.createDataFrame([(1, 1, 7)], "source_id long, clip_id long, candidate_id long")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(True).apply(0).totalShuffleWrite()
    found = clip_transcripts(clips, content).collect()
    time.sleep(1)
    assert store.executorList(True).apply(0).totalShuffleWrite() - before < 4 * size
    assert [(r.candidate_id, r.transcript_text, r.error) for r in found] == [(7, rows[7][2], None)]


def test_windows_within_and_across_runs(spark):
    run = content_ops.JOIN_RUN
    segments = spark.createDataFrame(
        [(1, i, i * 1000, i * 1000 + 900, f"s{i}") for i in range(2 * run + 5)], SEGMENTS)
    spans = [(0, 3), (run - 2, run + 1), (run, run), (run - 1, 2 * run + 1)]
    windows = spark.createDataFrame(
        [(1, n, a * 1000, b * 1000 + 900, a, b) for n, (a, b) in enumerate(spans)], CANDIDATES)
    found = {r.candidate_id: r.transcript_text
             for r in content_ops.build_candidates(windows, segments).collect()}
    assert found == {n: " ".join(f"s{i}" for i in range(a, b + 1)) for n, (a, b) in enumerate(spans)}
