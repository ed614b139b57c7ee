from __future__ import annotations

import random

import pytest

from sparkreel.operators.planning import PlanningOptions, latest_candidates, plan_clips
from sparkreel.schemas import CANDIDATES, EVALUATIONS


def pick(windows: dict, scores: list[tuple], o: PlanningOptions) -> list[int]:
    """Candidate ids in order of choice."""
    kept: list[int] = []
    for position, candidate, score in sorted(scores, key=lambda row: (-row[2], row[0])):
        if score < o.min_score or candidate not in windows or len(kept) >= o.max_clips:
            continue
        start, end = windows[candidate]
        if not o.min_duration * 1000 <= end - start <= o.max_duration * 1000:
            continue
        clash = any(
            min(end, windows[k][1]) - max(start, windows[k][0])
            >= o.overlap_threshold * min(end - start, windows[k][1] - windows[k][0])
            for k in kept
        )
        if not clash:
            kept.append(candidate)
    return kept


@pytest.mark.parametrize("block", [None, 3, 50])
def test_matches_plain_choice(spark, block):
    rng = random.Random(3)
    options = PlanningOptions(max_clips=6)
    candidates, evaluations, expected = [], [], {}
    for source in range(8):
        windows, scores = {}, []
        for candidate in range(1, 120 if source == 0 else 25):
            start = rng.randrange(0, 900) * 500
            windows[candidate] = (start, start + rng.randrange(20, 400) * 500)
            candidates.append((source, candidate, *windows[candidate], 0, 0))
        for position in range(150 if source == 0 else 30):
            scores.append((position, rng.randrange(1, 130), rng.randrange(0, 101) / 10))
            evaluations.append((source, *scores[-1], "r", None))
        expected[source] = pick(windows, scores, options)
    result = plan_clips(
        spark.createDataFrame(candidates, CANDIDATES),
        spark.createDataFrame(evaluations, EVALUATIONS),
        options,
        **({"candidates_per_source": 200} if block is None else {"block": block}),
    ).collect()
    mine: dict[int, list[int]] = {}
    for row in sorted(result, key=lambda r: (r.source_id, r.clip_id)):
        mine.setdefault(row.source_id, []).append(row.candidate_id)
    assert mine == {source: found for source, found in expected.items() if found}


def test_keeps_score_and_title(spark):
    candidates = spark.createDataFrame([(1, 1, 130_000, 150_000, 0, 3)], CANDIDATES)
    evaluations = spark.createDataFrame([(1, 0, 1, 9.0, "Strong.", "A title"),
                                         (1, 1, 2, 10.0, "Unknown candidate.", None)], EVALUATIONS)
    clip = plan_clips(candidates, evaluations, candidates_per_source=40).collect()
    assert [(c.clip_id, c.candidate_id, c.final_score, c.title) for c in clip] == [
        (1, 1, 9.0, "A title")]


def test_refuses_wrong_options():
    for wrong in ({"max_clips": 0}, {"min_duration": 0}, {"overlap_threshold": 0}):
        with pytest.raises(ValueError):
            PlanningOptions(**wrong)


@pytest.mark.parametrize("block", [None, 1, 2, 3])
def test_ties_across_blocks(spark, block):
    """Equal scores at equal positions: none is lost at the border of a block."""
    candidates = spark.createDataFrame(
        [(s, i, i * 100_000, i * 100_000 + 50_000, 0, 3) for s in (1, 2) for i in range(1, 6)],
        CANDIDATES)
    evaluations = spark.createDataFrame(
        [(s, 1, i, 9.0, "r", None) for s in (1, 2) for i in range(1, 6)], EVALUATIONS)
    found = plan_clips(candidates, evaluations, **(
        {"candidates_per_source": 5} if block is None else {"block": block})).collect()
    assert sorted((r.source_id, r.clip_id, r.candidate_id) for r in found) == [
        (s, i, i) for s in (1, 2) for i in range(1, 6)]


def test_last_candidate_of_an_id_wins(spark):
    rows = [(1, 1, 0, 200_000, 260_000), (1, 1, 1, 100_000, 150_000), (1, 2, 0, 300_000, 340_000)]
    found = latest_candidates(spark.createDataFrame(
        rows, "source_id bigint, candidate_id bigint, candidate_pos bigint, start_ms bigint, "
              "end_ms bigint").repartition(3)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 100_000, 150_000), (1, 2, 300_000, 340_000)]
