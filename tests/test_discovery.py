"""Discovery against a plain walk over each transcript, on random transcripts."""

from __future__ import annotations

import random

import pytest

from sparkreel.operators import discovery, segments
from sparkreel.operators.discovery import DiscoveryOptions, discover_candidates
from sparkreel.schemas import SEGMENTS


def transcript(rng: random.Random, count: int, blanks: float, touching: bool) -> list[tuple]:
    rows, clock = [], 0
    for idx in range(count):
        clock += 0 if touching and rng.random() < 0.3 else rng.choice([0, 150, 900, 1500, 4000])
        start = clock
        clock += rng.choice([1000, 3500, 7000, 12000, 30000, 95000])
        rows.append((idx, start, clock, " " if rng.random() < blanks else f"w{idx}"))
    return rows


def rounded(window: tuple) -> int:
    return round((window[2] - window[1]) / 10) * 10


def alike(a: tuple, b: tuple, o: DiscoveryOptions) -> bool:
    shared = min(a[2], b[2]) - max(a[1], b[1])
    shorter = min(rounded(a), rounded(b))
    heavy = shared > 0 and shorter > 0 and shared / shorter >= o.overlap_threshold
    return heavy or all(abs(a[k] - b[k]) <= o.tolerance_ms for k in (1, 2))


def walk(rows: list[tuple], o: DiscoveryOptions) -> list[tuple]:
    """(start_idx, start_ms, end_ms, end_idx) of every window, in order."""
    last = len(rows) - 1

    def natural(i: int) -> bool:
        return i == 0 or max(0, rows[i][1] - rows[i - 1][2]) >= o.pause_ms

    def best_end(i: int) -> int | None:
        reach = [j for j in range(i, last + 1)
                 if o.min_ms <= rows[j][2] - rows[i][1] <= o.max_ms]
        ranked = []
        for j in reach:
            pause = None if j == last else rows[j + 1][1] - rows[j][2]
            if pause is None or pause >= o.pause_ms:
                bonus = 0 if pause is None else 3 * min(pause, 3000)
                ranked.append((bonus - abs(rows[j][2] - rows[i][1] - o.target_ms), -j))
        return -max(ranked)[1] if ranked else (reach[-1] if reach else None)

    def has_text(i: int, j: int) -> bool:
        return any(row[3].strip() for row in rows[i:j + 1])

    kept: list[tuple] = []
    not_before = -1.0
    for i in range(last + 1):
        if len(kept) >= o.max_candidates:
            break
        if rows[i][1] < not_before or not natural(i):
            continue
        j = best_end(i)
        if j is None:
            break
        if not has_text(i, j):
            continue
        window = (i, rows[i][1], rows[j][2], j)
        if not any(alike(window, other, o) for other in kept):
            kept.append(window)
        not_before = rows[i][1] + max(o.advance_ms, rounded(window) * o.min_progress_ratio)

    covered = max([rows[0][1], *[window[2] for window in kept]])
    if len(kept) < o.max_candidates and rows[-1][2] - covered >= o.tail_ms:
        i = next((k for k in range(last + 1) if rows[k][1] >= covered), None)
        if i is not None and rows[-1][2] - rows[i][1] >= o.min_ms:
            inside = [j for j in range(i, last + 1) if rows[j][2] - rows[i][1] <= o.max_ms]
            if inside and has_text(i, inside[-1]):
                window = (i, rows[i][1], rows[inside[-1]][2], inside[-1])
                if not any(alike(window, other, o) for other in kept):
                    kept.append(window)
    if not kept and has_text(0, last):
        kept.append((0, rows[0][1], rows[-1][2], last))
    return kept


OPTIONS = [
    DiscoveryOptions(),
    DiscoveryOptions(pause_threshold=0.0),
    DiscoveryOptions(max_candidates=3, overlap_threshold=0.4, boundary_tolerance=30.0),
    DiscoveryOptions(min_seconds=5, target_seconds=5, max_seconds=20, min_advance_seconds=2.5,
                     final_tail_min_seconds=10, max_candidates=6),
]


@pytest.mark.parametrize("options", OPTIONS, ids=["default", "no_pause", "few", "short"])
def test_matches_plain_walk(spark, options, monkeypatch):
    # Short runs, so that neighbours, tails and texts cross their borders.
    monkeypatch.setattr(segments, "RUN_LENGTH", 7)
    monkeypatch.setattr(discovery, "INDEX_RUN", 5)
    rng = random.Random(11)
    sources = {
        source: transcript(rng, rng.choice([1, 2, 5, 40, 160]), rng.choice([0, 0.5, 0.95]),
                           source % 2 == 0)
        for source in range(60)
    }
    rows = [(source, *row) for source, found in sources.items() for row in found]
    result = discover_candidates(spark.createDataFrame(rows, SEGMENTS), options).collect()
    mine: dict[int, list[tuple]] = {}
    for row in sorted(result, key=lambda r: (r.source_id, r.candidate_id)):
        mine.setdefault(row.source_id, []).append(
            (row.start_idx, row.start_ms, row.end_ms, row.end_idx))
    expected = {source: walk(found, options) for source, found in sources.items()}
    assert mine == {source: found for source, found in expected.items() if found}


def test_one_long_source(spark):
    rng = random.Random(5)
    rows = transcript(rng, 6000, 0.0, False)
    frame = spark.createDataFrame([(1, *row) for row in rows], SEGMENTS)
    options = DiscoveryOptions(max_candidates=5)
    mine = [(r.start_idx, r.start_ms, r.end_ms, r.end_idx)
            for r in discover_candidates(frame, options).orderBy("candidate_id").collect()]
    assert mine == walk(rows, options)


@pytest.mark.parametrize("most", [5, 40, 200])
def test_few_starts_of_a_long_source_meet(spark, most):
    """However many candidates are wanted: the buckets that matter, and at most one tile more."""
    options = DiscoveryOptions(max_candidates=most)
    starts = spark.range(60_000).selectExpr("1L AS source_id", "id DIV 3 * 2 AS place", "id")
    near = discovery.near_starts(starts, options.start_buckets)
    places = {r.place for r in near.collect()}
    wanted = set(range(0, 2 * options.start_buckets, 2))
    assert wanted <= places
    assert len(places) <= options.start_buckets + discovery.BUCKETS_PER_TILE
    assert near.count() == 3 * len(places)


def test_bounds_of_ten_even_segments(spark):
    rows = [(1, i, i * 9000, i * 9000 + 8000, f"text {i}") for i in range(10)]
    found = discover_candidates(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert found and all(30_000 <= r.end_ms - r.start_ms <= 90_000 for r in found)


def test_short_source_becomes_one_window(spark):
    rows = [(1, 0, 0, 5200, "Hello world."), (1, 1, 5200, 12400, "Bye.")]
    only = discover_candidates(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert [(r.start_ms, r.end_ms, r.origin) for r in only] == [(0, 12400, "whole")]


@pytest.mark.parametrize("wrong", [
    {"min_seconds": 0}, {"max_seconds": 30}, {"target_seconds": 91}, {"pause_threshold": -1},
    {"overlap_threshold": 0}, {"boundary_tolerance": -1}, {"min_advance_seconds": 0},
    {"min_progress_ratio": 1.5}, {"max_candidates": 0}, {"final_tail_min_seconds": 20},
])
def test_refuses_wrong_options(wrong):
    with pytest.raises(ValueError):
        DiscoveryOptions(**wrong)


def test_numbering_across_spans(spark):
    rows = [(source, position) for source in range(3) for position in range(0, 400, 1 + source)]
    numbered = segments.number_rows(
        spark.createDataFrame(rows, "source_id bigint, position bigint"), "position", "n", span=16)
    for source in range(3):
        got = [r.n for r in numbered.filter(f"source_id = {source}").orderBy("position").collect()]
        assert got == list(range(len(got)))


def test_ends_of_pairs_are_not_sorted(spark):
    rows = [
        (1, 0, 0, 4, 30_000, True, True, -500), (1, 0, 0, 5, 31_000, True, True, 200),
        (1, 0, 0, 6, 31_000, True, True, 200), (1, 0, 0, 7, 32_000, False, True, None),
        (1, 0, 0, 1, 9_000, False, False, 900), (1, 3, 5, 8, 40_000, False, True, None),
        (1, 3, 5, 9, 41_000, True, True, None), (2, 0, 0, 1, 5_000, False, False, 7)]
    pairs = spark.createDataFrame(
        rows, "source_id long, start_idx long, start_ms long, end_idx long, end_ms long, "
        "has_text boolean, long_enough boolean, score_ms long")
    best = discovery.best_end_of_pairs(pairs)
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, best.collect())) == [
        (1, 0, 0, 5, 31_000, 4), (1, 3, 5, 9, 41_000, 9), (2, 0, 0, None, None, None)]
