"""Hard negatives against scoring every row, and what the bounds leave unscored."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkreel.llm import hard_negatives as hn
from sparkreel.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tile int"


def plain(rows, positives=5, negatives=3):
    """Counted result rows, from rows (vec_id, vector, label)."""
    good = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        good.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))

    def first(scored):
        return sorted(scored, key=lambda s: (-s[0], s[1] is not None, s[1] or 0))

    out = Counter()
    for at, (anchor, own, label) in enumerate(good):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(own, v)), i, other == label)
                  for k, (i, v, other) in enumerate(good) if k != at]
        for p, positive, _ in first(s for s in scored if s[2])[:positives]:
            inside = [s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p]
            for rank, (n, negative, _) in enumerate(first(inside)[:negatives], 1):
                out[(anchor, positive, rank, negative, p, n)] += 1
    return out


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = hn.mine_hard_negatives(table, hn.MiningOptions(**options))
    return Counter(tuple(r) for r in found.collect())


def clusters(seed, number, dims=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((10, dims))
    label = rng.integers(0, 10, number)
    vectors = centre[label] + spread * rng.standard_normal((number, dims))
    return [(i * 5, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, label))]


@pytest.mark.parametrize("options", [{}, dict(tile_values=100, block_values=100, group_rows=64)])
def test_against_plain(spark, options):
    rows = clusters(1, 300) + [(5 * i, v, k) for i, v, k in clusters(2, 80, 4)]
    rows += [(None, rows[3][1], rows[3][2]), (10**6, None, 1), (10**6 + 50, [1.0, None], 2),
             (10**6 + 100, rows[0][1], None), (10**6 + 150, [float("nan")] * 12, 3),
             (10**6 + 200, [float("inf")] * 12, 3), (10**6 + 250, [], 4), (10**6 + 300, [1.0], 4)]
    rows += rows[40:60] + [(i + 1, *r[1:]) for i, r in enumerate(rows[:30])]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows, **options) == want


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2),
            (4, [0.5, 0.0], 1), (5, [0.4, 9.0], 2), (6, [0.4, 8.0], 2), (8, [0.3, 0.0], 2),
            (9, [0.25, 0.0], 3)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == Counter()
    assert mined(spark, rows[1:]) == Counter()


def test_huge_components(spark):
    rows = [(i, [3.0e4 * (1 + i % 3), 1.5e4 * (i % 5), 0.5], i % 2) for i in range(60)]
    assert mined(spark, rows) == plain(rows)
    large = [(i, [1e30, -1e30 * (i % 4)], i % 2) for i in range(60)]
    assert all(abs(r[4]) <= 2**63 for r in mined(spark, large))


def test_bounds_spare_scores():
    """Along a tree of close anchors most candidates are told apart by their bounds."""
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * (np.ones(16) + 0.01 * rng.standard_normal((60, 16))))
    rows = np.floor(256 * rng.standard_normal((2000, 16)))
    exact = hn.products(vectors, rows)
    floor = np.sort(exact, axis=1)[:, -5]
    parent, length = hn.spanning_tree(vectors)
    asked = []

    def overlap(at, low, high):
        assert (low <= exact[at]).all() and (exact[at] <= high).all()
        meets = high >= floor[at][:, None]
        asked.append(meets.sum())
        return meets

    key, column, score = hn.bounded_scores(vectors, parent, length, rows, overlap)
    assert (exact[key, column] == score).all()
    assert {(k, c) for k, c in zip(key, column)} >= {
        (k, c) for k, c in zip(*np.nonzero(exact >= floor[:, None]))}
    assert sum(asked) < exact.size / 10


def test_tree_is_minimal():
    rng = random.Random(4)
    points = np.array([[rng.randrange(100), rng.randrange(100)] for _ in range(40)], float)
    parent, length = hn.spanning_tree(points)
    assert sorted(i for level in hn.levels_of(parent) for i in level) == list(range(40))
    edges = sorted((math.dist(points[i], points[j]), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert math.isclose(length.sum(), total)


def test_query(spark, tmp_path):
    rows = clusters(5, 200)
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in found) == plain(rows)


def test_repeated_blocks_are_not_broadcast(spark):
    options = hn.MiningOptions(tile_values=100, block_values=100, group_rows=64)
    table = spark.createDataFrame([(*r, "x", 1) for r in clusters(6, 300)], SCHEMA)
    tiles = hn._tiles(hn.valid_rows(table), options)
    met = hn._meet(hn._blocks(tiles, options), tiles, 5, hn._own_label(options))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
