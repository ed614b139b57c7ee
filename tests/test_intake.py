"""Intake of large texts."""

import random
import time

from sparkreel.schemas import VERSIONED_SEGMENTS
from sparkreel.sources import stage_tables
from sparkreel.streaming import intake


def shuffled(spark):
    time.sleep(1)  # until the listener has heard of the last tasks
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_are_not_shuffled_by_the_intake(spark, tmp_path, monkeypatch):
    """Also where all units share one hashed place, so that each is told apart by its name."""
    monkeypatch.setattr(intake, "PLACES", 1, raising=False)
    rng = random.Random(3)
    size = 1 << 19
    rows = [(s, i, i * 1000, i * 1000 + 900, rng.randbytes(size // 2).hex(), version, n)
            for s, version, n in ((1, 1, 6), (1, 2, 6), (2, 1, 7), (None, 1, 2)) for i in range(min(n, 6))]
    rows += [(3, i, i * 1000, i * 1000 + 900, rng.randbytes(size // 2).hex(), None, None)
             for i in range(4)]
    spark.createDataFrame(rows, VERSIONED_SEGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = shuffled(spark)
    intake.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out", None)
    # Only what is set aside (two rows here) meets its reason in a join.
    assert shuffled(spark) - before < 3 * size
    kept = stage_tables.read_stage(spark, f"{tmp_path}/out", "transcript")
    assert {(r.source_id, r.idx, r.text) for r in kept.collect()} == {
        (r[0], r[1], r[4]) for r in rows if r[0] == 3 or r[0] == 1 and r[5] == 2}
    held = stage_tables.read_stage(spark, f"{tmp_path}/out", intake.HELD).collect()
    assert {(r.source_id, r.idx, r.text) for r in held} == {(r[0], r[1], r[4]) for r in rows if r[0] == 2}
    aside = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert {(r.source_id, r.idx, r.reason) for r in aside} == {(None, i, intake.GAPS) for i in range(2)}
