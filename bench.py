"""Headline queries, timed end to end: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) holds the tables, ``BENCH_CPUS`` (default all) the local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession

from workload.queries import QUERIES, Inputs

HEADLINES = [
    "clips_of_transcripts", "pause_before", "candidate_end_pairs", "best_end", "discover_candidates", "plan_clips",
    "build_candidate", "near_duplicate_pairs", "next_natural_start", "chunk_words",
    "subtitle_document", "parse_evaluations", "validate_packaging", "canonical_sources",
    "classify_failures", "work_plan", "run_incremental",
]
# Queries whose rate is reported: rows of transcript segments per second.
RATES = ["clips_of_transcripts", "discover_candidates", "plan_clips", "chunk_words"]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "*")
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(rows: DataFrame) -> None:
    """Computes every column of every row."""
    rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    began = time.perf_counter()
    segments = Inputs(spark, sf_dir).segments.count()
    times = {"store_segments": round(time.perf_counter() - began, 3)}
    began = time.perf_counter()
    Inputs(spark, sf_dir).clips.count()
    times["store_candidates_and_clips"] = round(time.perf_counter() - began, 3)
    for name in HEADLINES:
        began = time.perf_counter()
        drain(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "segments": segments,
                "segments_per_second": {name: round(segments / times[name]) for name in RATES},
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
