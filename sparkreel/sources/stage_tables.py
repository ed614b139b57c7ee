"""Stage tables: Parquet rows of each stage, replaced per project.

A stage is a log of runs. A batch writes its rows (``rows/batch=N``) and the list of projects that it
covers (``projects/batch=N``); what counts are the runs that the newest manifest names, a small file
that is published as a whole. So a batch cut short stays invisible and may be written again, and a
batch replaces whole projects: readers take each project's rows from its newest batch.

Runs of like size are merged once there are ``FAN`` of them: only rows that are still current go
into the merged run, whose folders are parted by a hash of the project, so that a few projects are
read from their buckets alone. With sizes growing ``FAN``-fold the number of runs grows with the
logarithm of the data, and a row is rewritten as often as that. Readers that have begun keep reading
the runs they know; folders that no recent manifest names are removed by ``remove_superseded``.
One writer works on a stage at a time.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.sources import files

KEY = "source_id"
FAN = 8
BUCKETS = 64
SMALLEST_RUN = 1 << 24


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


# ---- manifests ----------------------------------------------------------------------------------


def _manifests(spark: SparkSession, root: str, stage: str) -> dict[int, int]:
    """Numbers of the published manifests and when they were."""
    found = files.names(spark, f"{root}/{stage}/manifest")
    return {int(name[:-5]): at for name, at in found.items()
            if name.endswith(".json") and not name.startswith(".")}


def _manifest(spark: SparkSession, root: str, stage: str, number: int) -> dict:
    return json.loads(files.read_text(spark, f"{root}/{stage}/manifest/{number:012d}.json"))


def _newest(spark: SparkSession, root: str, stage: str) -> tuple[int, dict]:
    """Number and content of the manifest that counts; -1 and an empty one before the first."""
    numbers = _manifests(spark, root, stage)
    if not numbers:
        return -1, {"batch": -1, "runs": []}
    return max(numbers), _manifest(spark, root, stage, max(numbers))


def _publish(spark: SparkSession, root: str, stage: str, number: int, content: dict) -> None:
    files.publish_text(
        spark, f"{root}/{stage}/manifest/{number:012d}.json", json.dumps(content))


def _tier(spark: SparkSession, root: str, stage: str, name: str) -> int:
    """How often ``FAN`` the smallest size fits into a run."""
    size = sum(files.size(spark, f"{root}/{stage}/{part}/{name}") for part in ("rows", "projects"))
    return max(0, math.ceil(math.log(max(size, 1) / SMALLEST_RUN, FAN)))


# ---- writing ------------------------------------------------------------------------------------


def write_rows(rows: DataFrame, root: str, stage: str, batch: int) -> DataFrame:
    """Writes the rows of a batch, still invisible to readers, and returns them as stored."""
    path = f"{root}/{stage}/rows/batch={batch}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def commit_projects(
    projects: DataFrame, root: str, stage: str, batch: int, key: str = KEY
) -> None:
    """Makes a batch the current one of ``projects``, and merges runs where there are enough."""
    spark = projects.sparkSession
    name = f"batch={batch}"
    projects.select(key).distinct().write.mode("overwrite").parquet(
        f"{root}/{stage}/projects/{name}")
    number, content = _newest(spark, root, stage)
    runs = [run for run in content["runs"] if run["name"] != name]
    runs.append({"name": name, "tier": _tier(spark, root, stage, name)})
    _publish(spark, root, stage, number + 1,
             {"batch": max(content["batch"], batch), "runs": runs})
    while merge_runs(spark, root, stage, key):
        pass


def write_stage(
    rows: DataFrame, projects: DataFrame, root: str, stage: str, batch: int, key: str = KEY
) -> None:
    """Replaces a stage for ``projects``; projects without rows end up empty."""
    write_rows(rows, root, stage, batch)
    commit_projects(projects, root, stage, batch, key)


def merge_runs(
    spark: SparkSession, root: str, stage: str, key: str = KEY, fan: int = FAN
) -> bool:
    """Merges the runs of the lowest tier that has ``fan`` of them; False if there is none.

    A merge cut short leaves the manifest as it was. Rows and projects that newer batches have
    replaced are left out.
    """
    number, content = _newest(spark, root, stage)
    by_tier: dict[int, list[str]] = {}
    for run in content["runs"]:
        by_tier.setdefault(run["tier"], []).append(run["name"])
    full = sorted(tier for tier, names in by_tier.items() if len(names) >= fan)
    if not full:
        return False
    merged = set(by_tier[full[0]])
    every = _commits(spark, root, stage, key, content["runs"])
    current = every.groupBy(key).agg(F.max(F.struct("batch", "run")).alias("c")).select(
        key, "c.batch", "c.run").filter(F.col("run").isin(sorted(merged))).drop("run")
    name = f"merged={uuid.uuid4().hex}"
    bucket = bucket_of(key).alias("bucket")
    rows = _rows(spark, root, stage, sorted(merged), None)
    if rows is not None:
        # Buckets too large for one file are split, small ones share a task.
        path = f"{root}/{stage}/rows/{name}"
        rows.join(current, [key, "batch"], "left_semi").select("*", bucket).hint(
            "rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        if _read(spark, path, [path]) is None:  # nothing is current: the columns are kept
            rows.limit(0).write.parquet(f"{path}/bucket=0")
    current.select("*", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(
        f"{root}/{stage}/projects/{name}")
    runs = [run for run in content["runs"] if run["name"] not in merged]
    # A merge always counts as one step up, even where most of its rows were superseded.
    tier = max(full[0] + 1, _tier(spark, root, stage, name))
    runs.append({"name": name, "tier": tier})
    _publish(spark, root, stage, number + 1, {"batch": content["batch"], "runs": runs})
    return True


def remove_superseded(
    spark: SparkSession, root: str, stage: str, retain_seconds: float = 86_400
) -> None:
    """Removes runs that neither the newest manifest nor one of the last ``retain_seconds`` names.

    Readers that began longer ago than that may miss files. Folders of a batch that is being written
    are younger and stay.
    """
    limit = (time.time() - retain_seconds) * 1000
    numbers = _manifests(spark, root, stage)
    if not numbers:
        return
    last = max(numbers)
    # A manifest counts from when it was published until the next one was.
    until = {n: numbers.get(n + 1, float("inf")) for n in numbers}
    kept = [n for n in numbers if n == last or until[n] >= limit]
    named = {run["name"] for n in kept for run in _manifest(spark, root, stage, n)["runs"]}
    for number in sorted(set(numbers) - set(kept)):
        files.remove(spark, f"{root}/{stage}/manifest/{number:012d}.json")
    for part in ("rows", "projects"):
        for name, changed in files.names(spark, f"{root}/{stage}/{part}").items():
            if name not in named and changed < limit:
                files.remove(spark, f"{root}/{stage}/{part}/{name}")


# ---- reading ------------------------------------------------------------------------------------


def _read(spark: SparkSession, base: str, paths: list[str]) -> DataFrame | None:
    try:
        # Column types come from the files; batches may have gained columns.
        return spark.read.option("basePath", base).option("mergeSchema", "true").parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _part(
    spark: SparkSession, folder: str, names: list[str], buckets: list[int] | None
) -> DataFrame | None:
    """Rows of runs with ``batch`` and ``run``; of merged runs the given buckets only."""
    found = []
    plain = [name for name in names if name.startswith("batch=")]
    merged = [name for name in names if name.startswith("merged=")]
    if plain:
        rows = _read(spark, folder, [f"{folder}/{name}" for name in plain])
        if rows is not None:
            number = F.col("batch").cast("bigint")
            found.append(rows.withColumn("batch", number).withColumn(
                "run", F.concat(F.lit("batch="), number.cast("string"))))
    if merged:
        # Only the folder of the run is given, so `bucket` is the one column that paths add.
        for name in merged:
            rows = _read(spark, f"{folder}/{name}", [f"{folder}/{name}"])
            if rows is None or "bucket" not in rows.columns:
                continue
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(buckets))
            found.append(rows.drop("bucket").withColumn("run", F.lit(name)))
    if not found:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _rows(
    spark: SparkSession, root: str, stage: str, names: list[str], buckets: list[int] | None
) -> DataFrame | None:
    rows = _part(spark, f"{root}/{stage}/rows", names, buckets)
    return None if rows is None else rows.drop("run")


def _commits(
    spark: SparkSession, root: str, stage: str, key: str, runs: list[dict],
    buckets: list[int] | None = None,
) -> DataFrame | None:
    found = _part(spark, f"{root}/{stage}/projects", [run["name"] for run in runs], buckets)
    return None if found is None else found.select(key, "batch", "run")


def buckets_of(wanted: DataFrame | None, key: str = KEY) -> list[int] | None:
    """The buckets of some projects, at most ``BUCKETS`` numbers."""
    if wanted is None:
        return None
    return sorted(row[0] for row in wanted.select(bucket_of(key)).distinct().collect())


def commits(
    spark: SparkSession, root: str, stages: list[str], key: str = KEY,
    wanted: DataFrame | None = None,
) -> DataFrame | None:
    """Commits of the stages as ``key, batch, stage``, the newest of each project among them.

    With ``wanted`` of these projects only; None before the first.
    """
    buckets = buckets_of(wanted, key)
    found = []
    for stage in stages:
        _, content = _newest(spark, root, stage)
        written = _commits(spark, root, stage, key, content["runs"], buckets)
        if written is not None:
            found.append(written.select(key, "batch", F.lit(stage).alias("stage")))
    if not found:
        return None
    every = reduce(DataFrame.unionByName, found)
    return every if wanted is None else every.join(
        wanted.select(key).distinct(), key, "left_semi")


def committed_projects(
    spark: SparkSession, root: str, stage: str, key: str = KEY
) -> DataFrame | None:
    """Projects a stage is stored for, each with its newest batch; None before the first write."""
    written = commits(spark, root, [stage], key)
    return None if written is None else written.groupBy(key).agg(F.max("batch").alias("batch"))


def read_stage(
    spark: SparkSession, root: str, stage: str, key: str = KEY, wanted: DataFrame | None = None
) -> DataFrame | None:
    """Current rows of a stage, all or those of ``wanted`` keys; None before the first write.

    Only the runs and buckets holding them are listed and read, so a run over a few projects does
    not touch the rows of all others.
    """
    _, content = _newest(spark, root, stage)
    buckets = buckets_of(wanted, key)
    every = _commits(spark, root, stage, key, content["runs"], buckets)
    if every is None:
        return None
    newest = every.groupBy(key).agg(F.max(F.struct("batch", "run")).alias("c")).select(
        key, "c.batch", "c.run")
    if wanted is not None:
        newest = newest.join(wanted.select(key).distinct(), key, "left_semi")
    # One name per run that is still current somewhere, and there are few runs.
    names = sorted(row[0] for row in newest.select("run").distinct().collect())
    rows = _rows(spark, root, stage, names, buckets) if names else None
    if rows is None:
        rows = _rows(spark, root, stage, [run["name"] for run in content["runs"]], [])
        return None if rows is None else rows.drop("batch").limit(0)
    return rows.join(newest.drop("run"), [key, "batch"]).drop("batch")


def next_batch(spark: SparkSession, root: str, stages: list[str]) -> int:
    """A number above every committed batch of the stages: later work counts as newer."""
    return 1 + max(_newest(spark, root, stage)[1]["batch"] for stage in stages)
