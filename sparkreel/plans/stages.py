"""Which stages each project has, which are stale, and what has to be computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chain of stages, then the stages made from a clip plan.
CHAIN = ["transcript", "candidates", "evaluations", "clip_plan"]
FROM_PLAN = ["captions", "thumbnails", "packaging"]
ORDER = {name: at for at, name in enumerate(CHAIN, 1)} | {
    name: len(CHAIN) + 1 for name in FROM_PLAN
}


def _has(stage: str) -> Column:
    return F.coalesce(F.bool_or(F.col("stage") == stage), F.lit(False))


def _missing_order() -> Column:
    """Order of the earliest missing stage of the chain, NULL when it is complete."""
    first = F.lit(None).cast("int")
    for name in reversed(CHAIN):
        first = F.when(~_has(name), F.lit(ORDER[name])).otherwise(first)
    return first


def project_status(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages (``project_id, stage``) of each project as flags, with what they complete."""
    return (
        projects.select("project_id")
        .join(stages, "project_id", "left")
        .groupBy("project_id")
        .agg(*[_has(name).alias(f"{name}_exists") for name in ["audio", *CHAIN]])
        .withColumn(
            "discovery_complete",
            F.col("audio_exists") & F.col("transcript_exists") & F.col("candidates_exists"),
        )
        .withColumn("intelligence_complete", F.col("evaluations_exists"))
        .withColumn("planning_complete", F.col("clip_plan_exists"))
    )


def has_any_artifact(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Whether a project left anything behind; knowing its source alone does not count."""
    made = F.bool_or(F.col("stage").isNotNull() & (F.col("stage") != "source"))
    return (
        projects.select("project_id")
        .join(stages, "project_id", "left")
        .groupBy("project_id")
        .agg(made.alias("has_artifacts"))
    )


def _first_missing(projects: DataFrame, stages: DataFrame) -> DataFrame:
    return (
        projects.select("project_id")
        .join(stages, "project_id", "left")
        .groupBy("project_id")
        .agg(_missing_order().alias("missing_order"), F.collect_set("stage").alias("present"))
    )


def stale_stages(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Stored stages that a missing earlier one invalidates."""
    order = F.create_map(*[F.lit(item) for pair in ORDER.items() for item in pair])
    return (
        _first_missing(projects, stages)
        .select("project_id", "missing_order", F.explode("present").alias("stage"))
        .filter(F.try_element_at(order, F.col("stage")) > F.col("missing_order"))
        .select("project_id", "stage")
    )


def needs_work(projects: DataFrame, stages: DataFrame, stage: str) -> DataFrame:
    """Projects whose stage is missing or stale."""
    if stage not in ORDER:
        raise ValueError(f"unknown stage {stage}")
    fresh = stages.filter(F.col("stage") == stage).join(
        stale_stages(projects, stages), ["project_id", "stage"], "left_anti"
    )
    return projects.select("project_id").join(fresh, "project_id", "left_anti")


def work_plan(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Everything to compute, one row per project and stage."""
    todo = F.filter(
        F.array(*[F.lit(name) for name in ORDER]),
        lambda name: ~F.array_contains(F.col("present"), name)
        | F.coalesce(
            F.create_map(*[F.lit(i) for pair in ORDER.items() for i in pair])[name]
            > F.col("missing_order"),
            F.lit(False),
        ),
    )
    return _first_missing(projects, stages).select("project_id", F.explode(todo).alias("stage"))
