"""A run over stage tables that computes only what is missing or stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.operators.candidates import build_candidates, missing_evaluations
from sparkreel.operators.captions import captions
from sparkreel.operators.discovery import DEFAULTS, DiscoveryOptions, discover_candidates
from sparkreel.operators.planning import DEFAULTS as PLAN_DEFAULTS
from sparkreel.operators.planning import PlanningOptions, plan_clips
from sparkreel.operators.providers import Responder, package_clips
from sparkreel.operators.responses import TEXT_FIELDS, clip_transcripts
from sparkreel.operators.thumbnails import thumbnail_plans
from sparkreel.plans.lineage import cut_lineage
from sparkreel.sources import files
from sparkreel.sources.stage_tables import (
    commit_projects, commits, next_batch, read_stage, write_rows, write_stage,
)

STAGES = ["transcript", "candidates", "evaluations", "clip_plan", "captions"]
# Packaging follows the clip plan, beside captions.
PACKAGED = [*STAGES[:4], "packaging", "thumbnails"]
ALL_STAGES = [*STAGES, *PACKAGED[4:]]
# Clips without packaging and why.
REFUSED = "packaging_refused"
# Where projects with work to do are noted, so that a run need not look at all the others.
OPEN = "_open"
Scorer = Callable[[DataFrame], DataFrame]


def fresh_stages(
    spark: SparkSession, root: str, chain: list[str] | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``project_id, stage`` of what is stored and not older than anything it was made from.

    With ``wanted`` (``source_id``) of these projects, whose commits alone are read.
    """
    chain = chain or STAGES
    stored = commits(spark, root, chain, wanted=wanted)
    if stored is None:
        return spark.createDataFrame([], "project_id bigint, stage string")
    batches = stored.groupBy("source_id").agg(
        *[F.max(F.when(F.col("stage") == stage, F.col("batch"))).alias(stage) for stage in chain]
    )
    complete = F.lit(True)
    flags = []
    for at, stage in enumerate(chain):
        earlier = F.greatest(F.lit(-1), F.lit(-1), *[F.col(name) for name in chain[:at]])
        complete = complete & (F.col(stage) >= earlier)
        flags.append(F.when(F.coalesce(complete, F.lit(False)), F.lit(stage)))
    return batches.select(
        F.col("source_id").alias("project_id"), F.explode(F.array_compact(F.array(*flags)))
        .alias("stage"),
    )


def run_missing_stages(
    spark: SparkSession,
    root: str,
    scorer: Scorer,
    *,
    discovery: DiscoveryOptions = DEFAULTS,
    planning: PlanningOptions = PLAN_DEFAULTS,
    projects: DataFrame | None = None,
) -> None:
    """Brings every project with a stored transcript up to date, stage by stage.

    With ``projects`` (``source_id``) only these are looked at.

    ``scorer`` turns candidates with text into evaluations; a project is only committed when all
    its candidates have one. Each stage reads what the one before has written, so nothing is
    computed twice and a restart goes on where the last run ended.
    """
    batch = next_batch(spark, root, ALL_STAGES)

    def stored(stage: str, wanted: DataFrame) -> DataFrame:
        return read_stage(spark, root, stage, wanted=wanted)

    def make_candidates(wanted: DataFrame) -> DataFrame:
        segments = stored("transcript", wanted)
        return build_candidates(discover_candidates(segments, discovery), segments)

    def make_clips(wanted: DataFrame) -> DataFrame:
        return plan_clips(
            stored("candidates", wanted), stored("evaluations", wanted), planning,
            candidates_per_source=discovery.max_candidates,
        )

    def make_captions(wanted: DataFrame) -> DataFrame:
        return captions(stored("clip_plan", wanted), stored("transcript", wanted))

    makers = {"candidates": make_candidates, "clip_plan": make_clips, "captions": make_captions}
    for before, stage in zip(STAGES, STAGES[1:]):
        fresh = fresh_stages(spark, root, wanted=projects).withColumnRenamed(
            "project_id", "source_id")
        # Ids only; written out because every step below reads them again.
        wanted = cut_lineage(
            fresh.groupBy("source_id")
            .agg(F.collect_set("stage").alias("stages"))
            .filter(
                F.array_contains("stages", before) & ~F.array_contains("stages", stage)
            )
            .select("source_id")
        )
        if wanted.isEmpty():
            continue
        if stage == "evaluations":
            candidates = stored("candidates", wanted)
            scored = write_rows(scorer(candidates), root, stage, batch)
            complete = wanted.join(
                missing_evaluations(candidates, scored), "source_id", "left_anti"
            )
            commit_projects(complete, root, stage, batch)
        else:
            write_stage(makers[stage](wanted), wanted, root, stage, batch)


def open_projects(spark: SparkSession, root: str) -> DataFrame | None:
    """Projects noted as having work to do (``source_id``); None if there are none."""
    folders = [f"{root}/{OPEN}/{name}" for name in files.names(spark, f"{root}/{OPEN}")]
    if not folders:
        return None
    return spark.read.parquet(*folders).distinct()


def note_open(projects: DataFrame, root: str, name: str) -> None:
    """Notes projects before their transcripts are committed, so that none is forgotten."""
    projects.select("source_id").write.mode("overwrite").parquet(f"{root}/{OPEN}/{name}")


def close_finished(spark: SparkSession, root: str, packaged: bool, batch: int) -> None:
    """Forgets projects whose stages are all up to date; the others stay noted."""
    folders = list(files.names(spark, f"{root}/{OPEN}"))
    noted = open_projects(spark, root)
    if noted is None:
        return
    noted = cut_lineage(noted)
    for chain in [STAGES, PACKAGED] if packaged else [STAGES]:
        done = fresh_stages(spark, root, chain, wanted=noted).groupBy("project_id").count()
        done = done.filter(F.col("count") == len(chain)).select(
            F.col("project_id").alias("source_id"))
        left = noted.join(done, "source_id", "left_anti")
        note_open(left, root, f"rest={batch}-{len(chain)}-{'packaging' in chain}")
    for name in folders:
        if not name.startswith(f"rest={batch}-"):
            files.remove(spark, f"{root}/{OPEN}/{name}")


def run_missing_packaging(
    spark: SparkSession, root: str, packager: Responder, sources: DataFrame,
    projects: DataFrame | None = None,
) -> None:
    """Packages every planned clip that has no valid packaging, then plans its thumbnails.

    With ``projects`` (``source_id``) only these are looked at.

    Valid packaging made from the current clip plan is kept; clips whose packaging is missing,
    damaged or was refused are asked for (again). Clips without text are never asked for.
    """
    batch = next_batch(spark, root, ALL_STAGES)
    fresh = cut_lineage(
        fresh_stages(spark, root, PACKAGED, projects).withColumnRenamed("project_id", "source_id"))
    clips = read_stage(spark, root, "clip_plan", wanted=fresh.filter("stage = 'clip_plan'"))
    if clips is None:
        return
    due = clips.select("source_id", "clip_id")
    kept = read_stage(spark, root, "packaging", wanted=fresh.filter("stage = 'packaging'"))
    if kept is not None:
        sound = F.col("hashtags").isNotNull()
        for name in TEXT_FIELDS:
            sound = sound & F.coalesce(F.trim(name) != "", F.lit(False))
        kept = kept.filter(sound)
        due = due.join(kept, ["source_id", "clip_id"], "left_anti")
    touched = cut_lineage(due.select("source_id").distinct())
    if not touched.isEmpty():
        content = read_stage(spark, root, "candidates", wanted=touched)
        with_text = clip_transcripts(clips.join(due, ["source_id", "clip_id"], "left_semi"), content)
        due = with_text.filter("error IS NULL").select("source_id", "clip_id")
        asked = clips.join(due, ["source_id", "clip_id"], "left_semi")
        answered = cut_lineage(package_clips(asked, content, packager, sources))
        refused = answered.filter(F.size("errors") > 0).select("source_id", "clip_id", "errors")
        silent = with_text.filter("error IS NOT NULL").select(
            "source_id", "clip_id", F.array("error").alias("errors"))
        # Every refusal is a row, with its reasons; a later run replaces them.
        write_stage(refused.unionByName(silent), touched, root, REFUSED, batch)
        rows = answered.filter(F.size("errors") == 0).drop("errors")
        if kept is not None:
            rows = rows.unionByName(kept.join(touched, "source_id", "left_semi"))
        write_stage(rows, touched, root, "packaging", batch)
    state = fresh_stages(spark, root, PACKAGED, projects).withColumnRenamed(
        "project_id", "source_id")
    wanted = cut_lineage(
        state.filter("stage = 'packaging'").select("source_id").join(
            state.filter("stage = 'thumbnails'").select("source_id"), "source_id", "left_anti"))
    if not wanted.isEmpty():
        packaging = read_stage(spark, root, "packaging", wanted=wanted)
        plans = thumbnail_plans(packaging, read_stage(spark, root, "clip_plan", wanted=wanted))
        write_stage(plans, wanted, root, "thumbnails", batch)
