"""New transcript rows, taken in once and carried through all stages.

A transcript comes in versions. A version is a closed set of rows: all its files carry its number
(``version``, growing) and the number of segments it has (``n_segments``), so it is known when the
set is whole, in whatever order the files arrive. What is not whole waits in a holding table from one
batch to the next. Files that tell no version are versions of their own, numbered by their time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.operators.discovery import DEFAULTS, DiscoveryOptions
from sparkreel.operators.planning import DEFAULTS as PLAN_DEFAULTS
from sparkreel.operators.planning import PlanningOptions
from sparkreel.operators.providers import Responder
from sparkreel.operators.segments import with_text_flag
from sparkreel.plans.incremental import (
    ALL_STAGES, Scorer, close_finished, note_open, open_projects, run_missing_packaging,
    run_missing_stages,
)
from sparkreel.plans.lineage import cut_lineage
from sparkreel.schemas import VERSIONED_SEGMENTS
from sparkreel.sources.stage_tables import commit_projects, next_batch, read_stage, write_rows

ROW = ["source_id", "version", "n_segments", "idx", "start_ms", "end_ms", "text"]
VERSION = ["source_id", "version"]
UNIT = ["source_id", "told", "v", "file_time", "file"]
PIECE = 16_384
# Hashed places that units mark, and how many units are taken out again by a broadcast.
PLACES, MOST_ASTRAY = 1 << 26, 500_000
# Beside the transcripts: which version of each is stored, and rows that wait for the rest.
TAKEN, HELD = "transcript_version", "held"
GAPS = "positions are not 0 to n-1"
BACK = "segment ends go back"
UNCOUNTED = "version without its number of segments"


def unit_rows(rows: DataFrame) -> DataFrame:
    """Rows (``ROW``, of files also ``file`` and ``file_time``) with the ``UNIT`` they came in.

    A unit is a version that is told, or a file that tells none.
    """
    if "version" not in rows.columns:
        rows = rows.withColumn("version", F.lit(None).cast("bigint")).withColumn(
            "n_segments", F.lit(None).cast("bigint"))
    told = F.col("version").isNotNull()
    at, of = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    if "file" in rows.columns:
        at, of = F.when(~told, F.col("file_time")), F.when(~told, F.col("file"))
    return rows.select(
        *ROW, told.alias("told"), F.coalesce("version", F.lit(0)).alias("v"),
        at.alias("file_time"), of.alias("file"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """One row per unit and run of ``PIECE`` positions: what its version is judged by, no text."""
    piece = F.floor(F.col("idx") / PIECE)
    along = Window.partitionBy(*UNIT, "piece").orderBy("idx")
    before, end_before = F.lag("idx").over(along), F.lag("end_ms").over(along)
    return (
        rows.select(*UNIT, "n_segments", "idx", "end_ms", piece.alias("piece"))
        .withColumn("before", before).withColumn("end_before", end_before)
        .groupBy(*UNIT, "piece").agg(
            F.count("*").alias("rows"),
            F.count(F.when(~F.col("idx").eqNullSafe(F.col("before")), F.col("idx"))).alias("places"),
            F.min("idx").alias("low"), F.max("idx").alias("high"),
            F.min("n_segments").alias("n"), F.max("n_segments").alias("most"),
            F.max(F.coalesce(F.col("end_ms") < F.col("end_before"), F.lit(False))).alias("falls"),
            F.min_by("end_ms", "idx").alias("first_end"), F.max_by("end_ms", "idx").alias("last_end")))


def joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joined where all of ``names`` are equal, null like any other value."""
    right = right.withColumnsRenamed({name: f"of_{name}" for name in names})
    equal = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in names])
    return left.join(right, equal, how).drop(*[f"of_{name}" for name in names])


def numbered_versions(pieces: DataFrame) -> DataFrame:
    """Pieces with ``version, n, most`` for files that tell none, from their time.

    Such files of a source are one version if no two of them cover the same positions, which is how
    a transcript split over files looks when all arrive together; else each is one by itself. They
    never wait for others.
    """
    told = pieces.filter("told").withColumn("version", F.col("v"))
    untold = pieces.filter("NOT told").drop("n", "most")
    spans = untold.groupBy(*UNIT).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    along = Window.partitionBy("source_id").orderBy("low", "high", "file")
    before = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    by_source = Window.partitionBy("source_id")
    by_time = Window.partitionBy("source_id", "file_time").orderBy("file")
    number = F.unix_micros("file_time") * 1000
    apart = F.max(F.coalesce(before >= F.col("low"), F.lit(False))).over(by_source)
    spans = spans.withColumn("apart", apart).select(
        *UNIT,
        F.when(F.col("apart"), number + F.least(F.row_number().over(by_time), F.lit(999)))
        .otherwise(F.max(number).over(by_source)).alias("version"),
        F.when(F.col("apart"), F.col("rows")).otherwise(F.sum("rows").over(by_source)).alias("n"))
    spans = spans.withColumn("most", F.col("n"))
    return told.unionByName(joined(untold, spans, UNIT))


def judged_versions(pieces: DataFrame) -> DataFrame:
    """``source_id, version, whole, reason`` of every version in numbered pieces.

    ``whole`` tells that all positions are there, once each. A version with a ``reason`` can never
    become usable; one that is neither whole nor has a reason waits for more rows.
    """
    end_before = F.lag("last_end").over(Window.partitionBy(*VERSION).orderBy("low"))
    falls = F.col("falls") | F.coalesce(F.col("first_end") < F.col("end_before"), F.lit(False))
    counted = pieces.withColumn("end_before", end_before).groupBy(*VERSION).agg(
        F.sum("rows").alias("rows"), F.sum("places").alias("places"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("told").alias("waits"),
        F.min("n").alias("n"), F.max("most").alias("most"), F.max(falls).alias("falls"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("places") == F.col("n"))
    whole = F.coalesce(whole & (F.col("rows") == F.col("n")) & (F.col("n") == F.col("most")), F.lit(False))
    # More rows than places, or places beyond the last, do not go away with more rows.
    spoilt = F.coalesce(
        (F.col("rows") > F.col("places")) | (F.col("low") < 0) | (F.col("high") >= F.col("n"))
        | (F.col("n") != F.col("most")), F.lit(True))
    reason = (
        F.when(F.col("source_id").isNull(), GAPS)
        .when(F.col("n").isNull(), UNCOUNTED)
        .when(~whole & (spoilt | ~F.col("waits")), GAPS)
        .when(whole & F.col("falls"), BACK))
    return counted.select(*VERSION, whole.alias("whole"), reason.alias("reason"))


def rows_of(rows: DataFrame, wanted: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of the ``wanted`` units, without a shuffle of their text; ``others`` lists all other units.

    Wanted units mark hashed places, 64 to a row, so the broadcast side is bounded for any number of
    units. The few others that fall on a marked place are known by name and taken out.
    """
    place = F.pmod(F.xxhash64(*UNIT), F.lit(PLACES))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")

    def placed(units: DataFrame) -> DataFrame:
        return units.withColumn("place", place).withColumn("word", F.shiftright("place", 6))

    marks = placed(wanted).groupBy("word").agg(F.bit_or(bit).alias("marks"))

    def marked(units: DataFrame) -> DataFrame:
        return placed(units).join(F.broadcast(marks), "word").filter(
            F.col("marks").bitwiseAND(bit) != 0).drop("word", "place", "marks")

    astray = cut_lineage(marked(others.select(*UNIT)))
    found = marked(rows)
    many = astray.limit(MOST_ASTRAY + 1).count()
    if many:
        found = joined(
            found, astray.hint("broadcast") if many <= MOST_ASTRAY else astray, UNIT, "left_anti")
    return found


def told_once(rows: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and pieces in which equal rows of a told version count once.

    A file may be sent twice, or worked on again after it was held. Only versions with repeated
    positions are looked at.
    """
    again = F.col("told") & (F.col("rows") > F.col("places"))
    units = cut_lineage(pieces.groupBy(*UNIT).agg(
        F.sum("rows").alias("rows"), F.sum("places").alias("places")
    ).select(*UNIT, again.alias("again")))
    several, single = units.filter("again"), units.filter("NOT again")
    if several.isEmpty():
        return rows, pieces
    once = cut_lineage(rows_of(rows, several, single).distinct())
    rest = joined(pieces, several, UNIT, "left_anti")
    return (rows_of(rows, single, several).unionByName(once),
            cut_lineage(rest.unionByName(pieces_of(once))))


def take_in(
    spark: SparkSession, arrived: DataFrame, root: str, batch_id: int
) -> None:
    """Stores what has become the newest whole version of its source; the rest waits or is set aside.

    Late files of a version older than the stored one change nothing, and files that come twice
    count once. Working on a batch again after a failure leads to the same tables. Versions are
    judged without their text, which goes from the files to where it belongs and is not shuffled.
    """
    batch = next_batch(spark, root, [*ALL_STAGES, TAKEN, HELD])
    touched = cut_lineage(
        arrived.select("source_id").filter("source_id IS NOT NULL").distinct())
    rows = unit_rows(arrived)
    held = read_stage(spark, root, HELD, wanted=touched)
    if held is not None:
        rows = rows.unionByName(unit_rows(held))
    rows, pieces = told_once(rows, cut_lineage(pieces_of(rows)))
    pieces = cut_lineage(numbered_versions(pieces))
    new = pieces
    taken = read_stage(spark, root, TAKEN, wanted=touched)
    if taken is not None:
        stored = taken.select("source_id", F.col("version").alias("stored"))
        new = pieces.join(stored, "source_id", "left").filter(
            "stored IS NULL OR version > stored").drop("stored")
    judged = cut_lineage(judged_versions(new))
    newest = (
        judged.filter("whole AND reason IS NULL")
        .groupBy("source_id").agg(F.max("version").alias("version")))
    newest = cut_lineage(newest)

    fates = judged.join(
        newest.withColumnRenamed("version", "newest"), "source_id", "left"
    ).select(
        *VERSION, "reason",
        F.when(F.col("reason").isNotNull(), "aside").when(F.expr("version = newest"), "store")
        .when(F.expr("newest IS NULL OR version > newest"), "wait").alias("fate"))
    units = pieces.groupBy(*UNIT, "version").agg(F.max("n").alias("n"))
    units = cut_lineage(joined(units, fates, VERSION, "left").withColumn(
        "fate", F.coalesce("fate", F.lit("old"))))

    def rows_for(fate: str) -> DataFrame:
        return rows_of(rows, units.filter(F.col("fate") == fate), units.filter(F.col("fate") != fate))

    bad = units.filter("fate = 'aside'")
    if not bad.isEmpty():
        aside = joined(rows_for("aside").drop("version"), bad, UNIT)
        number = F.when(F.col("told"), F.col("n_segments")).otherwise(F.col("n"))
        aside.withColumn("n_segments", number).select(*ROW, "reason").write.mode(
            "overwrite").parquet(f"{root}/quarantine/batch={batch_id}")

    # The flag is stored so that discovery need not read the text.
    flagged = with_text_flag(
        rows_for("store").select("source_id", "idx", "start_ms", "end_ms", "text"))
    # The transcript's commit comes last: until then the batch can be worked on again.
    write_rows(newest, root, TAKEN, batch)
    write_rows(rows_for("wait").select(*ROW), root, HELD, batch)
    write_rows(flagged, root, "transcript", batch)
    note_open(newest, root, f"batch={batch}")
    commit_projects(newest, root, "transcript", batch)
    commit_projects(newest, root, TAKEN, batch)
    commit_projects(touched, root, HELD, batch)


def run_incremental(
    spark: SparkSession,
    incoming: str,
    root: str,
    scorer: Scorer | None,
    *,
    file_format: str = "parquet",
    schema: str = VERSIONED_SEGMENTS,
    checkpoint: str | None = None,
    discovery: DiscoveryOptions = DEFAULTS,
    planning: PlanningOptions = PLAN_DEFAULTS,
    packager: Responder | None = None,
    sources: DataFrame | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Processes all files of ``incoming`` not seen before, then stops.

    Of every source the newest whole version is stored (see ``take_in``); it replaces an older one
    and makes everything after it stale. Versions with repeated positions or falling ends are set
    aside, with the reason, under ``quarantine`` and change nothing. The stream's checkpoint
    remembers the files, stage tables hold the results. Without a ``scorer`` transcripts are only
    taken in. With a ``packager`` and the table of ``sources`` clips are packaged and their
    thumbnails planned as well. A batch repeated after a failure is written under a newer number
    and replaces itself. ``files_per_batch`` bounds the files that one batch takes.
    """
    if packager is not None and sources is None:
        raise ValueError("packaging needs the table of sources")

    def work(arrived: DataFrame, batch_id: int) -> None:
        session = arrived.sparkSession
        take_in(session, arrived, root, batch_id)
        if scorer is None:
            return
        todo = open_projects(session, root)
        if todo is None:
            return
        todo = cut_lineage(todo)
        run_missing_stages(
            session, root, scorer, discovery=discovery, planning=planning, projects=todo)
        if packager is not None:
            run_missing_packaging(session, root, packager, sources, todo)
        close_finished(session, root, packager is not None, batch_id)

    rows = spark.readStream
    if files_per_batch is not None:
        rows = rows.option("maxFilesPerTrigger", files_per_batch)
    rows = rows.schema(schema).format(file_format).load(incoming).select(
        "*", F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"))
    query = (
        rows.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or f"{root}/_checkpoint")
        .foreachBatch(work)
        .start()
    )
    query.awaitTermination()
