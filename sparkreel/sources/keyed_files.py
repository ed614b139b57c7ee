"""Documents as files, one per row, under paths of their own, written by the tasks.

An export is a folder ``version=…`` below the root; a file is written beside its place and moved
there, so a task that is repeated or runs twice leaves whole files only. When all tasks are done the
export is committed by naming it in ``_current``; until then readers see the export before. Nothing is
grouped: each document is one row, and only one is held at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from sparkreel.sources import files

CURRENT = "_current"
# The list of the paths of an export, beside its folder.
PATHS = "_paths-"
FILES_PER_TASK = 2_000
FILES_PER_BATCH = 64
# A path has no empty, hidden or upward part: Spark's readers skip names that start with _ or dots.
GOOD_PATH = r"\A(?:[^/._][^/]*/)*[^/._][^/]*\z"


def _open(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    system, base = pyarrow.fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _put(system: pyarrow.fs.FileSystem, path: str, content: bytes) -> None:
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name[:80]}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, path)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.version = options["path"], options["version"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, base = _open(self.root)
        known: set[str] = set()
        for row in rows:
            path = f"{base}/{self.version}/{row['path']}"
            folder = path.rsplit("/", 1)[0]
            if folder not in known:
                system.create_dir(folder, recursive=True)
                known = {folder}  # rows come by folder, so one is enough
            _put(system, path, (row["document"] or "").encode())
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _open(self.root)
        system.create_dir(f"{base}/{self.version}", recursive=True)
        _put(system, f"{base}/{CURRENT}", self.version.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was written stays unnamed; ``remove_old_exports`` takes it away."""


class KeyedFiles(DataSource):
    """``format("keyed_files")``: rows ``path, document``."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_files(rows: DataFrame, root: str) -> str:
    """Writes ``path, document`` rows as one export, commits it and returns its folder.

    Paths are relative, and no two rows may share one; null documents become empty files.
    """
    spark = rows.sparkSession
    rows = rows.select("path", "document")
    bad = rows.groupBy("path").agg(F.count("*").alias("n")).filter(
        F.col("path").isNull() | ~F.col("path").rlike(GOOD_PATH) | (F.col("n") > 1)
    ).limit(3).collect()
    if bad:
        raise ValueError(f"paths that are bad or not unique, such as {[row['path'] for row in bad]}")
    version = f"version={uuid.uuid4().hex}"
    # Written before the export is named, so an export that counts has its list of paths.
    rows.select("path").write.parquet(f"{root}/{version.replace('version=', PATHS)}")
    spark.dataSource.register(KeyedFiles)
    rows.sortWithinPartitions("path").write.format("keyed_files").mode("append").option(
        "version", version).save(root)
    return f"{root}/{version}"


def current_export(spark: SparkSession, root: str) -> str | None:
    """The folder of the last committed export; None before the first."""
    if CURRENT not in files.names(spark, root):
        return None
    return f"{root}/{files.read_text(spark, f'{root}/{CURRENT}')}"


def remove_old_exports(spark: SparkSession, root: str) -> None:
    """Removes all exports but the current one; no reader of the others may be running."""
    current = current_export(spark, root)
    for name in files.names(spark, root):
        folder = f"{root}/{name.replace(PATHS, 'version=')}"
        if name.startswith(("version=", PATHS)) and folder != current:
            files.remove(spark, f"{root}/{name}")


def relative_path() -> Column:
    """Where in its export a file lies, for rows read with ``_metadata``."""
    below = F.regexp_extract(F.col("_metadata.file_path"), r"/version=[0-9a-f]{32}/(.*)\z", 1)
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


def _contents(folder: str) -> Callable[[Iterator[pyarrow.RecordBatch]], Iterator[pyarrow.RecordBatch]]:
    def read(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for at in range(0, len(paths), FILES_PER_BATCH):
                some, found = paths[at:at + FILES_PER_BATCH], []
                for path in some:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        found.append(stream.read())
                yield pyarrow.RecordBatch.from_pydict({
                    "path": pyarrow.array(some, pyarrow.string()),
                    "document": pyarrow.array(found, pyarrow.binary())})

    return read


def read_files(spark: SparkSession, root: str) -> DataFrame | None:
    """``path, document`` of the current export; None before the first.

    Tasks open the files that the export lists, so that the driver lists no folders; an export
    without a list is read by its folders.
    """
    folder = current_export(spark, root)
    if folder is None:
        return None
    listed = folder.rsplit("/", 1)[1].replace("version=", PATHS)
    if listed in files.names(spark, root):
        paths = spark.read.schema("path string").parquet(f"{root}/{listed}")
        tasks = spark.sparkContext.defaultParallelism + paths.count() // FILES_PER_TASK
        return paths.repartition(tasks).mapInArrow(
            _contents(folder), "path string, document binary"
        ).select("path", F.col("document").cast("string").alias("document"))
    rows = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return rows.select(relative_path().alias("path"), F.col("value").alias("document"))
