"""Small control files and folders of shared storage, reached as Spark reaches them."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> dict[str, int]:
    """What lies in a folder, with the time it was changed in milliseconds; nothing if it is absent."""
    system, place = _at(spark, folder)
    if not system.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(place)}


def size(spark: SparkSession, folder: str) -> int:
    system, place = _at(spark, folder)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that readers see whole or not at all; it must not exist yet."""
    folder, name = path.rsplit("/", 1)
    system, place = _at(spark, path)
    _, draft = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(f"{path} was written by someone else")
