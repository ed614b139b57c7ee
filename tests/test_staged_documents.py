"""Staged JSON documents: what they take on disk, and that they come back whole."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from workload.queries import Inputs


def test_documents_are_stored_compressed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "staged")
    monkeypatch.setattr(Inputs, "folder", lambda self: folder)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.md5(
        F.concat_ws("-", "id", i).cast("binary"))), " ")
    documents = spark.range(300).withColumn("text", words).select("id", F.to_json(F.struct(
        F.lit("local").alias("source_type"), F.concat(F.lit("/v/"), "id").alias("location"), "text",
        F.array("text").alias("segments"))).alias("document"))
    stored = Inputs(spark, "").staged(documents)
    read = {row.raw for row in stored.select("raw").collect()}
    assert read == {row.document for row in documents.collect()} and len(read) == 300
    assert stored.filter("document IS NULL").isEmpty()
    size = sum(os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder))
    assert size < sum(map(len, read)) / 3
