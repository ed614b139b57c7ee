"""Documents as files, and services asked again."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import catalog, providers, responses
from sparkreel.schemas import CLIPS, SEGMENTS, VERSIONED_SEGMENTS
from sparkreel.sources import documents, files, keyed_files, manifests, stage_tables
from sparkreel.plans import incremental
from sparkreel.streaming import intake


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, document string").repartition(4)


def names(root):
    return sorted(
        os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_round_trip(spark, tmp_path):
    pairs = [("a/x y+%20.txt", "é\nline"), ("a/b/ü.json", '{"v": 1}'), ("top", ""), ("null", None)]
    folder = keyed_files.write_files(rows(spark, *pairs), str(tmp_path))
    assert names(folder) == sorted(p for p, _ in pairs)
    found = {r.path: r.document for r in keyed_files.read_files(spark, str(tmp_path)).collect()}
    # Spark reads no row from an empty file.
    assert found | {"top": "", "null": ""} == {p: d or "" for p, d in pairs}


def test_exports_replace_each_other_as_a_whole(spark, tmp_path):
    root = str(tmp_path)
    assert keyed_files.read_files(spark, root) is None
    keyed_files.write_files(rows(spark, ("a", "1"), ("b", "2")), root)

    @F.udf("string")
    def fails(path):
        if path == "d":
            raise RuntimeError("lost")
        return path

    bad = rows(spark, ("c", "3"), ("d", "4")).withColumn(
        "document", F.when(F.col("path") == "d", fails("path")).otherwise("3"))
    with pytest.raises(Exception, match="lost"):
        keyed_files.write_files(bad, root)
    assert {r.path for r in keyed_files.read_files(spark, root).collect()} == {"a", "b"}
    folder = keyed_files.write_files(rows(spark, ("e", "5")), root)
    assert [tuple(r) for r in keyed_files.read_files(spark, root).collect()] == [("e", "5")]
    keyed_files.remove_old_exports(spark, root)
    assert [n for n in files.names(spark, root) if n[0] != "_"] == [os.path.basename(folder)]


def test_a_task_that_runs_twice_leaves_whole_files(tmp_path):
    (tmp_path / "r").mkdir()
    options = {"path": str(tmp_path / "r"), "version": "version=" + "0" * 32}
    once = [{"path": "p/a", "document": "x" * 10_000}, {"path": "p/b", "document": "y"}]

    def cut_short():
        yield once[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        keyed_files._Writer(options).write(cut_short())
    for _ in range(2):
        keyed_files._Writer(options).write(iter(once))
    folder = tmp_path / "r" / options["version"]
    assert names(folder) == ["p/a", "p/b"]
    assert (folder / "p/a").read_text() == "x" * 10_000


@pytest.mark.parametrize("pairs", [
    [("a", "1"), ("a", "2")], [(None, "1")], [("../a", "1")], [("/a", "1")], [("a//b", "1")],
    [("", "1")], [("_hidden", "1")], [("a/.b", "1")]])
def test_bad_paths(spark, tmp_path, pairs):
    with pytest.raises(ValueError):
        keyed_files.write_files(rows(spark, *pairs), str(tmp_path))
    assert names(tmp_path) == []


def test_packaging_of_named_projects_to_files_and_back(spark, tmp_path):
    """One key, a project's name, from the clip plan to the packaging file and its rows."""
    clips = spark.createDataFrame(
        [("youtube_abc", i, i, 0, 30_000, 8.0, "", f"T{i}") for i in (1, 2)],
        CLIPS.replace("source_id BIGINT", "source_id STRING"))
    content = spark.createDataFrame(
        [("youtube_abc", i, 0, 30_000, "text") for i in (1, 2)],
        "source_id string, candidate_id bigint, start_ms bigint, end_ms bigint, "
        "transcript_text string")
    sources = spark.createDataFrame(
        [("youtube_abc", "A", "x")], "source_id string, title string, location string")

    def packager(title, payload):
        clip = json.loads(payload)["clip_id"]
        return json.dumps({n: f"{n} {clip}" for n in responses.TEXT_FIELDS} | {"hashtags": ["#a"]})

    packaging = providers.package_clips(clips, content, packager, sources).drop("errors")
    written = manifests.packaging_documents(packaging).join(
        catalog.document_paths(clips), ["source_id", "clip_id"])
    folder = keyed_files.write_files(
        written.select(F.col("packaging_path").alias("path"), "document"), str(tmp_path))
    assert names(folder) == [
        f"project_id=youtube_abc/packaging/clip_{i:02d}.json" for i in (1, 2)]
    back = documents.read_packaging(documents.read_documents(spark, folder)).collect()
    assert sorted((r.project_id, r.clip_id, r.hook, r.hashtags) for r in back) == [
        ("youtube_abc", i, f"hook {i}", ["#a"]) for i in (1, 2)]


def logging_responder(log, good, failures):
    """Answers request number n after ``failures[n]`` failures; every call is logged."""
    def answer(title, payload):
        data = json.loads(payload)
        number = data["clip_id"] if isinstance(data, dict) else data[0]["candidate_id"]
        with open(f"{log}.{number}", "a") as calls:
            calls.write("x")
        message, times = failures.get(number, ("", 0))
        if len(open(f"{log}.{number}").read()) <= times:
            raise RuntimeError(message)
        return good(data)
    return answer


def calls(log, numbers):
    return {n: len(open(f"{log}.{n}").read()) for n in numbers}


def test_failures_that_pass_are_asked_again(spark, tmp_path):
    content = spark.createDataFrame(
        [("s", i, i * 1000, i * 1000 + 500, "t") for i in range(1, 5)],
        "source_id string, candidate_id bigint, start_ms bigint, end_ms bigint, "
        "transcript_text string")
    sources = spark.createDataFrame([("s", "A", "x")], "source_id string, title string, location string")
    failures = {1: ("HTTP 503", 2), 2: ("HTTP 503", 9), 3: ("bad key", 9)}
    scorer = logging_responder(
        f"{tmp_path}/log", lambda d: json.dumps([{"candidate_id": d[0]["candidate_id"], "score": 7}]),
        failures)
    found = providers.score_candidates(content, scorer, sources=sources, batch_size=1).collect()
    assert Counter((r.candidate_id, r.error) for r in found) == Counter([
        (1, None), (4, None), (None, "no answer: RuntimeError: HTTP 503"),
        (None, "no answer: RuntimeError: bad key")])
    assert calls(f"{tmp_path}/log", range(1, 5)) == {1: 3, 2: 3, 3: 1, 4: 1}


def test_refused_packaging_is_a_row(spark, tmp_path):
    root = f"{tmp_path}/t"
    clips = spark.createDataFrame(
        [(1, i, i, i * 60_000, i * 60_000 + 30_000, 8.0, "", None) for i in (1, 2, 3, 4)], CLIPS)
    content = spark.createDataFrame(
        [(1, i, 0, 30_000, " " if i == 4 else "text") for i in (1, 2, 3, 4)],
        "source_id bigint, candidate_id bigint, start_ms bigint, end_ms bigint, "
        "transcript_text string")
    sources = spark.createDataFrame(
        [(1, "A", "x")], "source_id bigint, title string, location string")
    for stage, frame in (("transcript", content), ("candidates", content),
                         ("evaluations", content), ("clip_plan", clips)):
        stage_tables.write_stage(frame, frame, root, stage, 0)
    good = {name: "x" for name in responses.TEXT_FIELDS} | {"hashtags": ["a"]}
    packager = logging_responder(
        f"{tmp_path}/log", lambda d: json.dumps(good) if d["clip_id"] != 2 else "{",
        {3: ("timed out", 5)})
    incremental.run_missing_packaging(spark, root, packager, sources)
    refused = {r.clip_id: r.errors for r in
               stage_tables.read_stage(spark, root, incremental.REFUSED).collect()}
    assert refused == {2: ["invalid JSON"], 3: ["no answer: RuntimeError: timed out"],
                       4: ["candidate has no text"]}
    assert [r.clip_id for r in stage_tables.read_stage(spark, root, "packaging").collect()] == [1]
    assert calls(f"{tmp_path}/log", (1, 2, 3)) == {1: 1, 2: 1, 3: 3}


def test_named_projects_through_a_run(spark, tmp_path):
    """Project names as keys from incoming files to packaging, by the same stages."""
    named = SEGMENTS.replace("source_id BIGINT", "source_id STRING")
    table = [("youtube_abc", i, i * 9000, i * 9000 + 8000, f"t {i}") for i in range(10)]
    spark.createDataFrame(table, named).coalesce(1).write.parquet(f"{tmp_path}/in")
    sources = spark.createDataFrame(
        [("youtube_abc", "A", "x")], "source_id string, title string, location string")

    def scorer(candidates):
        return providers.score_candidates(candidates, F.lit(9.0)).drop("error")

    def packager(title, payload):
        return json.dumps({n: "x" for n in responses.TEXT_FIELDS} | {"hashtags": []})

    intake.run_incremental(
        spark, f"{tmp_path}/in", f"{tmp_path}/out", scorer, packager=packager, sources=sources,
        schema=VERSIONED_SEGMENTS.replace("source_id BIGINT", "source_id STRING"))
    for stage in ("clip_plan", "captions", "packaging", "thumbnails"):
        found = stage_tables.read_stage(spark, f"{tmp_path}/out", stage)
        assert {r.source_id for r in found.collect()} == {"youtube_abc"}, stage


def test_many_files_are_opened_by_few_tasks(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(300).selectExpr(
        "concat('a b+%/', id, '.txt') AS path", "IF(id = 7, NULL, concat('é\\n', id)) AS document")
    keyed_files.write_files(rows, root)
    found = keyed_files.read_files(spark, root)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert dict(map(tuple, found.collect())) == {
        f"a b+%/{i}.txt": "" if i == 7 else f"é\n{i}" for i in range(300)}
