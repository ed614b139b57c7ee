"""Documents, stage tables, staleness, incremental runs, responses."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import batches, providers, responses
from sparkreel.plans import incremental, stages
from sparkreel.schemas import CLIPS, SEGMENTS, VERSIONED_SEGMENTS
from sparkreel.sources import documents, files, manifests, stage_tables
from sparkreel.streaming import intake
from sparkreel.streaming.intake import run_incremental

SOURCE = {"source_type": "local", "location": "/v/a.mp4", "title": None}


def stored(spark, tmp_path, *texts, project="p"):
    folder = tmp_path / f"project_id={project}"
    folder.mkdir()
    for at, text in enumerate(texts):
        (folder / f"{at}.json").write_text(
            text if isinstance(text, str) else json.dumps(text, indent=2), encoding="utf-8")
    return documents.read_documents(spark, str(tmp_path))


def test_numbers_written_as_text_are_read(spark, tmp_path):
    docs = stored(spark, tmp_path, {
        "source": SOURCE, "duration": "12.4", "language": "en",
        "segments": [{"id": "3", "start": "0", "end": 5.2, "text": "é"}]})
    row = documents.read_segments(docs).first()
    assert (row.project_id, row.idx, row.id, row.start_ms, row.end_ms, row.text) == (
        "p", 0, 3, 0, 5200, "é")
    assert documents.read_transcripts(docs).first().duration == 12.4


def test_missing_parts_default_or_go_to_quarantine(spark, tmp_path):
    docs = stored(
        spark, tmp_path,
        {"source": SOURCE, "evaluations": [{"candidate_id": 1, "score": 9},
                                           {"candidate_id": 2, "score": 1, "reason": None}]},
        {"source": SOURCE}, '{"source": ', {"evaluations": []},
        {"source": SOURCE, "evaluations": [{"candidate_id": "x", "score": 1}]})
    assert [(r.reason, r.suggested_title) for r in
            documents.read_evaluations(docs).orderBy("eval_pos").collect()] == [
        ("", None), ("None", None)]
    assert sorted(r.error for r in documents.corrupt_documents(docs, "evaluations").collect()) == [
        "bad evaluations.candidate_id", "invalid JSON", "missing source"]


def test_documents_beyond_one_parsed_value(spark, tmp_path):
    words = ["é" + "long " * 6_000_000, "next " * 6_000_000]  # 150 MB in five segments
    segments = [{"id": i, "start": i, "end": i + 1, "text": words[i % 2]} for i in range(5)]
    segments[4]["text"] = None
    whole = {"segments": segments + segments[:1], "source": SOURCE, "language": None, "duration": "5"}
    text = json.dumps(whole, ensure_ascii=False)
    assert len(text) > 128 << 20
    bad = text.replace('"start": 3', '"start": "x"')
    tail = json.dumps({"source": SOURCE, "language": "en", "duration": 1, "segments": segments[1:2]})
    assert len(tail) > documents.LARGE_BYTES
    docs = stored(spark, tmp_path, text, text[:-1], bad, tail + " garbage", tail + "]", tail + tail)
    rows = documents.read_segments(docs).select(
        "project_id", "idx", "id", "start_ms", "end_ms", F.sha2("text", 256)).orderBy("idx").collect()
    sha = [hashlib.sha256(w.encode()).hexdigest() for w in (*words, "None")]
    assert [tuple(r) for r in rows] == [
        ("p", i, s["id"], s["start"] * 1000, s["end"] * 1000, sha[k])
        for i, (s, k) in enumerate(zip(whole["segments"], (0, 1, 0, 1, 2, 0)))]
    errors = documents.corrupt_documents(docs, "transcript").select("error").collect()
    assert sorted(r.error for r in errors) == ["bad segments.start"] + ["invalid JSON"] * 4


def test_packaging_round_trip(spark, tmp_path):
    whole = {"clip_id": 3, "title": "t", "hook": "h", "caption": "c", "description": "d",
             "thumbnail_text": "x", "content_angle": "a", "hashtags": ["#a", "#ü"]}
    row = documents.read_packaging(stored(spark, tmp_path, whole)).first().asDict()
    assert row.pop("project_id") == "p" and row == whole


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "project_id bigint, stage string")


def test_missing_stage_makes_later_ones_stale(spark):
    every = ["audio", "transcript", "candidates", "evaluations", "clip_plan", "packaging"]
    rows = [(1, s) for s in every if s != "evaluations"] + [(2, s) for s in every if s != "transcript"]
    rows += [(3, s) for s in every] + [(4, s) for s in every if s != "packaging"]
    projects = spark.createDataFrame([(n,) for n in range(1, 6)], "project_id bigint")
    found = frame(spark, rows)
    stale = {}
    for row in stages.stale_stages(projects, found).collect():
        stale.setdefault(row.project_id, set()).add(row.stage)
    assert stale == {1: {"clip_plan", "packaging"},
                     2: {"candidates", "evaluations", "clip_plan", "packaging"}}
    todo = {r.project_id for r in stages.needs_work(projects, found, "packaging").collect()}
    assert todo == {1, 2, 4, 5}
    plan = {(r.project_id, r.stage) for r in stages.work_plan(projects, found).collect()}
    for stage in stages.ORDER:
        need = {r.project_id for r in stages.needs_work(projects, found, stage).collect()}
        assert need == {p for p, s in plan if s == stage}
    status = {r.project_id: r for r in stages.project_status(projects, found).collect()}
    assert status[3].discovery_complete and not status[5].transcript_exists
    assert not status[1].intelligence_complete and status[1].planning_complete


def test_newer_batch_replaces_whole_projects(spark, tmp_path):
    root = str(tmp_path)

    def rows(*values):
        return spark.createDataFrame(list(values), "source_id bigint, v int")

    stage_tables.write_stage(rows((1, 1), (1, 2), (2, 3)), rows((1, 0), (2, 0)), root, "s", 0)
    stage_tables.write_rows(rows((2, 9)), root, "s", 1)  # never committed
    assert sorted(r.v for r in stage_tables.read_stage(spark, root, "s").collect()) == [1, 2, 3]
    stage_tables.write_stage(rows((1, 7)), rows((1, 0)), root, "s", 2)
    assert sorted(r.v for r in stage_tables.read_stage(spark, root, "s").collect()) == [3, 7]
    stage_tables.write_stage(rows((5, 5)).filter("v < 0"), rows((2, 0)), root, "s", 3)
    assert sorted(r.v for r in stage_tables.read_stage(spark, root, "s").collect()) == [7]
    assert stage_tables.next_batch(spark, root, ["s", "none"]) == 4


def numbers(spark, *values):
    return spark.createDataFrame(list(values), "source_id bigint, v int")


def test_many_batches_leave_few_runs(spark, tmp_path, monkeypatch):
    """Merged runs give what all batches gave; old folders go once no reader needs them."""
    monkeypatch.setattr(stage_tables, "FAN", 3)
    merge = stage_tables.merge_runs
    monkeypatch.setattr(
        stage_tables, "merge_runs", lambda s, r, n, k: merge(s, r, n, k, fan=3))
    root, want, active = str(tmp_path), {}, []
    reader = None
    for batch in range(14):
        keys = [batch % 5, 10 + batch]
        rows = [(k, batch * 10 + i) for k in keys for i in range(2)]
        if batch == 9:
            rows = rows[:2]  # the second project ends up empty
        stage_tables.write_stage(
            numbers(spark, *rows), numbers(spark, *[(k, 0) for k in keys]), root, "s", batch)
        want |= {k: sorted(v for key, v in rows if key == k) for k in keys}
        active.append(len(stage_tables._newest(spark, root, "s")[1]["runs"]))
        if batch == 6:
            reader = stage_tables.read_stage(spark, root, "s"), dict(want)
    found = {k: [] for k in want}
    for row in stage_tables.read_stage(spark, root, "s").collect():
        found[row.source_id].append(row.v)
    assert {k: sorted(v) for k, v in found.items()} == want
    # A reader that began before the later merges still sees what it saw.
    seen = {k: [] for k in reader[1]}
    for row in reader[0].collect():
        seen[row.source_id].append(row.v)
    assert {k: sorted(v) for k, v in seen.items()} == reader[1]
    assert max(active) <= 6 and stage_tables.next_batch(spark, root, ["s"]) == 14
    stage_tables.remove_superseded(spark, root, "s", retain_seconds=3600)
    assert len(files.names(spark, f"{root}/s/rows")) > 14
    stage_tables.remove_superseded(spark, root, "s", retain_seconds=-1)
    assert len(files.names(spark, f"{root}/s/rows")) == active[-1]
    assert len(files.names(spark, f"{root}/s/manifest")) <= 2  # with its checksum
    wanted = spark.createDataFrame([(3,), (19,)], "source_id bigint")
    rows = stage_tables.read_stage(spark, root, "s", wanted=wanted)
    assert sorted(r.v for r in rows.collect()) == want[3]
    newest = {r.source_id: r.batch for r in
              stage_tables.committed_projects(spark, root, "s").collect()}
    assert newest[19] == 9 and newest[3] == 13 and len(newest) == len(want)


def test_a_merge_cut_short_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for batch in range(4):
        stage_tables.write_stage(numbers(spark, (batch, batch)), numbers(spark, (batch, 0)),
                                 root, "s", batch)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(stage_tables, "_publish", killed)
    with pytest.raises(RuntimeError):
        stage_tables.merge_runs(spark, root, "s", fan=4)
    monkeypatch.undo()
    rows = stage_tables.read_stage(spark, root, "s").collect()
    assert sorted(r.v for r in rows) == [0, 1, 2, 3]
    assert stage_tables.merge_runs(spark, root, "s", fan=4)
    assert not stage_tables.merge_runs(spark, root, "s", fan=4)
    rows = stage_tables.read_stage(spark, root, "s").collect()
    assert sorted(r.v for r in rows) == [0, 1, 2, 3]
    with pytest.raises(FileExistsError):
        files.publish_text(spark, f"{root}/s/manifest/{0:012d}.json", "{}")


def test_merged_stage_without_rows(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(2):
        stage_tables.write_stage(numbers(spark, (1, 5)).limit(0), numbers(spark, (1, 0)),
                                 root, "s", batch)
    assert stage_tables.merge_runs(spark, root, "s", fan=2)
    rows = stage_tables.read_stage(spark, root, "s")
    assert rows.count() == 0 and set(rows.columns) == {"source_id", "v"}


def test_runs_look_at_open_projects_only(spark, tmp_path, monkeypatch):
    """Unfinished projects are taken up again; finished ones are not looked at."""
    looked = []
    inner = incremental.fresh_stages

    def watched(spark, root, chain=None, wanted=None):
        looked.append({r.source_id for r in wanted.collect()})
        return inner(spark, root, chain, wanted)

    monkeypatch.setattr(incremental, "fresh_stages", watched)
    answered = {1}

    def scorer(candidates):
        return candidates.filter(F.col("source_id").isin(sorted(answered))).selectExpr(
            "source_id", "candidate_id AS eval_pos", "candidate_id", "9.0D AS score",
            "'' AS reason", "CAST(NULL AS STRING) AS suggested_title")

    def run(source):
        spark.createDataFrame(
            [(source, i, i * 9000, i * 9000 + 8000, f"t {i}") for i in range(10)],
            SEGMENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        looked.clear()
        intake.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out", scorer)
        clips = stage_tables.read_stage(spark, f"{tmp_path}/out", "clip_plan")
        return {r.source_id for r in clips.collect()}, set().union(*looked)

    assert run(1) == ({1}, {1})
    assert run(2) == ({1}, {2})
    answered.update({2, 3})
    assert run(3) == ({1, 2, 3}, {2, 3})
    assert open_left(spark, f"{tmp_path}/out") == set()


def open_left(spark, root):
    left = incremental.open_projects(spark, root)
    return set() if left is None else {r.source_id for r in left.collect()}


def test_deliveries_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    sent = [[(1, c, n, float(rng.randrange(10))) for c in rng.sample(range(6), 3)] for n in range(5)]
    want = {c: (n, score) for rows in sent for _, c, n, score in rows}
    kind = "source_id bigint, candidate_id bigint, sent bigint, score double"
    for trial in range(2):
        order = sent + [sent[1], [(2, None, 9, 1.0)]]
        rng.shuffle(order)
        root = f"{tmp_path}/{trial}"
        for rows in order:
            batches.merge_into_stage(spark, root, "e", spark.createDataFrame(rows, kind))
        found = stage_tables.read_stage(spark, root, "e").collect()
        assert {r.candidate_id: (r.sent, r.score) for r in found} == want
        assert len(found) == len(want)


def test_incremental_run_does_each_project_once(spark, tmp_path):
    calls = []

    def scorer(candidates):
        calls.append({r.source_id for r in candidates.select("source_id").collect()})
        return candidates.selectExpr(
            "source_id", "candidate_id AS eval_pos", "candidate_id", "9.0D AS score",
            "'' AS reason", "CAST(NULL AS STRING) AS suggested_title")

    def drop(source, shift=0):
        spark.createDataFrame(
            [(source, i, i * 9000 + shift, i * 9000 + 8000 + shift, f"t {i}") for i in range(10)],
            SEGMENTS).write.mode("append").parquet(f"{tmp_path}/incoming")

    def run():
        run_incremental(spark, f"{tmp_path}/incoming", f"{tmp_path}/tables", scorer)
        clips = stage_tables.read_stage(spark, f"{tmp_path}/tables", "clip_plan")
        return {(r.source_id, r.start_ms) for r in clips.filter("clip_id = 1").collect()}

    drop(1)
    assert run() == {(1, 0)}
    assert run() == {(1, 0)}
    drop(2)
    assert run() == {(1, 0), (2, 0)}
    drop(1, shift=500)
    assert run() == {(1, 500), (2, 0)}
    assert calls == [{1}, {2}, {1}]
    fresh = incremental.fresh_stages(spark, f"{tmp_path}/tables")
    assert fresh.groupBy("project_id").count().filter("count = 5").count() == 2


def test_incomplete_scores_are_not_committed(spark, tmp_path):
    rows = spark.createDataFrame(
        [(s, i, i * 9000, i * 9000 + 8000, "t") for s in (1, 2) for i in range(10)], SEGMENTS)
    stage_tables.write_stage(rows, rows, str(tmp_path), "transcript", 0)

    def scorer(candidates):
        return candidates.filter("source_id = 1").selectExpr(
            "source_id", "candidate_id AS eval_pos", "candidate_id", "9.0D AS score",
            "'' AS reason", "CAST(NULL AS STRING) AS suggested_title")

    incremental.run_missing_stages(spark, str(tmp_path), scorer)
    planned = stage_tables.committed_projects(spark, str(tmp_path), "clip_plan")
    assert [r.source_id for r in planned.collect()] == [1]


def test_packaging_errors(spark):
    good = {name: "x" for name in responses.TEXT_FIELDS} | {"hashtags": ["a"]}
    cases = [
        (good, []), (good | {"hashtags": []}, []), (good | {"title": "  "}, ["title cannot be empty"]),
        (good | {"title": None}, ["title must be a string"]), ([1], ["not an object"]),
        (good | {"hashtags": ["a", None]}, ["every hashtag must be a string"]),
        ({k: v for k, v in good.items() if k not in ("hook", "title")}, ["missing hook,title"]),
    ]
    rows = [(n, json.dumps(case)) for n, (case, _) in enumerate(cases)] + [(99, "{")]
    got = {r.n: r.errors for r in responses.validate_packaging(
        spark.createDataFrame(rows, "n int, raw string")).collect()}
    assert got == {n: errors for n, (_, errors) in enumerate(cases)} | {99: ["invalid JSON"]}


def test_one_bad_item_rejects_the_response(spark):
    rows = [(1, '[{"candidate_id": 1, "score": 3.5}, {"candidate_id": 2, "score": 12}]'),
            (2, '[{"candidate_id": "7", "score": "7.5", "reason": null}]'), (3, '["x"]'),
            (4, '[{"candidate_id": 8, "score": 1, "reason": 5.0}]'),
            (5, '[{"candidate_id": 9, "score": 1, "reason": 5}]')]
    got = sorted(
        ((r.source_id, r.error, r.candidate_id, r.score, r.reason) for r in
         responses.parse_evaluations(
             spark.createDataFrame(rows, "source_id bigint, raw string")).collect()),
        key=str)
    assert got == [(1, "score out of range", None, None, None), (2, None, 7, 7.5, "None"),
                   (3, "item is not an object", None, None, None), (4, None, 8, 1.0, "5.0"),
                   (5, None, 9, 1.0, "5")]


# One value and something behind it, in every shape that a lenient reader takes.
TRAILING = [
    '[{"candidate_id":1,"score":5}] and some prose', '[{"candidate_id":1,"score":5}][1]',
    '[{"candidate_id":1,"score":5}],[2]', '[{"candidate_id":1,"score":5}]]', '[] x', '[],"v":[]',
    '[]],[[]', '[]},{"v":[]', "",
]


def test_text_behind_a_response_is_refused(spark):
    rows = [(n, raw) for n, raw in enumerate(TRAILING)] + [
        (100, ' \n[{"candidate_id":1,"score":5}]\t ')]
    got = {r.source_id: r.error for r in responses.parse_evaluations(
        spark.createDataFrame(rows, "source_id bigint, raw string")).collect()}
    assert got == {n: "invalid JSON" for n in range(len(TRAILING))} | {100: None}
    good = json.dumps({name: "x" for name in responses.TEXT_FIELDS} | {"hashtags": ["a"]})
    rows = [(1, 1, good), (1, 2, good + " {}"), (1, 3, good + good), (1, 4, "null"), (1, 5, good + "}")]
    table = spark.createDataFrame(rows, "source_id bigint, clip_id bigint, raw string")
    found = {r.clip_id: r.errors for r in responses.validate_packaging(table).collect()}
    assert found == {1: [], 2: ["invalid JSON"], 3: ["invalid JSON"], 4: ["not an object"],
                     5: ["invalid JSON"]}
    assert {r.clip_id for r in responses.invalid_packaging(table).collect()} >= {2, 3, 5}
    read = providers.read_packaging_responses(table).filter("title IS NOT NULL").collect()
    assert [r.clip_id for r in read] == [1]


def test_text_behind_a_document_is_refused(spark, tmp_path):
    whole = json.dumps({"source": SOURCE, "evaluations": []})
    docs = stored(spark, tmp_path, whole, whole + " garbage", whole + "\n" + whole, whole + "]")
    errors = documents.corrupt_documents(docs, "evaluations").collect()
    assert [r.error for r in errors] == ["invalid JSON"] * 3


def test_column_scorer(spark):
    content = spark.createDataFrame([(1, 1, 3.0), (1, 2, 30.0)],
                                    "source_id bigint, candidate_id bigint, s double")
    errors = [r.error for r in providers.score_candidates(content, F.col("s"))
              .orderBy("candidate_id").collect()]
    assert errors == [None, "score out of range"]


def test_repeated_keys_read_the_last_value(spark):
    rows = [(1, '[{"candidate_id": 1, "score": 5, "score": 6}]')]
    got = responses.parse_evaluations(
        spark.createDataFrame(rows, "source_id bigint, raw string")).collect()
    assert [(r.error, r.score) for r in got] == [(None, 6.0)]


def scored(spark, answers, batch_size=2):
    content = spark.createDataFrame(
        [(1, i, i * 1000, i * 1000 + 500, "t") for i in range(1, 5)],
        "source_id bigint, candidate_id bigint, start_ms bigint, end_ms bigint, "
        "transcript_text string")
    sources = spark.createDataFrame([(1, "A", "x")], "source_id bigint, title string, location string")

    def answer(title, payload):
        asked = [item["candidate_id"] for item in json.loads(payload)]
        return json.dumps([{"candidate_id": i, "score": 7} for i in asked if i in answers])

    return providers.score_candidates(content, answer, sources=sources, batch_size=batch_size)


def test_response_that_omits_ids_is_refused(spark):
    got = [(r.eval_pos, r.candidate_id, r.error) for r in
           scored(spark, {1, 2, 4}).orderBy("eval_pos").collect()]
    assert got == [(None, None, "missing candidate ids: 3"), (1, 1, None), (2, 2, None)]


def test_evaluations_of_a_function_are_numbered(spark):
    content = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 3)], "source_id bigint, candidate_id bigint")
    raws = [(1, f'[{{"candidate_id": {i}, "score": 5}}]') for i in (3, 1, 2)]
    found = providers.score_candidates(
        content, lambda c: spark.createDataFrame(raws, "source_id bigint, raw string"))
    assert sorted((r.eval_pos, r.candidate_id) for r in found.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_intake_of_versions_parts_and_gaps(spark, tmp_path):
    def drop(source, low, high, tag):
        rows = [(source, i, i * 10_000, i * 10_000 + 9_000, f"{tag} {i}.") for i in range(low, high)]
        spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.parquet(
            f"{tmp_path}/in", mode="append")

    def scorer(candidates):
        return candidates.selectExpr(
            "source_id", "candidate_id AS eval_pos", "candidate_id", "8D AS score", "'' AS reason",
            "CAST(NULL AS STRING) AS suggested_title")

    drop(1, 0, 12, "old")
    time.sleep(1.1)  # file times have seconds
    drop(1, 0, 8, "new")
    drop(2, 0, 15, "a")
    drop(2, 15, 30, "b")
    drop(3, 5, 9, "gap")
    root = f"{tmp_path}/tables"
    intake.run_incremental(spark, f"{tmp_path}/in", root, scorer)
    stored = stage_tables.read_stage(spark, root, "transcript").collect()
    assert sorted((r.source_id, r.idx, r.text.split()[0]) for r in stored) == (
        [(1, i, "new") for i in range(8)]
        + [(2, i, "a" if i < 15 else "b") for i in range(30)])
    aside = spark.read.parquet(f"{root}/quarantine").collect()
    assert {(r.source_id, r.reason) for r in aside} == {(3, "positions are not 0 to n-1")}


def test_untold_versions_do_not_mix(spark, tmp_path):
    """An old transcript in two files and a newer one in a single file that covers the first."""
    def drop(low, high, tag):
        rows = [(1, i, i * 10_000, i * 10_000 + 9_000, f"{tag}{i}") for i in range(low, high)]
        spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.parquet(
            f"{tmp_path}/in", mode="append")

    drop(0, 10, "old")
    drop(10, 20, "old")
    time.sleep(1.1)
    drop(0, 10, "new")
    intake.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out", None)
    kept = stage_tables.read_stage(spark, f"{tmp_path}/out", "transcript").collect()
    assert sorted(r.text for r in kept) == sorted(f"new{i}" for i in range(10))


def test_every_order_of_arrival(spark, tmp_path):
    """Parts of three versions in random order and batches: always the newest whole version."""
    rng = random.Random(6)
    root, sizes = f"{tmp_path}/out", {1: 6, 2: 4, 3: 7}
    sent = {source: set() for source in range(8)}
    parts = [(source, version, part) for source in sent for version in sizes for part in range(2)]
    rng.shuffle(parts)
    parts = [p for p in parts if p != (3, 3, 0)] + parts[:4]  # one never comes, some come twice
    for begin in range(0, len(parts), 9):
        rows = []
        for source, version, part in parts[begin : begin + 9]:
            n = sizes[version]
            rows += [(source, i, i * 1000, i * 1000 + 900, f"v{version}", version, n)
                     for i in range(n) if (i >= n // 2) == bool(part)]
            sent[source].add((version, part))
        spark.createDataFrame(rows, VERSIONED_SEGMENTS).repartition(3).write.parquet(
            f"{tmp_path}/in", mode="append")
        intake.run_incremental(spark, f"{tmp_path}/in", root, None)
        want = Counter()
        for source, have in sent.items():
            whole = [v for v in sizes if {(v, 0), (v, 1)} <= have]
            if whole:
                want[(source, f"v{max(whole)}")] = sizes[max(whole)]
        kept = stage_tables.read_stage(spark, root, "transcript")
        found = Counter((r.source_id, r.text) for r in kept.collect())
        assert found == want
    held = stage_tables.read_stage(spark, root, intake.HELD).collect()
    assert {(r.source_id, r.version) for r in held} == {(3, 3)}


def test_spoilt_versions_are_set_aside(spark, tmp_path):
    good = [(1, i, i * 1000, i * 1000 + 900, "good", 1, 3) for i in range(3)]
    twice = [(1, i % 3, i * 1000, i * 1000 + 900, "twice", 2, 3) for i in range(4)]
    falling = [(1, i, 0, 5000 - i, "falls", 3, 3) for i in range(3)]
    uncounted = [(1, i, i * 1000, i * 1000 + 900, "no count", 4, None) for i in range(3)]
    beyond = [(1, 5, 5000, 5900, "beyond", 5, 3)]
    rows = good + twice + falling + uncounted + beyond
    spark.createDataFrame(rows, VERSIONED_SEGMENTS).write.parquet(f"{tmp_path}/in")
    intake.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out", None)
    kept = stage_tables.read_stage(spark, f"{tmp_path}/out", "transcript").collect()
    assert {r.text for r in kept} == {"good"}
    aside = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert {(r.text, r.reason) for r in aside} == {
        ("twice", intake.GAPS), ("falls", intake.BACK), ("no count", intake.UNCOUNTED),
        ("beyond", intake.GAPS)}


def test_rows_without_a_source_reach_the_quarantine(spark, tmp_path):
    rows = [(s, i, i * 10_000, i * 10_000 + 9_000, "Some text.") for s in (1, None) for i in range(3)]
    spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in")

    def scorer(candidates):
        return candidates.selectExpr(
            "source_id", "1L eval_pos", "candidate_id", "1D score", "'' reason",
            "CAST(NULL AS string) suggested_title")

    intake.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out", scorer)
    aside = spark.read.parquet(f"{tmp_path}/out/quarantine").collect()
    assert sorted((r.source_id, r.idx, r.reason) for r in aside) == [
        (None, i, "positions are not 0 to n-1") for i in range(3)]
    kept = stage_tables.read_stage(spark, f"{tmp_path}/out", "transcript")
    assert {r.source_id for r in kept.collect()} == {1}


def test_wanted_rows_come_from_their_batches_only(spark, tmp_path):
    for batch, source in enumerate((1, 2, 3)):
        rows = spark.createDataFrame([(source, batch)], "source_id bigint, v bigint")
        stage_tables.write_stage(rows, rows, str(tmp_path), "transcript", batch)
    wanted = spark.createDataFrame([(2,)], "source_id bigint")
    rows = stage_tables.read_stage(spark, str(tmp_path), "transcript", wanted=wanted)
    assert [tuple(r) for r in rows.select("source_id", "v").collect()] == [(2, 1)]
    assert {f.split("batch=")[1][0] for f in rows.inputFiles() if "/rows/" in f} == {"1"}


def test_packaging_resumes_with_what_is_missing(spark, tmp_path):
    root, asked = str(tmp_path), f"{tmp_path}/asked"
    clips = spark.createDataFrame(
        [(1, i, i, i * 60_000, i * 60_000 + 30_000, 8.0, "", None) for i in (1, 2, 3)], CLIPS)
    content = spark.createDataFrame(
        [(1, i, i * 60_000, i * 60_000 + 30_000, "text" if i < 3 else " ") for i in (1, 2, 3)],
        "source_id bigint, candidate_id bigint, start_ms bigint, end_ms bigint, "
        "transcript_text string")
    sources = spark.createDataFrame(
        [(1, "A", "x")], "source_id bigint, title string, location string")
    for stage, rows in (("transcript", content), ("candidates", content), ("evaluations", content),
                        ("clip_plan", clips)):
        stage_tables.write_stage(rows, rows, root, stage, 0)

    def packager(broken):
        def answer(title, payload):
            clip = json.loads(payload)["clip_id"]
            with open(asked, "a") as log:
                log.write(f"{clip}\n")
            good = {name: "x" for name in responses.TEXT_FIELDS} | {"hashtags": ["a"]}
            return "{" if clip in broken else json.dumps(good)
        return answer

    incremental.run_missing_packaging(spark, root, packager({2}), sources)
    assert [r.clip_id for r in stage_tables.read_stage(spark, root, "packaging").collect()] == [1]
    open(asked, "w").close()
    incremental.run_missing_packaging(spark, root, packager(set()), sources)
    assert set(open(asked).read().split()) == {"2"}
    for stage in ("packaging", "thumbnails"):
        rows = stage_tables.read_stage(spark, root, stage).collect()
        assert sorted(r.clip_id for r in rows) == [1, 2]


def test_source_and_packaging_round_trip(spark, tmp_path):
    sources = spark.createDataFrame(
        [(1, "local", "/v/é.mp4", None)],
        "source_id bigint, source_type string, location string, title string")
    document = manifests.source_documents(sources).first().document
    (tmp_path / "s").mkdir()
    read = documents.read_sources(stored(spark, tmp_path / "s", document)).first()
    assert (read.source_type, read.location, read.title) == ("local", "/v/é.mp4", None)
    values = {name: f"{name} ü" for name in responses.TEXT_FIELDS}
    packaging = spark.createDataFrame(
        [(1, 7, *values.values(), ["#a", "b"])],
        "source_id bigint, clip_id bigint, "
        + ", ".join(f"{name} string" for name in values) + ", hashtags array<string>")
    (tmp_path / "p").mkdir()
    found = stored(spark, tmp_path / "p", manifests.packaging_documents(packaging).first().document)
    row = documents.read_packaging(found).first().asDict()
    assert row["clip_id"] == 7 and row["hashtags"] == ["#a", "b"]
    assert {name: row[name] for name in values} == values
    expected = spark.createDataFrame([("p",), ("q",)], "project_id string")
    assert [tuple(r) for r in documents.missing_documents(found, expected).collect()] == [
        ("q", "artifact does not exist", None)]


def test_texts_are_parsed_once(spark, tmp_path):
    raw = ['{"source":{"source_type":"local","location":"/v/1.mp4"},"duration":1.0,"language":"en",'
           '"segments":[{"id":0,"start":0.0,"end":1.0,"text":"a"}]}']
    spark.createDataFrame([(r,) for r in raw], "document string").write.text(f"{tmp_path}/d")
    found = documents.read_documents(spark, f"{tmp_path}/d", per_line=True)
    answers = spark.createDataFrame([(1, 1, r) for r in raw], "source_id int, clip_id int, raw string")
    frames = [
        documents.read_transcripts(found), documents.read_segments(found),
        responses.parse_evaluations(answers).filter("error IS NULL"),
        responses.invalid_packaging(answers), providers.read_packaging_responses(answers),
    ]
    for at, frame in enumerate(frames):
        # Large documents are the second of two branches.
        plan = frame._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Union" and at < 2:
            plan = plan.children().head()
        plan = plan.children().head() if at < 2 else plan
        assert plan.toString().count("parseJson") == 1


def test_frames_of_a_text_cannot_be_left(spark):
    bad = ["", " ", "1,2", "1],[2", '1,"x"]', "1}", "{}{}", "[1]],[2", "1,", ",1", "null,null", "x"]
    good = ["1", " 1\n", "null", "[]", "[1,2]", '{"a":[1,"]"]}', '"],"', '{"a":1,"a":2}']
    responses.last_key_wins(spark)
    rows = spark.createDataFrame([(r,) for r in bad + good], "raw string").select(
        "raw", responses.whole_document(F.col("raw")).isNotNull().alias("whole"))
    assert {r.raw for r in rows.collect() if r.whole} == set(good)
