"""Every operator as a query over the driver tables, with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.functions import timing
from sparkreel.functions.text import escape_dialogue, safe_filename
from sparkreel.operators import batches
from sparkreel.operators import candidates as content_ops
from sparkreel.operators import captions as caption_ops
from sparkreel.operators import catalog, discovery, planning, providers, thumbnails
from sparkreel.operators import responses as response_ops
from sparkreel.operators import segments as segment_ops
from sparkreel.plans import stages as stage_ops
from sparkreel.plans.lineage import free_shuffles, shared_folder
from sparkreel.sources import documents as docs
from sparkreel.sources import keyed_files, manifests, stage_tables
from sparkreel.streaming.intake import run_incremental
from workload import fixtures as fx
from workload.oracle import ass_time, cs, near_dup, safe_name, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return function

    return register


# ---- inputs ---------------------------------------------------------------------------------


def choose_clips(candidates: DataFrame) -> DataFrame:
    return planning.plan_clips(
        candidates, fx.evaluations(candidates),
        candidates_per_source=discovery.DEFAULTS.max_candidates,
    )


_STORED: dict[tuple[str, str, str], str] = {}


class Inputs:
    """The derived tables of one scale factor.

    Transcripts and the stages made from them are written to shared storage once per session, as
    a run would keep them in stage tables; queries read back only the columns they need.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = self.folder()
            make().write.parquet(path)
            free_shuffles(self.spark)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @property
    def segments(self) -> DataFrame:
        """With the stored text flag, which spares discovery reading the text."""
        return self._stored(
            "segments",
            lambda: segment_ops.with_text_flag(fx.segments(self.spark, self.sf_dir)),
        )

    @property
    def sources(self) -> DataFrame:
        return fx.sources(self.spark, self.sf_dir)

    @property
    def candidates(self) -> DataFrame:
        return self._stored(
            "candidates", lambda: discovery.discover_candidates(self.segments)
        )

    @property
    def windows(self) -> DataFrame:
        return discovery.window_ends(self.segments)

    @property
    def evaluations(self) -> DataFrame:
        return fx.evaluations(self.candidates)

    @property
    def clips(self) -> DataFrame:
        return self._stored("clips", lambda: choose_clips(self.candidates))

    @property
    def content(self) -> DataFrame:
        return self._stored(
            "content", lambda: content_ops.build_candidates(self.candidates, self.segments)
        )

    @property
    def captions(self) -> DataFrame:
        return caption_ops.captions(self.clips, self.segments)

    @property
    def stages(self) -> DataFrame:
        return fx.stages(self.spark, self.sf_dir)

    @property
    def projects(self) -> DataFrame:
        return fx.projects(self.spark, self.sf_dir)

    @property
    def urls(self) -> DataFrame:
        return fx.source_urls(self.spark, self.sf_dir)

    def folder(self) -> str:
        """A new folder in shared storage."""
        return f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"

    def staged(self, documents: DataFrame, column: str = "document") -> DataFrame:
        """JSON documents written one per line and read back as stored documents.

        Texts stand in them plain and again segment by segment, so they are stored compressed.
        """
        path = self.folder()
        documents.select(column).write.text(path, compression="gzip")
        free_shuffles(self.spark)
        return docs.read_documents(self.spark, path, per_line=True)


def over(name: str, oracle: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], None]:
    """Registers a query that works on ``Inputs``."""

    def register(function: Callable[[Inputs], DataFrame]) -> None:
        query(name, oracle)(lambda spark, sf_dir: function(Inputs(spark, sf_dir)))

    return register


def as_lines(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda item: item.cast("string")), ",")


# ---- sources and sinks ----------------------------------------------------------------------

over(
    "read_transcripts",
    """SELECT s.project_id, max(g.end_ms) / 1000 AS duration, s.language, count(*) AS segments,
              CAST(sum(g.end_ms - g.start_ms) AS BIGINT) AS spoken_ms,
              CAST(sum(length(g.text)) AS BIGINT) AS characters
       FROM sources s JOIN segments g USING (source_id) GROUP BY 1, 3""",
)(lambda t: (lambda stored: docs.read_transcripts(stored).join(
    docs.read_segments(stored).groupBy("project_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"),
        F.sum(F.length("text").cast("bigint")).alias("characters"),
    ), "project_id"))(t.staged(manifests.transcript_documents(t.sources, t.segments))))

over(
    "read_candidates",
    """SELECT s.project_id, count(*) OVER (PARTITION BY c.source_id) AS total_candidates,
              c.candidate_id - 1 AS candidate_pos, c.candidate_id, c.start_ms, c.end_ms,
              c.transcript_text, c.end_idx - c.start_idx + 1 AS segments
       FROM content c JOIN sources s USING (source_id)""",
)(lambda t: docs.read_candidates(t.staged(manifests.candidate_documents(
    t.sources, content_ops.build_candidates(t.candidates, t.segments, with_segments=True)
))).withColumn("segments", F.size("segments").cast("bigint")))

over(
    "read_evaluations",
    """SELECT s.project_id, e.eval_pos - 1 AS eval_pos, e.candidate_id, e.score, e.reason,
              e.suggested_title FROM evaluations e JOIN sources s USING (source_id)""",
)(lambda t: docs.read_evaluations(
    t.staged(manifests.evaluation_documents(t.sources, t.evaluations))))

over(
    "read_clip_plan",
    """SELECT s.project_id, c.clip_id, c.candidate_id, c.start_ms, c.end_ms,
              round((c.end_ms - c.start_ms) / 1000, 2) AS duration, c.final_score, c.reason, c.title
       FROM clips c JOIN sources s USING (source_id)""",
)(lambda t: docs.read_clip_plans(t.staged(manifests.clip_plan_documents(t.sources, t.clips))))

over(
    "read_sources",
    "SELECT project_id, source_type, location, title FROM sources WHERE language <> 'de'",
)(lambda t: docs.read_sources(t.staged(t.sources.select(F.to_json(F.struct(
    F.when(F.col("language") != "de", F.col("source_type")).alias("source_type"),
    "location", "title",
)).alias("document")))))

over(
    "read_packaging",
    """SELECT clip_id, CASE c WHEN 0 THEN '  ' WHEN 5 THEN '12' ELSE concat('Title ', clip_id) END
                AS title, concat(' Part ', clip_id, ' ') AS thumbnail_text,
              CASE c WHEN 1 THEN 'a,3' WHEN 3 THEN '' WHEN 6 THEN 'a' ELSE 'a,b' END
                AS hashtags, count(*) AS n
       FROM (SELECT *, (source_id + clip_id) % 8 AS c FROM clips) WHERE c NOT IN (2, 4)
       GROUP BY ALL""",
)(lambda t: docs.read_packaging(t.staged(
    fx.packaging_responses(t.clips), "raw"
)).groupBy("clip_id", "title", "thumbnail_text", F.array_join("hashtags", ",").alias("hashtags"))
  .agg(F.count(F.lit(1)).alias("n")))


@query(
    "write_stage",
    """SELECT d.source_id, max(d.end_ms) + CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1000 END
                AS duration_ms
       FROM segments d LEFT JOIN labels l ON l.doc_id = d.source_id GROUP BY d.source_id, l.doc_id""",
)
def write_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in one batch, the labelled ones again in a second."""
    t = Inputs(spark, sf_dir)
    root = t.folder()
    rows = segment_ops.transcript_duration(t.segments)
    labelled = fx.table(spark, sf_dir, "labels").selectExpr("doc_id AS source_id")
    stage_tables.write_stage(rows, rows, root, "durations", 0)
    again = rows.join(labelled, "source_id", "left_semi").withColumn(
        "duration_ms", F.col("duration_ms") + 1000
    )
    stage_tables.write_stage(again, labelled, root, "durations", 1)
    return stage_tables.read_stage(spark, root, "durations")


over(
    "to_manifest_json",
    """SELECT source_id, CAST(to_json(struct_pack(
              source := struct_pack(source_type := any_value(s.source_type),
                location := any_value(s.location), title := any_value(s.title)),
              selected_clips := list(struct_pack(clip_id := c.clip_id,
                candidate_id := c.candidate_id, snapped_start_time := c.start_ms / 1000,
                snapped_end_time := c.end_ms / 1000, final_score := c.final_score,
                reason := c.reason, title := c.title) ORDER BY c.clip_id))) AS VARCHAR) AS document
       FROM clips c JOIN sources s USING (source_id) GROUP BY 1""",
)(
    lambda t: manifests.clip_plan_documents(t.sources, t.clips)
)


def _broken(documents: DataFrame) -> DataFrame:
    """Transcript documents, some cut short, without a duration, or with a bad segment."""
    return documents.withColumn(
        "document",
        F.expr("CASE source_id % 5 WHEN 1 THEN substring(document, 1, length(document) - 1)"
               " WHEN 2 THEN replace(document, '\"duration\"', '\"length\"')"
               " WHEN 3 THEN replace(document, '\"id\":0,', '\"id\":\"x\",')"
               " ELSE document END"),
    )


over(
    "corrupt_artifacts",
    """SELECT error, count(*) AS documents FROM (
         SELECT CASE source_id % 5 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'missing duration'
                  WHEN 3 THEN 'bad segments.id' END AS error
         FROM sources) WHERE error IS NOT NULL GROUP BY 1""",
)(lambda t: docs.corrupt_documents(
    t.staged(_broken(manifests.transcript_documents(t.sources, t.segments))), "transcript"
).groupBy("error").agg(F.count(F.lit(1)).alias("documents")))

# One JSON value or not, read from the raw text alone; the texts themselves are the strings in it.
over(
    "strict_documents",
    """SELECT doc_id, json_valid(raw) AS valid FROM (
         SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN j WHEN 1 THEN j || ' and some prose'
                  WHEN 2 THEN j || j WHEN 3 THEN j || ',' || j WHEN 4 THEN j || '}'
                  WHEN 5 THEN '  ' || j || chr(10) WHEN 6 THEN '[' || j || ']],[' || j
                  WHEN 7 THEN substr(j, 1, length(j) - 1) ELSE '[' || j || ',' || j || ']' END AS raw
         FROM (SELECT doc_id, CAST(json_object('text', text) AS VARCHAR) AS j FROM documents))""",
)(lambda t: fx.table(t.spark, t.sf_dir, "documents").select(
    "doc_id", F.to_json(F.struct("text")).alias("j")).selectExpr(
    "doc_id", "CASE doc_id % 9 WHEN 0 THEN j WHEN 1 THEN j || ' and some prose' WHEN 2 THEN j || j"
    " WHEN 3 THEN j || ',' || j WHEN 4 THEN j || '}' WHEN 5 THEN '  ' || j || char(10)"
    " WHEN 6 THEN '[' || j || ']],[' || j WHEN 7 THEN substr(j, 1, length(j) - 1)"
    " ELSE '[' || j || ',' || j || ']' END AS raw",
).select("doc_id", response_ops.whole_document(F.col("raw")).isNotNull().alias("valid")))

over(
    "missing_artifacts",
    """SELECT doc_id AS project_id, CASE WHEN l.doc_id IS NULL THEN 'artifact does not exist'
              WHEN doc_id % 5 = 1 THEN 'invalid JSON' ELSE 'bad evaluations.score' END AS error
       FROM documents LEFT JOIN (SELECT DISTINCT doc_id, true AS has FROM labels) l USING (doc_id)
       WHERE has IS NULL OR doc_id % 5 IN (1, 2)""".replace("l.doc_id IS NULL", "has IS NULL"),
)(lambda t: _absent_or_broken(t))


def _absent_or_broken(t: Inputs) -> DataFrame:
    """Evaluation documents of labelled projects, written and read back; some end too late."""
    labels = fx.table(t.spark, t.sf_dir, "labels").select("doc_id").distinct()
    every = fx.table(t.spark, t.sf_dir, "documents").select(F.col("doc_id").alias("project_id"))
    written = labels.join(every.withColumnRenamed("project_id", "doc_id"), "doc_id").select(F.expr(
        "concat('{\"source\":{\"source_type\":\"local\",\"location\":\"/v/', doc_id, '.mp4\"},',"
        " '\"evaluations\":[{\"candidate_id\":', doc_id, ',\"score\":', IF(doc_id % 5 = 2, 'null', '7'), '}]}',"
        " IF(doc_id % 5 = 1, ' end', ''))").alias("document"))
    found = t.staged(written).withColumn(
        "project_id", F.regexp_extract("raw", r"/v/(-?\d+)\.mp4", 1).cast("bigint"))
    return docs.missing_documents(found, every).unionByName(
        docs.corrupt_documents(found, "evaluations")).select("project_id", "error")


over(
    "normalize_segments",
    "SELECT source_id, idx, start_ms, end_ms, text FROM segments",
)(lambda t: docs.normalize_segments(fx.raw_segments(t.spark, t.sf_dir)))

# ---- projections, filters, predicates ---------------------------------------------------------

over(
    "durations",
    """SELECT 'segment' AS kind, source_id, idx AS id,
              round((end_ms - start_ms) / 1000, 3) AS duration FROM segments
       UNION ALL SELECT 'candidate', source_id, candidate_id,
              round((end_ms - start_ms) / 1000, 2) FROM candidates""",
)(lambda t: t.segments.select(
    F.lit("segment").alias("kind"), "source_id", F.col("idx").alias("id"),
    timing.duration_seconds(F.col("start_ms"), F.col("end_ms"), 3).alias("duration"),
).unionByName(t.candidates.select(
    F.lit("candidate").alias("kind"), "source_id", F.col("candidate_id").alias("id"),
    timing.duration_seconds(F.col("start_ms"), F.col("end_ms"), 2).alias("duration"),
)))

over("source_type", "SELECT page_id, location, source_type FROM identified")(
    lambda t: catalog.with_identity(t.urls).select("page_id", "location", "source_type"))
over("youtube_video_id", "SELECT page_id, video_id FROM identified")(
    lambda t: catalog.with_identity(t.urls).select("page_id", "video_id"))
over("source_identity", "SELECT page_id, project_id, identity FROM identified")(
    lambda t: catalog.with_identity(t.urls).select("page_id", "project_id", "identity"))
over(
    "canonical_sources",
    """SELECT project_id, arg_min(source_type, page_id) AS source_type,
              arg_min(location, page_id) AS location, count(*) AS spellings
       FROM identified GROUP BY 1""",
)(lambda t: catalog.canonical_sources(t.urls, "page_id"))

over(
    "display_titles",
    """SELECT c.source_id, c.clip_id,
              coalesce(nullif(c.title, ''), concat('Clip ', c.clip_id)) AS clip_title,
              coalesce(nullif(s.title, ''), 'Unknown') AS scoring_title,
              coalesce(nullif(s.title, ''), s.location) AS packaging_title
       FROM clips c JOIN sources s USING (source_id)""",
)(lambda t: t.clips.join(
    t.sources.withColumnRenamed("title", "source_title"), "source_id"
).select(
    "source_id", "clip_id",
    catalog.clip_title(F.col("title"), F.col("clip_id")).alias("clip_title"),
    catalog.scoring_title(F.col("source_title")).alias("scoring_title"),
    catalog.packaging_title(F.col("source_title"), F.col("location")).alias("packaging_title"),
))

over(
    "safe_filename",
    f"SELECT doc_id, {safe_name('text')} AS name FROM documents",
)(lambda t: fx.table(t.spark, t.sf_dir, "documents").select(
    "doc_id", safe_filename(F.col("text")).alias("name")))
over("artifact_paths", "SELECT * FROM outputs")(lambda t: catalog.output_paths(t.clips))

over("natural_starts", "SELECT source_id, idx, start_ms, pause_before_ms FROM starts")(
    lambda t: segment_ops.natural_starts(t.segments).select(
        "source_id", "idx", "start_ms", "pause_before_ms"))
over("eligible_evaluations", "SELECT * FROM evaluations WHERE score >= 7")(
    lambda t: planning.eligible_evaluations(t.evaluations))
over(
    "duration_bounds",
    "SELECT * FROM candidates WHERE end_ms - start_ms BETWEEN 15000 AND 180000",
)(lambda t: planning.within_duration(t.candidates))


def _fixed(ms: str, digits: int) -> str:
    units, scale = f"(({ms} + {500 // 10**digits}) // {1000 // 10**digits})", 10**digits
    return f"printf('%d.%0{digits}d', {units} // {scale}, {units} % {scale})"


over(
    "candidate_preview",
    f"""SELECT source_id, candidate_id, concat(candidate_id, ': ', {_fixed('start_ms', 1)}, 's -> ',
              {_fixed('end_ms', 1)}, 's | ', substr(transcript_text, 1, 120), '...') AS line
        FROM content""",
)(lambda t: content_ops.preview(t.content))
over(
    "tail_scan",
    f"""SELECT source_id, idx, concat({_fixed('start_ms', 2)}, ' -> ', {_fixed('end_ms', 2)}, ': ',
              text) AS line FROM segments WHERE start_ms >= 120000""",
)(lambda t: segment_ops.tail_scan(t.segments, 120.0))
over(
    "evaluation_payload",
    """SELECT source_id, (candidate_id - 1) // 40 + 1 AS batch, count(*) AS candidates,
              CAST(to_json(list(struct_pack(candidate_id := candidate_id,
                duration_seconds := round(round((end_ms - start_ms) / 1000, 2), 1),
                transcript := transcript_text) ORDER BY candidate_id)) AS VARCHAR) AS payload
       FROM content GROUP BY 1, 2""",
)(lambda t: content_ops.evaluation_payloads(t.content))
over(
    "edit_plan",
    """SELECT c.source_id, printf('clip_%02d', c.clip_id) AS clip_name, 1080 AS width,
              1920 AS height, 32.0::DOUBLE AS blur, 0.58::DOUBLE AS brightness, 18 AS crf,
              54 AS font_size, count(k.idx) AS captions, min(k.start_time) AS first_start
       FROM clips c LEFT JOIN captions k USING (source_id, clip_id)
       GROUP BY c.source_id, c.clip_id""",
)(lambda t: caption_ops.edit_plans(t.clips, t.captions).select(
    "source_id", "clip_name", "composition.canvas.width", "composition.canvas.height",
    F.col("composition.background.blur_radius").alias("blur"),
    F.col("composition.background.brightness").alias("brightness"),
    "render_config.crf", "captions.style.font_size",
    F.size("captions.segments").cast("bigint").alias("captions"),
    F.array_min(F.transform("captions.segments", lambda s: s["start_time"])).alias("first_start"),
))

POSITIONS = "SELECT doc_id, ['left', 'center', 'right'][doc_id % 3 + 1] AS horizontal," \
    " ['top', 'center', 'lower_middle', 'bottom', 'nowhere'][doc_id % 5 + 1] AS vertical" \
    " FROM documents"
over(
    "caption_style_codes",
    f"""SELECT doc_id, horizontal, vertical,
          CAST(CASE vertical WHEN 'top' THEN 6 WHEN 'bottom' THEN 0
                WHEN 'center' THEN 3
                WHEN 'lower_middle' THEN CASE horizontal WHEN 'center' THEN 0 ELSE 3 END
              END + CASE horizontal WHEN 'left' THEN 1 WHEN 'center' THEN 2 ELSE 3 END AS INTEGER)
            AS alignment,
          CASE WHEN vertical IN ('top', 'bottom', 'lower_middle') THEN 500 ELSE 0 END AS margin
        FROM ({POSITIONS})""",
)(lambda t: fx.table(t.spark, t.sf_dir, "documents").selectExpr(
    "doc_id",
    "array('left', 'center', 'right')[doc_id % 3] AS horizontal",
    "array('top', 'center', 'lower_middle', 'bottom', 'nowhere')[doc_id % 5] AS vertical",
).select(
    "doc_id", "horizontal", "vertical",
    caption_ops.alignment_code(F.col("horizontal"), F.col("vertical")).alias("alignment"),
    caption_ops.vertical_margin(F.col("vertical"), F.lit(500)).alias("margin"),
))
over(
    "section_ranges",
    """SELECT c.source_id, c.clip_id, s.source_type, s.location, c.start_ms / 1000 AS start_time,
              c.end_ms / 1000 AS end_time,
              concat('*', c.start_ms / 1000, '-', c.end_ms / 1000) AS section
       FROM clips c JOIN sources s USING (source_id)""",
)(lambda t: catalog.section_ranges(t.clips, t.sources))

# ---- joins ------------------------------------------------------------------------------------

over(
    "evaluations_join_candidates",
    """SELECT e.source_id, e.candidate_id, e.eval_pos, e.score, e.reason, e.suggested_title,
              c.start_ms, c.end_ms FROM evaluations e JOIN candidates c
              USING (source_id, candidate_id)""",
)(lambda t: planning.evaluated_candidates(t.candidates, t.evaluations))
over(
    "candidate_end_pairs",
    "SELECT source_id, start_idx, start_ms, end_idx, end_ms, score_ms FROM end_pairs",
)(lambda t: discovery.candidate_end_pairs(t.segments).drop("has_text", "long_enough"))
over(
    "near_duplicate_pairs",
    f"""SELECT a.source_id, a.start_idx, b.start_idx AS other_start_idx,
          CASE WHEN least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) THEN
            (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))
            / least({cs('a.start_ms', 'a.end_ms')}, {cs('b.start_ms', 'b.end_ms')})
          ELSE 0 END AS overlap
        FROM window_ends a JOIN window_ends b ON a.source_id = b.source_id
          AND a.start_idx < b.start_idx AND a.end_ms IS NOT NULL
          AND b.end_ms IS NOT NULL AND {near_dup('a', 'b', 0.85, 8000)}""",
)(lambda t: discovery.near_duplicate_pairs(t.windows.filter("end_idx IS NOT NULL")))
over(
    "segments_in_clip",
    """SELECT source_id, clip_id, idx, clip_start_ms, clip_end_ms, start_ms, end_ms, text
       FROM clip_segments""",
)(lambda t: caption_ops.segments_in_clips(t.clips, t.segments))
over(
    "clip_transcript",
    """SELECT p.source_id, p.clip_id, p.candidate_id, t.transcript_text,
              CAST(NULL AS VARCHAR) AS error
       FROM clips p LEFT JOIN content t USING (source_id, candidate_id)""",
)(lambda t: response_ops.clip_transcripts(t.clips, t.content))


def _scored(t: Inputs) -> DataFrame:
    """Evaluations that came through parsing."""
    return response_ops.parse_evaluations(fx.responses(t.evaluations)).filter("error IS NULL")


over(
    "missing_evaluations",
    """SELECT source_id, candidate_id FROM candidates
       ANTI JOIN (SELECT * FROM parsed WHERE error IS NULL) USING (source_id, candidate_id)""",
)(lambda t: content_ops.missing_evaluations(t.candidates, _scored(t)))
over(
    "candidate_score_report",
    """SELECT c.source_id, c.candidate_id, round((c.end_ms - c.start_ms) / 1000, 2) AS duration,
              CASE WHEN p.candidate_id IS NULL THEN 'MISSING' ELSE printf('%.1f/10', p.score) END
                AS score,
              CASE WHEN p.candidate_id IS NULL THEN 'No evaluation returned.' ELSE p.reason END
                AS reason, coalesce(p.suggested_title, 'None') AS title
       FROM candidates c LEFT JOIN
         (SELECT source_id, candidate_id, arg_max(score, item_pos) AS score,
                 arg_max(reason, item_pos) AS reason,
                 arg_max(suggested_title, item_pos) AS suggested_title
          FROM parsed WHERE error IS NULL GROUP BY 1, 2) p USING (source_id, candidate_id)""",
)(lambda t: content_ops.score_report(
    t.candidates, _scored(t).withColumnRenamed("item_pos", "eval_pos")))
over(
    "next_natural_start",
    f"""SELECT w.source_id, w.start_idx, min(n.idx) AS next_start_idx
        FROM window_ends w LEFT JOIN starts n ON n.source_id = w.source_id
          AND n.idx > w.start_idx AND n.start_ms >= w.start_ms
            + greatest(25000, 0.5 * {cs('w.start_ms', 'w.end_ms')})
        WHERE w.end_idx IS NOT NULL GROUP BY 1, 2""",
)(lambda t: discovery.next_natural_starts(t.windows))
over(
    "packaging_join_clips",
    """SELECT p.source_id, p.clip_id, json_extract_string(p.raw, '$.thumbnail_text')
                AS thumbnail_text, (c.end_ms - c.start_ms) / 1000 AS duration
       FROM packaged p JOIN clips c USING (source_id, clip_id)
       WHERE (p.source_id + p.clip_id) % 8 IN (3, 7)""",
)(lambda t: providers.read_packaging_responses(fx.packaging_responses(t.clips))
  .filter(F.size("errors") == 0).select("source_id", "clip_id", "thumbnail_text")
  .join(t.clips, ["source_id", "clip_id"])
  .select("source_id", "clip_id", "thumbnail_text",
          timing.seconds(F.col("end_ms") - F.col("start_ms")).alias("duration")))
over(
    "stage_semi_anti",
    """SELECT project_id, 'scored' AS side FROM stages WHERE stage = 'candidates'
         AND project_id IN (SELECT project_id FROM stages WHERE stage = 'evaluations')
       UNION ALL SELECT project_id, 'unscored' FROM stages WHERE stage = 'candidates'
         AND project_id NOT IN (SELECT project_id FROM stages WHERE stage = 'evaluations')""",
)(lambda t: (lambda found, scored: found.join(scored, "project_id", "left_semi").select(
    "project_id", F.lit("scored").alias("side")
).unionByName(found.join(scored, "project_id", "left_anti").select(
    "project_id", F.lit("unscored").alias("side")
)))(t.stages.filter("stage = 'candidates'"), t.stages.filter("stage = 'evaluations'")))

# ---- aggregations -----------------------------------------------------------------------------

over("build_candidate", "SELECT * FROM content")(
    lambda t: content_ops.build_candidates(t.candidates, t.segments))
over(
    "candidate_counts",
    """SELECT s.source_id, count(c.candidate_id) AS total_candidates
       FROM sources s LEFT JOIN candidates c USING (source_id) GROUP BY 1""",
)(lambda t: content_ops.candidate_counts(t.sources, t.candidates))
over("transcript_duration", "SELECT source_id, last_end_ms AS duration_ms FROM extents")(
    lambda t: segment_ops.transcript_duration(t.segments))
over(
    "transcript_headers",
    """SELECT s.source_id, coalesce(e.last_end_ms / 1000, 0) AS duration,
              coalesce(s.language, 'en') AS language
       FROM sources s LEFT JOIN extents e USING (source_id)""",
)(lambda t: docs.transcript_headers(t.sources, t.segments))
over(
    "last_covered_end",
    """SELECT e.source_id, greatest(max(c.end_ms), e.first_start_ms) AS covered_ms
       FROM extents e LEFT JOIN candidates c USING (source_id)
       GROUP BY e.source_id, e.first_start_ms""",
)(lambda t: discovery.covered_ends(
    t.candidates, discovery.source_extents(discovery.segment_index(t.segments))))
over("best_end", "SELECT source_id, start_idx, start_ms, end_idx, end_ms FROM window_ends")(
    lambda t: t.windows.drop("text_idx"))
over("best_end_of_pairs", "SELECT source_id, start_idx, start_ms, end_idx, end_ms FROM best_ends")(
    lambda t: discovery.best_end_of_pairs(
        discovery.candidate_end_pairs(t.segments)).drop("text_idx"))
over(
    "batches",
    """SELECT source_id, (candidate_id - 1) // 40 + 1 AS batch, count(*) AS candidates,
              max(max((candidate_id - 1) // 40 + 1)) OVER (PARTITION BY source_id) AS total_batches
       FROM candidates GROUP BY 1, 2""",
)(lambda t: content_ops.batches(t.candidates))
over(
    "captions_per_clip",
    """SELECT source_id, clip_id, string_agg(concat(CAST(round(start_time * 1000) AS BIGINT), '-',
              CAST(round(end_time * 1000) AS BIGINT), ' ', text), '\n' ORDER BY idx, chunk_idx)
              AS captions FROM captions GROUP BY 1, 2""".replace("'\n'", "chr(10)"),
)(lambda t: caption_ops.captions_per_clip(t.captions).select(
    "source_id", "clip_id",
    F.array_join(F.transform("captions", lambda c: F.concat(
        timing.ms_of(c["start_time"]), F.lit("-"), timing.ms_of(c["end_time"]), F.lit(" "),
        c["text"])), "\n").alias("captions")))

ESCAPED = r"replace(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}')," \
    r" chr(10), '\N')"
TOP = (caption_ops.DOCUMENT_TOP + caption_ops.style_line() + caption_ops.EVENTS_TOP).replace(
    "\n", "' || chr(10) || '")
over(
    "subtitle_document",
    f"""SELECT c.source_id, c.clip_id, '{TOP}' || coalesce(string_agg(
          'Dialogue: 0,' || {ass_time('start_time')} || ',' || {ass_time('end_time')}
          || ',Default,,0,0,0,,' || {ESCAPED} || chr(10), '' ORDER BY idx, chunk_idx), '')
          AS document
        FROM clips c LEFT JOIN captions k USING (source_id, clip_id) GROUP BY 1, 2""",
)(lambda t: caption_ops.subtitle_documents(t.clips, t.captions))
over(
    "subtitle_files",
    f"""SELECT 'project_id=' || o.source_id || '/' || replace(o.file_path, '.mp4', '.ass') AS path,
               sha256(document) AS document_sha256
        FROM outputs o JOIN (
          SELECT c.source_id, c.clip_id, '{TOP}' || coalesce(string_agg(
            'Dialogue: 0,' || {ass_time('start_time')} || ',' || {ass_time('end_time')}
            || ',Default,,0,0,0,,' || {ESCAPED} || chr(10), '' ORDER BY idx, chunk_idx), '')
            AS document
          FROM clips c LEFT JOIN captions k USING (source_id, clip_id) GROUP BY 1, 2)
          USING (source_id, clip_id)""",
)(lambda t: _subtitle_files(t))


def _subtitle_files(t: Inputs) -> DataFrame:
    """Subtitles written as one file per clip and read back."""
    root = t.folder()
    rows = caption_ops.subtitle_documents(t.clips, t.captions).join(
        catalog.document_paths(t.clips), ["source_id", "clip_id"])
    keyed_files.write_files(rows.select(F.col("subtitle_path").alias("path"), "document"), root)
    return keyed_files.read_files(t.spark, root).select(
        "path", F.sha2("document", 256).alias("document_sha256"))


over(
    "returned_ids",
    """SELECT source_id, (response_candidate_id - 1) // 40 + 1 AS batch,
              array_to_string(list_sort(list(DISTINCT candidate_id)), ',') AS ids
       FROM parsed WHERE error IS NULL GROUP BY 1, 2""",
)(lambda t: response_ops.returned_ids(
    _scored(t), (F.floor((F.col("response_candidate_id") - 1) / 40) + 1).cast("bigint"),
).select("source_id", "batch", as_lines(F.col("ids")).alias("ids")))
over(
    "run_summary",
    """SELECT s.source_id, count(o.clip_id) AS clips, coalesce(string_agg(
              concat(o.clip_id, ' | ', o.title, ' | ', o.file_path), chr(10) ORDER BY o.clip_id) FILTER (o.clip_id IS NOT NULL),
              'No clips were selected.') AS summary
       FROM sources s LEFT JOIN outputs o USING (source_id) GROUP BY 1""",
)(lambda t: catalog.run_summary(t.sources, t.clips))

# ---- windows ----------------------------------------------------------------------------------

over(
    "pause_before",
    "SELECT source_id, idx, pause_before_ms / 1000 AS pause_before FROM paused",
)(lambda t: segment_ops.with_pauses(t.segments).select(
    "source_id", "idx", timing.seconds(F.col("pause_before_ms")).alias("pause_before")))
over(
    "pause_after",
    "SELECT source_id, idx, pause_after_ms / 1000 AS pause_after FROM paused",
)(lambda t: segment_ops.with_pauses(t.segments).select(
    "source_id", "idx", timing.seconds(F.col("pause_after_ms")).alias("pause_after")))
over(
    "renumber",
    """SELECT source_id, idx, row_number() OVER (PARTITION BY source_id ORDER BY idx) AS start_id
       FROM starts""",
)(lambda t: segment_ops.number_rows(
    segment_ops.natural_starts(t.segments).select("source_id", "idx"), "idx", "start_id", start=1))
over(
    "caption_timing",
    """SELECT source_id, clip_id, idx, chunk_idx, round(start_time, 6) AS start_time,
              round(end_time, 6) AS end_time, words, text FROM captions""",
)(lambda t: t.captions.withColumn("start_time", F.round("start_time", 6))
  .withColumn("end_time", F.round("end_time", 6)))
over(
    "tail_bounds",
    """SELECT t.source_id, t.start_idx, t.start_ms, max(g.idx) AS end_idx,
              arg_max(g.end_ms, g.idx) AS end_ms
       FROM (SELECT c.source_id, min(g.idx) AS start_idx, arg_min(g.start_ms, g.idx) AS start_ms
             FROM (SELECT e.source_id, greatest(max(c.end_ms), e.first_start_ms) AS covered_ms
                   FROM extents e LEFT JOIN candidates c USING (source_id)
                   GROUP BY e.source_id, e.first_start_ms) c
             JOIN segments g ON g.source_id = c.source_id AND g.start_ms >= c.covered_ms
             GROUP BY 1) t
       JOIN segments g ON g.source_id = t.source_id AND g.idx >= t.start_idx
            AND g.end_ms - t.start_ms <= 90000 GROUP BY 1, 2, 3""",
)(lambda t: discovery.tail_bounds(
    t.segments,
    discovery.covered_ends(
        t.candidates, discovery.source_extents(discovery.segment_index(t.segments))),
    discovery.DEFAULTS.max_ms,
).drop("has_text"))

# ---- folds ------------------------------------------------------------------------------------

over("discover_candidates", "SELECT * FROM candidates")(
    lambda t: discovery.discover_candidates(t.segments))
over("near_dup_suppression", "SELECT * FROM candidates_loose")(
    lambda t: discovery.discover_candidates(
        t.segments, discovery.DiscoveryOptions(overlap_threshold=0.5, boundary_tolerance=20.0)))
over("tail_candidate", "SELECT * FROM candidates WHERE origin = 'tail'")(
    lambda t: t.candidates.filter("origin = 'tail'"))
over("whole_transcript_fallback", "SELECT * FROM candidates WHERE origin = 'whole'")(
    lambda t: t.candidates.filter("origin = 'whole'"))
over("plan_clips", "SELECT * FROM clips")(lambda t: choose_clips(t.candidates))


@query("clips_of_transcripts", "SELECT * FROM clips")
def clips_of_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to clips in one plan, nothing stored on the way."""
    return choose_clips(discovery.discover_candidates(fx.segments(spark, sf_dir)))



over("plan_clips_in_blocks", "SELECT * FROM clips")(
    lambda t: planning.plan_clips(t.candidates, t.evaluations, block=8))
over(
    "chunk_words",
    "SELECT source_id, idx, chunk_idx, text, first_word, words FROM all_chunks",
)(lambda t: caption_ops.caption_chunks(t.segments).select(
    "source_id", "idx", "chunk_idx", "chunk.text",
    F.col("chunk.first_word").cast("bigint").alias("first_word"),
    F.col("chunk.words").cast("bigint").alias("words")))

# ---- sorts, limits, sets ----------------------------------------------------------------------

over("rank_evaluations", "SELECT * FROM evaluations ORDER BY source_id, score DESC, eval_pos")(
    lambda t: planning.rank_evaluations(t.evaluations))
over("max_clips_per_source", "SELECT * FROM clips_few")(lambda t: planning.plan_clips(
    t.candidates, t.evaluations, planning.PlanningOptions(max_clips=3),
    candidates_per_source=40))
over("max_candidates_per_source", "SELECT * FROM candidates_few")(
    lambda t: discovery.discover_candidates(
        t.segments, discovery.DiscoveryOptions(max_candidates=5)))
over(
    "middle_frame",
    "SELECT source_id, clip_id, (end_ms - start_ms) / 1000 * 0.55::DOUBLE AS frame FROM clips",
)(lambda t: t.clips.select("source_id", "clip_id", thumbnails.middle_frame(
    thumbnails.frame_timestamps(timing.seconds(F.col("end_ms") - F.col("start_ms")))
).alias("frame")))
over(
    "except_returned_ids",
    """SELECT source_id, candidate_id FROM candidates
       EXCEPT SELECT source_id, candidate_id FROM parsed WHERE error IS NULL""",
)(lambda t: t.candidates.select("source_id", "candidate_id").exceptAll(
    _scored(t).select("source_id", "candidate_id").distinct().join(
        t.candidates.select("source_id", "candidate_id"), ["source_id", "candidate_id"],
        "left_semi")))
over(
    "except_required_fields",
    """SELECT source_id, clip_id, CASE WHEN NOT json_valid(raw) THEN
              'caption,content_angle,description,hashtags,hook,thumbnail_text,title'
              WHEN (source_id + clip_id) % 8 = 2 THEN 'hook' ELSE '' END AS missing
       FROM packaged""",
)(lambda t: fx.packaging_responses(t.clips).select(
    "source_id", "clip_id",
    F.array_join(response_ops.missing_fields(F.col("raw")), ",").alias("missing")))
over("union_origins", "SELECT source_id, candidate_id, origin, start_ms, end_ms FROM candidates")(
    lambda t: reduce(DataFrame.unionByName, [
        t.candidates.filter(F.col("origin") == origin)
        .select("source_id", "candidate_id", "origin", "start_ms", "end_ms")
        for origin in ("chain", "tail", "whole")]))

over(
    "merged_batches",
    """SELECT source_id, candidate_id, sent, CASE WHEN sent = 2 THEN 10 - score ELSE score END AS score,
              row_number() OVER (PARTITION BY source_id ORDER BY candidate_id) AS eval_pos
       FROM (SELECT *, CASE WHEN candidate_id % 5 = 0 THEN 3 WHEN candidate_id % 2 = 0 THEN 2
                            WHEN candidate_id % 3 <> 0 THEN 1 END AS sent FROM evaluations)
       WHERE sent IS NOT NULL""",
)(lambda t: _merged_batches(t))


def _merged_batches(t: Inputs) -> DataFrame:
    """Deliveries in part, out of order and one of them twice, merged into a stage table."""
    root = t.folder()
    deliveries = {
        1: ("candidate_id % 3 <> 0", "score"), 2: ("candidate_id % 2 = 0", "10 - score"),
        3: ("candidate_id % 5 = 0", "score")}
    for sent in (2, 1, 3, 1):
        which, score = deliveries[sent]
        batches.merge_into_stage(t.spark, root, "evaluations", t.evaluations.filter(which).selectExpr(
            "source_id", "candidate_id", f"CAST({sent} AS BIGINT) AS sent", f"{score} AS score"))
    return batches.numbered(stage_tables.read_stage(t.spark, root, "evaluations"))


# ---- scalars and validation -------------------------------------------------------------------

over(
    "overlap_ratio",
    """SELECT a.source_id, a.candidate_id, CASE WHEN a.end_ms > b.start_ms THEN
              (a.end_ms - b.start_ms) / least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)
              ELSE 0 END AS ratio
       FROM candidates a JOIN candidates b ON a.source_id = b.source_id
            AND b.candidate_id = a.candidate_id + 1""",
)(lambda t: (lambda c: c.alias("a").join(
    c.withColumn("candidate_id", F.col("candidate_id") - 1).alias("b"),
    ["source_id", "candidate_id"],
).select("source_id", "candidate_id", timing.overlap_ratio(
    F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms")
).alias("ratio")))(t.candidates))
over(
    "end_score",
    """SELECT source_id, start_idx, max(score_ms) / 1000 AS best_score FROM end_pairs
       WHERE score_ms IS NOT NULL GROUP BY 1, 2""",
)(lambda t: discovery.candidate_end_pairs(t.segments).filter("score_ms IS NOT NULL").groupBy(
    "source_id", "start_idx").agg(timing.seconds(F.max("score_ms")).alias("best_score")))
over("clip_relative_times", "SELECT * FROM relative")(
    lambda t: caption_ops.clip_relative(caption_ops.segments_in_clips(t.clips, t.segments)))
over(
    "ass_time",
    f"SELECT source_id, idx, {ass_time('start_ms / 1000 - 5')} AS t FROM segments",
)(lambda t: t.segments.select("source_id", "idx", timing.subtitle_time(
    timing.seconds(F.col("start_ms")) - 5).alias("t")))
over("ass_escape", f"SELECT page_id, {ESCAPED.replace('text', 'html')} AS escaped FROM pages")(
    lambda t: fx.table(t.spark, t.sf_dir, "pages").select(
        "page_id", escape_dialogue(F.col("html")).alias("escaped")))
over(
    "frame_timestamps",
    """SELECT source_id, clip_id, CAST(i - 1 AS INTEGER) AS position, (end_ms - start_ms) / 1000
              * [0.1, 0.25, 0.4, 0.55, 0.7, 0.85][i]::DOUBLE AS t
       FROM (SELECT *, unnest(range(1, 7)) AS i FROM clips)""",
)(lambda t: t.clips.select("source_id", "clip_id", F.posexplode(thumbnails.frame_timestamps(
    timing.seconds(F.col("end_ms") - F.col("start_ms")))).alias("position", "t")))

PLANNED = """SELECT p.source_id, p.clip_id, (c.end_ms - c.start_ms) / 1000 * {share}::DOUBLE
       AS frame_timestamp, {text} AS text, 1080 AS width, 88 AS font_size,
       0.42::DOUBLE AS center_y
     FROM packaged p JOIN clips c USING (source_id, clip_id)
     WHERE (p.source_id + p.clip_id) % 8 IN (3, 7)"""


def _thumbnails(t: Inputs, **options: object) -> DataFrame:
    clips = t.clips
    packaged = providers.read_packaging_responses(fx.packaging_responses(clips)).filter(
        F.size("errors") == 0)
    return thumbnails.thumbnail_plans(packaged, clips, **options).select(
        "source_id", "clip_id", "frame_timestamp", "text", "style.width", "style.font_size",
        F.col("composition.visual_center_y").alias("center_y"))


TRIMMED = "trim(json_extract_string(p.raw, '$.thumbnail_text'))"
over("thumbnail_plan", PLANNED.format(share=0.55, text=TRIMMED))(_thumbnails)
over("frame_selector", PLANNED.format(share=0.1, text=TRIMMED))(
    lambda t: _thumbnails(t, select=lambda frames: F.get(frames, F.lit(0))))

CLASSES = """SELECT CASE WHEN m LIKE '%private%' OR m LIKE '%unavailable%' OR m LIKE '%removed%'
                THEN 'unavailable'
              WHEN m LIKE '%network%' OR m LIKE '%unable to download%' THEN 'network'
              ELSE 'other' END AS ingestion_class,
         CASE WHEN m LIKE '%corrupt%' OR m LIKE '%invalid%' THEN 'corrupt' ELSE 'other' END
           AS audio_class,
         CASE WHEN m LIKE '%429%' OR m LIKE '%resource_exhausted%' THEN 'rate_limit'
              WHEN regexp_matches(m, '500|502|503|504|unavailable|timeout|timed out|connection reset|connection error')
                THEN 'transient' ELSE 'fatal' END AS scoring_class,
         regexp_matches(m, '408|429|500|502|503|504|timeout|timed out|temporarily unavailable|service unavailable|connection reset|connection aborted')
           AS retryable,
         regexp_matches(m, '503|502|504|429|408|unavailable|timeout|timed out') AS packaging_retry
       FROM (SELECT lower(message) AS m FROM attempts)"""
over(
    "classify_failures",
    f"""SELECT ingestion_class, audio_class, scoring_class, retryable, packaging_retry,
               count(*) AS failures FROM ({CLASSES}) GROUP BY ALL""",
)(lambda t: response_ops.failure_counts(fx.attempts(t.spark, t.sf_dir)))
over("parse_evaluations", "SELECT * FROM parsed")(
    lambda t: response_ops.parse_evaluations(fx.responses(t.evaluations)))
over(
    "validate_packaging",
    """SELECT source_id, clip_id, CASE c WHEN 0 THEN 'title cannot be empty'
              WHEN 1 THEN 'every hashtag must be a string' WHEN 2 THEN 'missing hook'
              WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'title must be a string'
              WHEN 6 THEN 'hashtags must be a list' ELSE '' END AS errors
       FROM (SELECT *, (source_id + clip_id) % 8 AS c FROM clips)""",
)(lambda t: response_ops.validate_packaging(fx.packaging_responses(t.clips)).select(
    "source_id", "clip_id", F.array_join("errors", "; ").alias("errors")))
over(
    "unpackageable_clips",
    """SELECT p.source_id, p.clip_id, p.candidate_id, CASE WHEN t.source_id IS NULL
              THEN 'candidate not found' ELSE 'candidate has no text' END AS error
       FROM clips p LEFT JOIN
         (SELECT c.source_id, c.candidate_id, CASE WHEN l.toxic = 1 THEN ' '
                   ELSE c.transcript_text END AS transcript_text
          FROM content c JOIN labels l ON l.doc_id = c.source_id) t USING (source_id, candidate_id)
       WHERE coalesce(trim(t.transcript_text), '') = ''""",
)(lambda t: response_ops.unpackageable_clips(t.clips, t.content.join(
    fx.table(t.spark, t.sf_dir, "labels").selectExpr("doc_id AS source_id", "toxic"), "source_id"
).withColumn("transcript_text", F.expr("IF(toxic = 1, ' ', transcript_text)"))))
over(
    "unusable_transcripts",
    """SELECT source_id, CASE WHEN d.doc_id IS NULL THEN 'no segments' ELSE 'no usable text' END
              AS reason
       FROM (SELECT doc_id AS source_id FROM documents UNION SELECT o_custkey FROM orders) s
       LEFT JOIN documents d ON d.doc_id = s.source_id
       WHERE d.doc_id IS NULL OR d.lang = 'fr'""",
)(lambda t: segment_ops.unusable_transcripts(
    fx.table(t.spark, t.sf_dir, "documents").selectExpr("doc_id AS source_id").union(
        fx.table(t.spark, t.sf_dir, "orders").selectExpr("o_custkey")).distinct(),
    fx.muted_segments(t.spark, t.sf_dir)))
over(
    "response_coverage",
    """SELECT source_id, (candidate_id - 1) // 40 + 1 AS batch,
              string_agg(candidate_id, ',' ORDER BY candidate_id) AS missing_ids
       FROM candidates ANTI JOIN (SELECT * FROM parsed WHERE error IS NULL)
            USING (source_id, candidate_id) GROUP BY 1, 2""",
)(lambda t: response_ops.incomplete_batches(t.candidates, _scored(t)))

# ---- stages and incremental runs --------------------------------------------------------------

over(
    "project_status",
    """SELECT *, audio_exists AND transcript_exists AND candidates_exists AS discovery_complete,
              evaluations_exists AS intelligence_complete, clip_plan_exists AS planning_complete
       FROM (SELECT project_id, bool_or(stage = 'audio') AS audio_exists,
                    bool_or(stage = 'transcript') AS transcript_exists,
                    bool_or(stage = 'candidates') AS candidates_exists,
                    bool_or(stage = 'evaluations') AS evaluations_exists,
                    bool_or(stage = 'clip_plan') AS clip_plan_exists
             FROM stages GROUP BY 1)""",
)(lambda t: stage_ops.project_status(t.projects, t.stages))
over(
    "has_any_artifact",
    "SELECT project_id, bool_or(stage <> 'source') AS has_artifacts FROM stages GROUP BY 1",
)(lambda t: stage_ops.has_any_artifact(t.projects, t.stages))
over("stale_stages", "SELECT * FROM stale")(
    lambda t: stage_ops.stale_stages(t.projects, t.stages))
TODO = """SELECT project_id, stage FROM
         (SELECT doc_id AS project_id, stage FROM documents, stage_orders)
       ANTI JOIN (SELECT * FROM stages ANTI JOIN stale USING (project_id, stage))
         USING (project_id, stage)"""
over("needs_work", f"SELECT project_id FROM ({TODO}) WHERE stage = 'clip_plan'")(
    lambda t: stage_ops.needs_work(t.projects, t.stages, "clip_plan"))
over("work_plan", TODO)(lambda t: stage_ops.work_plan(t.projects, t.stages))
over(
    "invalid_packaging",
    """SELECT source_id, clip_id, CASE c WHEN 2 THEN 'missing hook' ELSE 'invalid JSON' END AS error
       FROM (SELECT *, (source_id + clip_id) % 8 AS c FROM clips) WHERE c IN (2, 4)""",
)(lambda t: response_ops.invalid_packaging(fx.packaging_responses(t.clips)))


@query("run_incremental", "SELECT * FROM clips")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts dropped as files, taken in by the stream and carried through to clip plans."""
    t = Inputs(spark, sf_dir)
    root = t.folder()
    t.segments.write.parquet(f"{root}/incoming")
    run_incremental(spark, f"{root}/incoming", f"{root}/tables", fx.evaluations)
    return stage_tables.read_stage(spark, f"{root}/tables", "clip_plan")


@query("intake_versions", """
SELECT source_id, idx, start_ms, 'v' || v || ' ' || text AS text
FROM (
    SELECT *, CASE WHEN m IN (0, 4, 6) OR m = 7 AND n > 2 THEN 1 WHEN m >= 8 THEN 0 ELSE 2 END AS v
    FROM (SELECT *, source_id % 10 AS m, count(*) OVER (PARTITION BY source_id) AS n FROM segments))
WHERE v <> 2 OR idx < greatest(1, n - 1)
""")
def intake_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions old and new, whole and split, early, late, incomplete and falling, in two runs."""
    t = Inputs(spark, sf_dir)
    root = t.folder()
    for run in (1, 2):
        files = fx.transcript_versions(t.segments.drop("has_text"), run)
        files.write.mode("append").parquet(f"{root}/incoming")
        run_incremental(spark, f"{root}/incoming", f"{root}/tables", None)
    return stage_tables.read_stage(spark, f"{root}/tables", "transcript").select(
        "source_id", "idx", "start_ms", "text")


def _scoring() -> providers.Responder:
    def answer(title: str, payload: str) -> str:
        import json

        return json.dumps([
            {"candidate_id": item["candidate_id"], "score": item["candidate_id"] * 13 % 101 / 10,
             "reason": title}
            for item in json.loads(payload)
        ])

    return answer


def _packaging() -> providers.Responder:
    def answer(title: str, payload: str) -> str:
        import json

        request = json.loads(payload)
        return json.dumps({
            "title": title, "hook": f"{request['duration']}", "caption": request["title"],
            "description": "d", "thumbnail_text": "t", "content_angle": "story",
            "hashtags": [str(request["clip_id"])],
        })

    return answer


over(
    "score_candidates",
    """SELECT c.source_id, c.candidate_id AS eval_pos, c.candidate_id,
              CAST(c.candidate_id * 13 % 101 AS DOUBLE) / 10 AS score,
              coalesce(nullif(s.title, ''), 'Unknown') AS reason,
              CAST(NULL AS VARCHAR) AS suggested_title, CAST(NULL AS VARCHAR) AS error
       FROM content c JOIN sources s USING (source_id)""",
)(lambda t: providers.score_candidates(t.content, _scoring(), sources=t.sources))
over(
    "package_clips",
    """SELECT c.source_id, c.clip_id, coalesce(nullif(s.title, ''), s.location) AS title,
              CAST(round((c.end_ms - c.start_ms) / 1000, 2) AS VARCHAR) AS hook,
              coalesce(nullif(c.title, ''), 'None') AS caption,
              CAST(c.clip_id AS VARCHAR) AS hashtags
       FROM clips c JOIN sources s USING (source_id)""",
)(lambda t: providers.package_clips(t.clips, t.content, _packaging(), t.sources).select(
    "source_id", "clip_id", "title", "hook", "caption",
    F.array_join("hashtags", ",").alias("hashtags")))
over(
    "order_violations",
    """SELECT source_id, idx, start_ms, end_ms, text, lag_end AS previous_end_ms FROM (
         SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY idx) AS lag_end
         FROM (SELECT source_id, idx, start_ms, end_ms - CASE WHEN text LIKE '%e.%' THEN 9000
               ELSE 0 END AS end_ms, text FROM segments)) WHERE end_ms < lag_end""",
)(lambda t: segment_ops.order_violations(t.segments.withColumn(
    "end_ms", F.expr("end_ms - IF(text LIKE '%e.%', 9000, 0)")).drop("has_text")))
