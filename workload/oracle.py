"""The same inputs and results as DuckDB SQL, written apart from the Spark plans.

``CTES`` holds named subqueries; ``sql`` puts a query together with the ones it uses.
"""

from __future__ import annotations

import re

from sparkreel.functions.text import WHITESPACE

WS = "|| ".join(
    ["'" + "".join(c for c in WHITESPACE if c.isprintable()) + "' "]
    + [f"chr({ord(c)}) " for c in WHITESPACE if not c.isprintable()]
)
WINDOW = "STRUCT(start_idx BIGINT, start_ms BIGINT, end_idx BIGINT, end_ms BIGINT)"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def cs(start: str, end: str) -> str:
    """Length in ms, rounded to hundredths of a second."""
    return f"CAST(round(({end} - {start}) / 10.0) * 10 AS BIGINT)"


def near_dup(a: str, b: str, overlap: float, tolerance: int) -> str:
    shared = f"(least({a}.end_ms, {b}.end_ms) - greatest({a}.start_ms, {b}.start_ms))"
    shorter = f"least({cs(f'{a}.start_ms', f'{a}.end_ms')}, {cs(f'{b}.start_ms', f'{b}.end_ms')})"
    return (
        f"(({shared} > 0 AND {shorter} > 0 AND {shared} >= {overlap} * {shorter}) OR"
        f" (abs({a}.start_ms - {b}.start_ms) <= {tolerance}"
        f" AND abs({a}.end_ms - {b}.end_ms) <= {tolerance}))"
    )


def discovery(
    suffix: str = "", *, source: str = "segments", cap: int = 40, overlap: float = 0.85,
    tolerance: int = 8000,
) -> dict[str, str]:
    """Chain, tail and whole-transcript windows; window lengths and pauses are the defaults."""
    s = suffix
    dup = near_dup("x", "v", overlap, tolerance).replace("v.", "w.")
    dup_tail = near_dup("x", "t", overlap, tolerance)
    return {
        f"walk{s}": f"""
          SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS DOUBLE) AS next_ms,
                 false AS stopped, CAST([] AS {WINDOW}[]) AS kept FROM visits
          UNION ALL
          SELECT k.source_id, w.rn,
                 CASE WHEN k.stopped OR len(k.kept) >= {cap} OR w.start_ms < k.next_ms
                        OR w.end_ms IS NULL THEN k.next_ms
                      ELSE w.start_ms + greatest(25000, 0.5 * {cs('w.start_ms', 'w.end_ms')}) END,
                 k.stopped OR (len(k.kept) < {cap} AND w.start_ms >= k.next_ms
                               AND w.end_ms IS NULL),
                 CASE WHEN k.stopped OR len(k.kept) >= {cap} OR w.start_ms < k.next_ms
                        OR w.end_ms IS NULL
                        OR len(list_filter(k.kept, lambda x: {dup})) > 0 THEN k.kept
                      ELSE list_append(k.kept, CAST(struct_pack(start_idx := w.start_idx,
                             start_ms := w.start_ms, end_idx := w.end_idx, end_ms := w.end_ms)
                             AS {WINDOW})) END
          FROM walk{s} k JOIN visits w ON w.source_id = k.source_id AND w.rn = k.rn + 1""",
        f"chains{s}": f"""
          SELECT e.*, coalesce(k.kept, CAST([] AS {WINDOW}[])) AS kept,
                 greatest(e.first_start_ms,
                   coalesce(list_max(list_transform(k.kept, lambda x: x.end_ms)),
                            e.first_start_ms)) AS covered_ms
          FROM extents e LEFT JOIN
            (SELECT source_id, arg_max(kept, rn) AS kept FROM walk{s} GROUP BY 1) k
            USING (source_id)""",
        f"tail_starts{s}": f"""
          SELECT c.source_id, min(g.idx) AS start_idx,
                 arg_min(g.start_ms, g.idx) AS start_ms
          FROM chains{s} c JOIN segments g ON g.source_id = c.source_id
               AND g.start_ms >= c.covered_ms
          WHERE len(c.kept) < {cap} AND c.last_end_ms - c.covered_ms >= 45000 GROUP BY 1""",
        f"tails{s}": f"""
          SELECT t.source_id, t.start_idx, t.start_ms, max(g.idx) AS end_idx,
                 arg_max(g.end_ms, g.idx) AS end_ms
          FROM tail_starts{s} t JOIN segments g ON g.source_id = t.source_id
               AND g.idx >= t.start_idx AND g.end_ms - t.start_ms <= 90000
          GROUP BY 1, 2, 3 HAVING bool_or({strip('g.text')} <> '')""",
        f"windows{s}": f"""
          SELECT c.source_id, len(c.kept) AS n, c.has_text, c.first_start_ms, c.last_idx,
                 c.last_end_ms, c.kept, t.start_idx IS NOT NULL
                   AND c.last_end_ms - t.start_ms >= 30000
                   AND len(list_filter(c.kept, lambda x: {dup_tail})) = 0 AS with_tail,
                 t.start_idx, t.start_ms, t.end_idx, t.end_ms
          FROM chains{s} c LEFT JOIN tails{s} t USING (source_id)""",
        f"candidates{s}": f"""
          SELECT source_id, CAST(i AS BIGINT) AS candidate_id, kept[i].start_ms AS start_ms,
                 kept[i].end_ms AS end_ms, kept[i].start_idx AS start_idx,
                 kept[i].end_idx AS end_idx, 'chain' AS origin
          FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM windows{s})
          UNION ALL
          SELECT source_id, n + 1, start_ms, end_ms, start_idx, end_idx, 'tail'
          FROM windows{s} WHERE with_tail
          UNION ALL
          SELECT source_id, 1, first_start_ms, last_end_ms, 0, last_idx, 'whole'
          FROM windows{s} WHERE n = 0 AND NOT with_tail AND has_text""",
    }


def planning(suffix: str = "", *, max_clips: int = 10) -> dict[str, str]:
    s = suffix
    shared = "(least(x.end_ms, r.end_ms) - greatest(x.start_ms, r.start_ms))"
    shorter = "least(x.end_ms - x.start_ms, r.end_ms - r.start_ms)"
    clash = f"{shared} > 0 AND {shared} >= 0.5 * {shorter}"
    return {
        "ranked": """
          SELECT v.*, c.start_ms, c.end_ms,
                 row_number() OVER (PARTITION BY source_id ORDER BY score DESC, eval_pos) AS rn
          FROM evaluations v JOIN candidates c USING (source_id, candidate_id)
          WHERE score >= 7 AND c.end_ms - c.start_ms BETWEEN 15000 AND 180000""",
        f"pick{s}": f"""
          SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS rn,
                 CAST([] AS STRUCT(rn BIGINT, start_ms BIGINT, end_ms BIGINT)[]) AS kept
          FROM ranked
          UNION ALL
          SELECT p.source_id, r.rn,
                 CASE WHEN len(p.kept) >= {max_clips}
                        OR len(list_filter(p.kept, lambda x: {clash})) > 0 THEN p.kept
                      ELSE list_append(p.kept,
                             struct_pack(rn := r.rn, start_ms := r.start_ms, end_ms := r.end_ms))
                 END
          FROM pick{s} p JOIN ranked r ON r.source_id = p.source_id AND r.rn = p.rn + 1""",
        f"clips{s}": f"""
          SELECT r.source_id, CAST(k.i AS BIGINT) AS clip_id, r.candidate_id, r.start_ms, r.end_ms,
                 r.score AS final_score, r.reason, r.suggested_title AS title
          FROM (SELECT source_id, unnest(range(1, len(kept) + 1)) AS i,
                       unnest(kept) AS item
                FROM (SELECT source_id, arg_max(kept, rn) AS kept FROM pick{s} GROUP BY 1)) k
          JOIN ranked r ON r.source_id = k.source_id AND r.rn = k.item.rn""",
    }


def chunking(rows: str, name: str) -> dict[str, str]:
    """Caption chunks of ``rows(source_id, clip_id, idx, text, ...)``, one step per chunk."""
    return {
        f"{name}_words": f"""
          SELECT source_id, clip_id, idx, string_split({strip('text')}, ' ') AS w FROM {rows}
          WHERE {strip('text')} <> ''""",
        f"{name}_steps": f"""
          SELECT source_id, clip_id, idx, w, CAST(-1 AS BIGINT) AS chunk_idx,
                 CAST(0 AS BIGINT) AS first_word, CAST(0 AS BIGINT) AS words
          FROM {name}_words
          UNION ALL
          SELECT source_id, clip_id, idx, w, chunk_idx + 1, first_word + words,
                 CAST(list_max(list_filter(range(1, 7), lambda k: k = 1 OR (
                   first_word + words + k <= len(w) AND
                   length(array_to_string(w[first_word + words + 1 : first_word + words + k], ' '))
                     <= 32))) AS BIGINT)
          FROM {name}_steps WHERE first_word + words < len(w)""",
        name: f"""
          SELECT source_id, clip_id, idx, chunk_idx, first_word, words, len(w) AS total_words,
                 array_to_string(w[first_word + 1 : first_word + words], ' ') AS text
          FROM {name}_steps WHERE chunk_idx >= 0""",
    }


def ass_time(seconds: str) -> str:
    total = f"CAST(round_even(greatest({seconds}, 0) * 100, 0) AS BIGINT)"
    return (
        f"printf('%d:%02d:%02d.%02d', {total} // 360000, {total} // 6000 % 60,"
        f" {total} // 100 % 60, {total} % 100)"
    )


def safe_name(title: str) -> str:
    masked = f"""regexp_replace({strip(title)}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')"""
    return f"coalesce(nullif(substr(trim({masked}, ' ._-'), 1, 80), ''), 'untitled')"


CTES: dict[str, str] = {
    "doc_words": r"""
      SELECT doc_id AS source_id,
             string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') AS w
      FROM documents""",
    "seg_words": """
      SELECT source_id, i AS idx, w[10 * i + 1 : 10 * i + 10] AS ws
      FROM (SELECT source_id, w, unnest(range((len(w) + 9) // 10)) AS i FROM doc_words)""",
    "seg_lengths": """
      SELECT *, CASE WHEN source_id % 11 = 0 AND idx % 9 = 8 THEN 100000
                     ELSE 350 * len(ws) END AS dur_ms,
             CASE WHEN idx = 0 THEN 0 WHEN source_id % 13 = 0 THEN 150
                  ELSE (source_id * 7 + idx * 13) % 10 * 150 END AS pause_ms
      FROM seg_words""",
    "segments": """
      SELECT source_id, idx,
             CAST(sum(dur_ms + pause_ms) OVER along - dur_ms AS BIGINT) AS start_ms,
             CAST(sum(dur_ms + pause_ms) OVER along AS BIGINT) AS end_ms,
             array_to_string(ws, ' ') AS text
      FROM seg_lengths WINDOW along AS (PARTITION BY source_id ORDER BY idx)""",
    "paused": f"""
      SELECT *, coalesce(greatest(0, start_ms - lag(end_ms) OVER along), 999000)
               AS pause_before_ms,
             lead(start_ms) OVER along - end_ms AS pause_after_ms,
             sum(CASE WHEN {strip('text')} <> '' THEN 1 ELSE 0 END) OVER along AS texts
      FROM segments WINDOW along AS (PARTITION BY source_id ORDER BY idx)""",
    "starts": "SELECT * FROM paused WHERE idx = 0 OR pause_before_ms >= 800",
    "end_pairs": """
      SELECT s.source_id, s.idx AS start_idx, s.start_ms, e.idx AS end_idx, e.end_ms,
             e.texts - s.texts + CASE WHEN trim(s.text) <> '' THEN 1 ELSE 0 END AS texts,
             CASE WHEN e.pause_after_ms IS NULL
                    THEN -abs(e.end_ms - s.start_ms - 55000)
                  WHEN e.pause_after_ms >= 800
                    THEN 3 * least(e.pause_after_ms, 3000) - abs(e.end_ms - s.start_ms - 55000)
             END AS score_ms
      FROM starts s JOIN paused e ON e.source_id = s.source_id AND e.idx >= s.idx
           AND e.end_ms - s.start_ms BETWEEN 30000 AND 90000""",
    "best_ends": """
      SELECT source_id, start_idx, start_ms,
             first(end_idx ORDER BY score_ms DESC NULLS LAST,
                   CASE WHEN score_ms IS NULL THEN -end_idx ELSE end_idx END) AS end_idx,
             first(end_ms ORDER BY score_ms DESC NULLS LAST,
                   CASE WHEN score_ms IS NULL THEN -end_idx ELSE end_idx END) AS end_ms,
             first(texts ORDER BY score_ms DESC NULLS LAST,
                   CASE WHEN score_ms IS NULL THEN -end_idx ELSE end_idx END) AS texts
      FROM end_pairs GROUP BY ALL""",
    "window_ends": """
      SELECT s.source_id, s.idx AS start_idx, s.start_ms, b.end_idx, b.end_ms, b.texts
      FROM starts s LEFT JOIN best_ends b
           ON b.source_id = s.source_id AND b.start_idx = s.idx""",
    "visits": """
      SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_idx) AS rn
      FROM window_ends WHERE end_idx IS NULL OR texts > 0""",
    "extents": f"""
      SELECT source_id, arg_min(start_ms, idx) AS first_start_ms, max(idx) AS last_idx,
             arg_max(end_ms, idx) AS last_end_ms, bool_or({strip('text')} <> '') AS has_text
      FROM segments GROUP BY 1""",
    **discovery(),
    **discovery("_loose", overlap=0.5, tolerance=20000),
    **discovery("_few", cap=5),
    "content": f"""
      SELECT * FROM (
        SELECT c.source_id, c.candidate_id, c.start_ms, c.end_ms, c.start_idx, c.end_idx,
               {strip("string_agg(g.text, ' ' ORDER BY g.idx)")} AS transcript_text
        FROM candidates c JOIN segments g ON g.source_id = c.source_id
             AND g.idx BETWEEN c.start_idx AND c.end_idx GROUP BY ALL)
      WHERE transcript_text <> ''""",
    "evaluations": """
      SELECT source_id, candidate_id AS eval_pos, candidate_id,
             CAST((source_id * 7 + candidate_id * 13) % 101 AS DOUBLE) / 10 AS score,
             '' AS reason,
             CASE candidate_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
                  ELSE concat('Clip: ', candidate_id, '?') END AS suggested_title
      FROM candidates""",
    **planning(),
    **planning("_few", max_clips=3),
    "clip_segments": """
      SELECT c.source_id, c.clip_id, g.idx, c.start_ms AS clip_start_ms, c.end_ms AS clip_end_ms,
             g.start_ms, g.end_ms, g.text
      FROM clips c JOIN segments g ON g.source_id = c.source_id
           AND g.end_ms > c.start_ms AND g.start_ms < c.end_ms""",
    "relative": f"""
      SELECT source_id, clip_id, idx, greatest(start_ms, clip_start_ms) - clip_start_ms AS start_ms,
             least(end_ms, clip_end_ms) - clip_start_ms AS end_ms, {strip('text')} AS text
      FROM clip_segments WHERE {strip('text')} <> ''
        AND least(end_ms, clip_end_ms) > greatest(start_ms, clip_start_ms)""",
    **chunking("relative", "clip_chunks"),
    "plain_rows": "SELECT *, CAST(0 AS BIGINT) AS clip_id FROM segments",
    **chunking("plain_rows", "all_chunks"),
    "captions": """
      SELECT k.source_id, k.clip_id, k.idx, k.chunk_idx,
             r.start_ms / 1000 + (r.end_ms / 1000 - r.start_ms / 1000) * k.first_word
               / k.total_words AS start_time,
             r.start_ms / 1000 + (r.end_ms / 1000 - r.start_ms / 1000)
               * (k.first_word + k.words) / k.total_words AS end_time,
             k.text, k.words
      FROM clip_chunks k JOIN relative r USING (source_id, clip_id, idx)""",
    "sources": """
      SELECT doc_id AS source_id, 'local' AS source_type,
             concat('/videos/', doc_id, '.mp4') AS location,
             CASE WHEN lang = 'en' THEN concat('Talk ', source) WHEN lang = 'fr' THEN '' END
               AS title, lang AS language,
             concat('local_', doc_id, '_',
                    substr(sha256(concat('/videos/', doc_id, '.mp4')), 1, 16)) AS project_id
      FROM documents""",
    "located": """
      SELECT page_id, CASE page_id % 6
               WHEN 0 THEN 'https://www.youtube.com/watch?v=' || vid
               WHEN 1 THEN 'https://youtu.be/' || vid || '?si=x'
               WHEN 2 THEN 'https://m.youtube.com/shorts/' || vid
               WHEN 3 THEN 'HTTPS://YouTube.com/live/' || vid
               WHEN 4 THEN 'https://www.youtube.com/playlist?list=' || vid
               ELSE url END AS location
      FROM (SELECT *, 'vid_' || lpad(CAST(page_id // 6 AS VARCHAR), 6, '0') AS vid FROM pages)""",
    "hosted": r"""
      SELECT *, lower(regexp_replace(regexp_extract(location,
               '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ':.*$', '')) AS host,
             regexp_extract(location, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS url_path,
             regexp_extract(location, '[?&]v=([^&#]+)', 1) AS v,
             regexp_replace(regexp_replace(location, '/+', '/', 'g'), '/$', '') AS file
      FROM located""",
    "video_ids": r"""
      SELECT *, host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be',
                         'www.youtu.be') AS is_site,
             nullif(regexp_extract(CASE
               WHEN host IN ('youtu.be', 'www.youtu.be')
                 THEN string_split(trim(url_path, '/'), '/')[1]
               WHEN host NOT IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') THEN ''
               WHEN v <> '' THEN v
               ELSE regexp_extract(url_path, '^/+(?:shorts|embed|live)/+([^/]+)', 1) END,
               '^[A-Za-z0-9_-]{6,100}$', 0), '') AS video_id
      FROM hosted""",
    "identified": r"""
      SELECT page_id, location, CASE WHEN is_site THEN 'youtube' ELSE 'local' END AS source_type,
             video_id,
             CASE WHEN video_id IS NOT NULL THEN 'youtube_' || video_id
                  WHEN is_site THEN 'youtube_' || substr(sha256(trim(location)), 1, 16)
                  ELSE 'local_' || coalesce(nullif(right(trim(regexp_replace(regexp_replace(
                       regexp_extract(file, '[^/]*$', 0), '^(.+)\.[^.]+$', '\1'),
                       '[^\pL\pN_-]+', '_', 'g'), '_'), 40), ''), 'local_file')
                       || '_' || substr(sha256(lower(file)), 1, 16) END AS project_id,
             CASE WHEN video_id IS NOT NULL THEN 'youtube:' || video_id
                  WHEN is_site THEN 'youtube_url:' || trim(location)
                  ELSE 'local:' || lower(file) END AS identity
      FROM video_ids""",
    "outputs": f"""
      SELECT source_id, clip_id, coalesce(nullif(title, ''), concat('Clip ', clip_id)) AS title,
             printf('clips/clip_%02d_', clip_id)
               || {safe_name("coalesce(nullif(title, ''), concat('Clip ', clip_id))")}
               || '.mp4' AS file_path,
             printf('renders/clip_%02d.mp4', clip_id) AS base_render_path,
             printf('packaging/clip_%02d.json', clip_id) AS packaging_path,
             printf('source/section_%02d.mp4', clip_id) AS section_path
      FROM clips""",
    "responses": """
      SELECT source_id, candidate_id, CASE candidate_id % 8
               WHEN 0 THEN '[' || item WHEN 1 THEN item
               WHEN 2 THEN '[{"candidate_id":2,"score":11}]'
               WHEN 3 THEN '[{"score":5.5}]'
               WHEN 4 THEN '[' || quoted || ',' || item || ']'
               WHEN 5 THEN '[]' ELSE '[' || item || ']' END AS raw
      FROM (SELECT *, '{"candidate_id":' || candidate_id || ',"score":' || score
              || ',"reason":"r' || candidate_id || '","suggested_title":null}' AS item,
            '{"candidate_id":"' || candidate_id || '","score":"' || score || '"}' AS quoted
            FROM evaluations)""",
    "response_items": """
      SELECT source_id, candidate_id AS response_candidate_id, raw, json_valid(raw) AS valid,
             CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind,
             CASE WHEN json_valid(raw) AND json_type(raw) = 'ARRAY'
                  THEN from_json(raw, '["JSON"]') ELSE [] END AS items
      FROM responses""",
    "item_errors": """
      SELECT *, list_filter(list_transform(items, lambda x: CASE
               WHEN json_type(x) <> 'OBJECT' THEN 'item is not an object'
               WHEN try_cast(x ->> 'candidate_id' AS BIGINT) IS NULL THEN 'bad candidate_id'
               WHEN try_cast(x ->> 'score' AS DOUBLE) IS NULL THEN 'bad score'
               WHEN try_cast(x ->> 'score' AS DOUBLE) NOT BETWEEN 0 AND 10
                 THEN 'score out of range' END), lambda e: e IS NOT NULL) AS wrong
      FROM response_items""",
    "parsed": """
      SELECT source_id, response_candidate_id, error, item_pos, candidate_id, score,
             CASE WHEN error IS NULL THEN coalesce(reason, '') END AS reason, suggested_title
      FROM (
        SELECT source_id, response_candidate_id, NULL AS error, CAST(i - 1 AS INTEGER) AS item_pos,
               CAST(items[i] ->> 'candidate_id' AS BIGINT) AS candidate_id,
               CAST(items[i] ->> 'score' AS DOUBLE) AS score, items[i] ->> 'reason' AS reason,
               items[i] ->> 'suggested_title' AS suggested_title
        FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM item_errors
              WHERE valid AND kind = 'ARRAY' AND len(wrong) = 0)
        UNION ALL
        SELECT source_id, response_candidate_id,
               CASE WHEN NOT valid THEN 'invalid JSON' WHEN kind <> 'ARRAY' THEN 'not an array'
                    ELSE wrong[1] END, NULL, NULL, NULL, NULL, NULL
        FROM item_errors WHERE NOT valid OR kind <> 'ARRAY' OR len(wrong) > 0)""",
    "packaged": """
      SELECT source_id, clip_id,
             concat('{"clip_id":', clip_id, ',"title":', CASE c WHEN 0 THEN '"  "' WHEN 5 THEN '12'
               ELSE concat('"Title ', clip_id, '"') END,
               CASE WHEN c = 2 THEN '' ELSE ',"hook":"Look"' END,
               ',"caption":"C","description":"D","thumbnail_text":" Part ', clip_id,
               ' ","content_angle":"story","hashtags":', CASE c WHEN 1 THEN '["a",3]'
               WHEN 3 THEN '[]' WHEN 6 THEN '"a"' ELSE '["a","b"]' END,
               CASE WHEN c = 4 THEN '' ELSE '}' END) AS raw
      FROM (SELECT *, (source_id + clip_id) % 8 AS c FROM clips)""",
    "attempts": """
      SELECT event_id, concat(['HTTP 429 RESOURCE_EXHAUSTED', '503 UNAVAILABLE',
               'Request timed out', 'Video is private', 'File is corrupt',
               'Unable to download webpage', 'Connection reset by peer', 'Network unreachable',
               'Unknown problem'][event_id % 9 + 1], ' during ', event_type) AS message
      FROM events""",
    "stages": """
      SELECT doc_id AS project_id, 'source' AS stage FROM documents
      UNION ALL SELECT doc_id, 'audio' FROM documents WHERE lang <> 'es'
      UNION ALL SELECT doc_id, 'transcript' FROM documents WHERE lang <> 'de'
      UNION ALL SELECT doc_id, 'candidates' FROM documents WHERE n_chars >= 400
      UNION ALL SELECT doc_id, 'evaluations' FROM labels
      UNION ALL SELECT doc_id, 'clip_plan' FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 'captions' FROM labels WHERE toxic = 0
      UNION ALL SELECT doc_id, 'packaging' FROM documents JOIN pages ON page_id = doc_id""",
    "stage_orders": """
      SELECT * FROM (VALUES ('transcript', 1), ('candidates', 2), ('evaluations', 3),
        ('clip_plan', 4), ('captions', 5), ('thumbnails', 5), ('packaging', 5)) o(stage, place)""",
    "first_missing": """
      SELECT project_id, min(place) AS place
      FROM (SELECT doc_id AS project_id, stage, place FROM documents, stage_orders WHERE place <= 4)
      ANTI JOIN stages USING (project_id, stage) GROUP BY 1""",
    "stale": """
      SELECT s.project_id, s.stage FROM stages s JOIN stage_orders o USING (stage)
      JOIN first_missing m ON m.project_id = s.project_id AND o.place > m.place""",
}


def _used(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", re.sub("'[^']*'", "", text)))
    return [name for name in CTES if name in words]


def sql(query: str) -> str:
    """A query preceded by every subquery it needs, each after the ones it builds on."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _used(CTES[name]):
            if other != name and other not in order:
                add(other)
        if name not in order:
            order.append(name)

    for name in _used(query):
        add(name)
    if not order:
        return query
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    return f"WITH RECURSIVE {parts}\n{query}"
