"""Flat tables of the engine. Every key starts with the source (or project) it belongs to.

Times are BIGINT milliseconds; ``idx`` is the dense position 0..n-1 of a segment in its source, and
segment ends do not decrease along it (``operators.segments.order_violations`` reports breaches).
"""

from __future__ import annotations

SEGMENT = "idx BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING"
SEGMENTS = f"source_id BIGINT, {SEGMENT}"
# As files bring them: rows of a version of a transcript and how many segments that version has.
VERSIONED_SEGMENTS = f"{SEGMENTS}, version BIGINT, n_segments BIGINT"
CANDIDATES = (
    "source_id BIGINT, candidate_id BIGINT, start_ms BIGINT, end_ms BIGINT, "
    "start_idx BIGINT, end_idx BIGINT"
)
EVALUATIONS = (
    "source_id BIGINT, eval_pos BIGINT, candidate_id BIGINT, score DOUBLE, "
    "reason STRING, suggested_title STRING"
)
CLIPS = (
    "source_id BIGINT, clip_id BIGINT, candidate_id BIGINT, start_ms BIGINT, end_ms BIGINT, "
    "final_score DOUBLE, reason STRING, title STRING"
)
