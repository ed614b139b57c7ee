"""The corpus operators as queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.llm.conversation_repair import repair_report
from sparkreel.llm.decontamination import find_contamination
from sparkreel.llm.exact_dedup import exact_dedup
from sparkreel.llm.extraction import extract_pages
from sparkreel.llm.hard_negatives import mine_hard_negatives
from sparkreel.llm.jaccard_join import jaccard_components
from sparkreel.llm.language import fit_languages, identify_languages
from sparkreel.llm.line_dedup import line_dedup
from sparkreel.llm.packing import pack_documents
from sparkreel.llm.simhash import simhash_components
from sparkreel.llm.storage import table
from sparkreel.llm.substring_dedup import digest, substring_dedup
from sparkreel.llm.token_counts import count_tokens
from sparkreel.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY)).drop("text")


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo a number: which rows a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learnt from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder(5) != 0)
    return fit_toxicity(docs, labels)


# Repeated runs are diagonals: lines that match one earlier document line after line.
@query("op2_line_dedup", r"""
WITH whole AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM whole),
matches AS (
    SELECT a.doc_id, a.pos, b.doc_id AS other, a.pos - b.pos AS shift, length(a.line) AS chars
    FROM lines a JOIN lines b ON a.line = b.line
         AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
runs AS (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS run
    FROM matches),
gone AS (
    SELECT DISTINCT doc_id, pos FROM (
        SELECT *, sum(chars) OVER (PARTITION BY doc_id, other, shift, run) AS held FROM runs)
    WHERE held >= 40)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), ''))
           AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")


@query("op4_exact_dedup", r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).drop("text")


@query("op5_decontamination", r"""
WITH item_words AS (
    SELECT item_id, text, string_split(trim(regexp_replace(
        lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
doc_words AS (
    SELECT doc_id, string_split(trim(regexp_replace(
        lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
items AS (
    SELECT DISTINCT item_id, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT *, least(len(w), 5) AS n FROM item_words WHERE w <> ['']))),
docs AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc_words, (SELECT DISTINCT least(len(w), 5) AS n FROM item_words WHERE w <> ['']))),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (
    SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (s)
    GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_item
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_extraction")
def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=2048)


@query("op8_substring_dedup", r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i AS start, array_to_string(w[i : i + 19], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split)),
repeated AS (
    SELECT doc_id, start FROM (
        SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS n FROM windows)
    WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
marked AS (
    SELECT w.*, max(r.start) OVER (
        PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hit
    FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id AND r.start = w.p),
kept AS (
    SELECT doc_id, count(*) AS n_words, count(hit) AS n_removed,
           string_agg(word, ' ' ORDER BY p) FILTER (WHERE hit IS NULL) AS words
    FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(substring_dedup(table(spark, sf_dir, "documents"), window=20))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(remainder(4) != 2))
    return identify_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


@query("op10_jaccard_join", r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^ \t-\r]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM split
          WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
reached AS (
    SELECT a AS doc_id, b FROM links
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT doc_id, min(b) AS low FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
""")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


# SQL has no XXH64 with a seed; the tests hold this query against a plain version.
@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), size=3)


# crc32 bit by bit; the costs and least audits run from the last turn to the first, over the states
# (nothing read, after s, after u, after a), and a second walk spells the repaired turns.
@query("op12_conversation_repair", r"""
WITH RECURSIVE
coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
               AS key
    FROM conversations),
crc AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295, flatten(list_transform(
            range(0, strlen(key)), lambda i: list_transform(
                range(0, 8), lambda b: (ascii(key[i + 1]) >> b) & 1)))),
        lambda acc, bit: xor(acc >> 1, CASE WHEN (acc & 1) <> bit THEN 3988292384 ELSE 0 END)),
        4294967295) % 20 AS code
    FROM coded),
damaged AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                ELSE text END AS text,
           unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM crc WHERE code <> 0),
placed AS (
    SELECT *, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        left(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 32), copy) AS n
    FROM damaged),
faulty AS (
    SELECT *, NOT regexp_matches(text, '[^ \t-\r]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
           NOT regexp_matches(text, '[.!?][ \t-\r]*\z') AS unended,
           left(role, 1) AS initial,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
    FROM placed),
turns AS (
    SELECT conv_id, turn, n, role, text, initial, blank, again AND NOT blank AS duplicate,
           unended AND NOT blank AND NOT again AS truncated, blank OR again AS gone,
           coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM faulty),
counts AS (
    SELECT conv_id, count(*) AS rows,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated,
           count(*) FILTER (WHERE illegal) AS illegal
    FROM turns GROUP BY conv_id),
-- best[s] is the least (cost, audit) from state s = 0 (nothing), 1 (s), 2 (u), 3 (a) on.
walk AS (
    SELECT conv_id, rows + 1 AS n, [
        {'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS best
    FROM counts
    UNION ALL
    SELECT e.conv_id, e.n, list_transform([1, 2, 3, 4], lambda s: list_min([
        e.own[s],
        {'c': 3 + e.own[[3, 3, 4, 3][s]].c, 'a': 'I' || e.own[[3, 3, 4, 3][s]].a},
        {'c': 6 + e.own[[4, 4, 3, 4][s]].c, 'a': 'II' || e.own[[4, 4, 3, 4][s]].a}]))
    FROM (
        SELECT t.conv_id, t.n, list_transform([1, 2, 3, 4], lambda s: list_min([
            {'c': 4 + w.best[s].c, 'a': 'D' || w.best[s].a},
            CASE WHEN NOT t.gone THEN {
                'c': 3 + (CASE WHEN t.truncated THEN 3 ELSE 0 END) + w.best[[3, 3, 4, 3][s]].c,
                'a': 'R' || w.best[[3, 3, 4, 3][s]].a} END,
            CASE WHEN NOT t.gone AND t.initial = ['u', 'u', 'a', 'u'][s] THEN {
                'c': (CASE WHEN t.truncated THEN 3 ELSE 0 END) + w.best[[3, 3, 4, 3][s]].c,
                'a': 'K' || w.best[[3, 3, 4, 3][s]].a} END,
            CASE WHEN NOT t.gone AND t.initial = 's' AND s = 1 THEN {
                'c': (CASE WHEN t.truncated THEN 3 ELSE 0 END) + w.best[2].c,
                'a': 'K' || w.best[2].a} END])) AS own
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n - 1) e),
cheapest AS (SELECT conv_id, best[1].c AS cost, best[1].a AS audit FROM walk WHERE n = 1),
spelled AS (
    SELECT conv_id, audit, 1 AS k, 1 AS n, 0 AS state, [] :: VARCHAR[] AS lines FROM cheapest
    UNION ALL
    SELECT s.conv_id, s.audit, s.k + 1, CASE WHEN s.edit = 'I' THEN s.n ELSE s.n + 1 END,
           CASE WHEN s.edit = 'D' THEN s.state
                WHEN s.edit = 'K' AND t.initial = 's' THEN 1
                WHEN s.state = 2 THEN 3 ELSE 2 END,
           CASE s.edit WHEN 'D' THEN s.lines
                WHEN 'K' THEN list_append(s.lines, t.role || ':' || t.text)
                WHEN 'R' THEN list_append(s.lines, s.next || ':' || t.text)
                ELSE list_append(s.lines, s.next || ':') END
    FROM (SELECT *, audit[k] AS edit,
                 CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END AS next
          FROM spelled WHERE k <= length(audit)) s
    LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n = s.n),
repaired AS (
    SELECT conv_id, array_to_string(lines, chr(10)) AS whole FROM spelled
    WHERE k = length(audit) + 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN cheapest b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@query("op13_hard_negatives", """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, n.id AS negative_id, positive_score, n.score AS negative_score,
       CAST(row_number() OVER (
           PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
FROM positives JOIN scores n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))
