"""Audits over rulebooks made of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.operators import audit
from rulemill.sources.tables import rule_chunks

_TOPICS = {"cover": ["03.02", "99.01"], "movement": ["01.01", "01.02"], "nothing": ["98.01"]}


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def audit_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(audit.structure(rule_chunks(spark, sf_dir)))


def audit_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_chapter(rule_chunks(spark, sf_dir))


def audit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gaps(rule_chunks(spark, sf_dir)).select("doc_id", "chapter", F.explode(F.col("missing").cast("array<long>")).alias("missing"))


def audit_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(audit.expected(rule_chunks(spark, sf_dir), "24", 1, 38))


def audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(audit.lengths(rule_chunks(spark, sf_dir)))


def audit_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_titles(rule_chunks(spark, sf_dir))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(rule_chunks(spark, sf_dir))


def audit_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.readiness(rule_chunks(spark, sf_dir))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stratified_sample(rule_chunks(spark, sf_dir), 3)


def audit_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.extras_sample(rule_chunks(spark, sf_dir))


def audit_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(audit.marker_table(rule_chunks(spark, sf_dir)))


def audit_swallowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(audit.swallowed(rule_chunks(spark, sf_dir)).drop("listed"))


def audit_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.wrapped_titles(rule_chunks(spark, sf_dir))


def audit_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.footer_noise(rule_chunks(spark, sf_dir))


def audit_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spot_checks(spark, rule_chunks(spark, sf_dir), _TOPICS).select("doc_id", "topic", F.array_join("found", ",").alias("found"), "ok")


QUERIES = [audit_structure, audit_chapters, audit_gaps, audit_expected, audit_lengths, audit_titles, audit_findings, audit_readiness, audit_sample, audit_extras, audit_markers, audit_swallowed, audit_wrapped, audit_footers, audit_topics]

_SQL = r"""
WITH docs AS (SELECT doc_id // 256 AS doc_id, doc_id % 256 AS r, text AS body FROM documents),
named AS (
  SELECT *, lpad((r % 24 + 1)::VARCHAR, 2, '0') AS chapter, lpad((r // 24 + 1 + CASE WHEN r // 24 > 5 THEN 2 ELSE 0 END)::VARCHAR, 2, '0') AS minor,
         CASE WHEN r % 50 = 3 THEN 'AND ' WHEN r % 40 = 1 THEN 'BATTLE-SHOCK ' WHEN r % 40 = 2 THEN 'CHARGE ' ELSE 'RULE ' END || translate((r - r % 2)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || 'X' AS title,
         CASE WHEN r % 7 = 0 THEN 'keyword' ELSE 'core_rule' END AS chunk_type, r // 4 + 1 AS page FROM docs),
chunks AS (
  SELECT *, chapter || '.' || minor AS rule_number, title || ' ' || chapter || '.' || minor || chr(10) || body
         || CASE WHEN r % 11 = 0 THEN chr(10) || 'Frame 1.2' ELSE '' END || CASE WHEN r % 13 = 0 THEN ' STRATAGEM 1CP WHEN: now TARGET: one' ELSE '' END
         || CASE WHEN r % 17 = 0 THEN ' EFFECT: some ELIGIBLE IF: all' ELSE '' END || CASE WHEN r % 19 = 0 THEN chr(10) || 'OTHER RULE 09.09 more' ELSE '' END
         || CASE WHEN r % 23 = 0 THEN chr(10) || '42' ELSE '' END AS text FROM named)"""
_MARKS = " + ".join(f"contains(text, '{m}')::INT" for m in ("1CP", "2CP", "EFFECT:", "RESTRICTIONS:", "TARGET:", "WHEN:"))
_ACTS = " + ".join(f"contains(text, '{m}')::INT" for m in ("AFTER MOVING:", "BEFORE MOVING:", "EFFECT:", "ELIGIBLE IF:", "MAXIMUM DISTANCE:"))
ORACLES = {
    "audit_structure": f"""{_SQL} SELECT doc_id, count(*) AS chunks, arg_min(rule_number || ' ' || title, rule_number) AS first_rule, arg_max(rule_number || ' ' || title, rule_number) AS last_rule, min(length(text)) AS length_min, (sum(length(text)) // count(*))::BIGINT AS length_avg, max(length(text)) AS length_max,
       count(*) FILTER (chunk_type = 'keyword') AS keywords, count(*) FILTER (chunk_type = 'core_rule') AS core_rules, count(*) FILTER (length(text) < 120) AS short, count(*) FILTER (length(text) > 3000) AS long FROM chunks GROUP BY doc_id""",
    "audit_chapters": f"{_SQL} SELECT doc_id, chapter, count(*) AS chunks FROM chunks GROUP BY doc_id, chapter",
    "audit_gaps": f"""{_SQL}, spans AS (SELECT doc_id, chapter, min(minor::INT) AS lo, max(minor::INT) AS hi, list(minor::INT) AS has FROM chunks GROUP BY doc_id, chapter)
SELECT doc_id, chapter, missing FROM (SELECT doc_id, chapter, has, unnest(generate_series(lo, hi)) AS missing FROM spans) WHERE NOT list_contains(has, missing::INT)""",
    "audit_expected": f"""{_SQL} SELECT d.doc_id, m AS minor FROM (SELECT DISTINCT doc_id FROM chunks) d, generate_series(1, 38) t(m) WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = d.doc_id AND chapter = '24' AND minor::INT = m)""",
    "audit_lengths": f"{_SQL} SELECT doc_id, rule_number, title, length(text) AS length, CASE WHEN length(text) < 120 THEN 'short' ELSE 'long' END AS kind FROM chunks WHERE length(text) < 120 OR length(text) > 3000",
    "audit_titles": f"{_SQL} SELECT doc_id, title, count(*) AS chunks FROM chunks GROUP BY doc_id, title HAVING count(*) > 1",
    "audit_findings": f"""{_SQL} SELECT doc_id, rule_number, title, page, 'warn' AS severity, CASE WHEN regexp_matches(text, 'Frame \\d+\\.\\d+') THEN 'flowchart_frame_ref' WHEN contains(text, '►') THEN 'flowchart_marker' WHEN regexp_matches(text, '(?m)^\\s*/\\s*$') THEN 'index_slash_stub' WHEN contains(text, 'SELECT TARGETS') THEN 'shooting_flowchart' WHEN contains(text, 'IDENTICAL ATTACKS') THEN 'attack_flowchart' WHEN regexp_matches(text, '(?m)^\\d+\\s*$') THEN 'bare_page_number' END AS message FROM chunks WHERE message IS NOT NULL""",
    "audit_readiness": f"""{_SQL} SELECT doc_id, count(*) FILTER (chapter = '15' OR contains(upper(text), 'STRATAGEM')) AS stratagems, count(*) FILTER ((chapter = '15' OR contains(upper(text), 'STRATAGEM')) AND {_MARKS} >= 3) AS stratagems_well_formed,
       count(*) FILTER ({_ACTS} >= 1) AS actions, count(*) FILTER ({_ACTS} >= 2) AS actions_well_formed, count(*) FILTER (chunk_type = 'keyword') AS keywords, count(*) FILTER (contains(title, 'BATTLE') AND contains(title, 'SHOCK')) AS battle_shock, count(*) FILTER (contains(title, 'CHARGE') OR chapter = '11') AS charge FROM chunks GROUP BY doc_id""",
    "audit_sample": f"""{_SQL}, ranked AS (SELECT doc_id, chapter, rule_number, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY doc_id, chapter) AS size FROM chunks WINDOW w AS (PARTITION BY doc_id, chapter ORDER BY rule_number))
SELECT doc_id, chapter, rule_number FROM ranked WHERE size <= 3 OR (place % greatest(1, size // 3) = 0 AND place // greatest(1, size // 3) < 3)""",
    "audit_extras": f"""{_SQL} SELECT doc_id, rule_number, title, CASE WHEN length(text) > 350 THEN left(translate(text, chr(10), ' '), 349) || '…' ELSE translate(text, chr(10), ' ') END AS preview FROM chunks WHERE chapter = '15' OR chunk_type = 'keyword' OR length(text) > 3000""",
    "audit_markers": f"""{_SQL} SELECT doc_id, rule_number, title, page, length(text) AS length, ({_MARKS} - contains(text, 'RESTRICTIONS:')::INT)::BIGINT AS markers, contains(text, 'STRATAGEM') AS has_word FROM chunks WHERE chapter = '15'""",
    "audit_swallowed": f"""{_SQL}, inner_headers AS (SELECT *, len(list_filter(regexp_extract_all(text, '(?:\\[[A-Z0-9 \\-/'']+\\]|[A-Z][A-Z0-9 \\-/'']{{2,100}})\\s+\\d{{2}}\\.\\d{{2}}\\b'), lambda h: NOT ends_with(h, rule_number))) AS headers FROM chunks)
SELECT doc_id, rule_number, headers, 0::BIGINT AS faq_blocks, false AS app_pointer FROM inner_headers WHERE headers > 0""",
    "audit_wrapped": f"{_SQL} SELECT doc_id, rule_number, title FROM chunks WHERE starts_with(title, 'AND ')",
    "audit_footers": f"""{_SQL} SELECT doc_id, rule_number, page, regexp_extract(trim(text, E' \\n\\t'), '[^\\n]*$') AS footer FROM chunks WHERE regexp_full_match(regexp_extract(trim(text, E' \\n\\t'), '[^\\n]*$'), '\\d{{1,3}}')""",
    "audit_topics": f"""{_SQL}, topics(topic, rule_number) AS (VALUES ('cover', '03.02'), ('cover', '99.01'), ('movement', '01.01'), ('movement', '01.02'), ('nothing', '98.01'))
SELECT d.doc_id, t.topic, coalesce(string_agg(DISTINCT c.rule_number, ',' ORDER BY c.rule_number), '') AS found, count(c.rule_number) > 0 AS ok FROM (SELECT DISTINCT doc_id FROM chunks) d CROSS JOIN topics t LEFT JOIN chunks c ON c.doc_id = d.doc_id AND c.rule_number = t.rule_number GROUP BY d.doc_id, t.topic""",
}
