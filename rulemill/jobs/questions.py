"""Jobs over question logs: guard, cache, retrieval and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.operators import ask, retrieval
from rulemill.sources.tables import read

#: User turns as a log: some name an edition, some repeat with other case and spaces.
_QUERY = """CASE WHEN conv_id % 5 = 0 THEN text || ' in 9th Edition' WHEN conv_id % 7 = 0 THEN 'the OLD  edition rules of ' || text WHEN conv_id % 3 = 0 THEN '  Question ' || conv_id % 40 || CASE WHEN turn % 4 = 0 THEN ' ' ELSE '' END
WHEN conv_id % 11 = 0 THEN ' ' || chr(10) ELSE text END"""
_LOG = ("conv_id * 1000 + turn AS query_id", "timestamp_seconds(turn * 60 + conv_id) AS ts", f"{_QUERY} AS query", "conv_id % 13 != 0 AS use_cache", "conv_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(*_LOG)


def _cache(spark: SparkSession) -> DataFrame:
    """A cache of forty fixed questions, as a service would have; every fifth is empty."""
    return spark.range(0, 40, 3).select(F.sha2(F.concat(F.lit("question "), "id"), 256).alias("query_hash"), F.concat(F.lit("Question "), "id").alias("query"), F.concat(F.lit("question "), "id").alias("normalized_query"), F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("answer "), "id")).alias("answer"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))


def question_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return _log(spark, sf_dir).select("query_id", ask.is_valid(q).alias("valid"), ask.is_legacy(q).alias("legacy"), ask.cache_key(q).alias("cache_key"), ask.query_hash(q).alias("query_hash"))


def ask_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.routed(_log(spark, sf_dir), _cache(spark)).select("query_id", "route", "cached_answer")


def cache_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after every answered question of the log put its answer."""
    log = ask.routed(_log(spark, sf_dir), _cache(spark)).where("route = 'retrieve' AND use_cache")
    answers = log.select("query_hash", "query", ask.cache_key(F.col("query")).alias("normalized_query"), F.concat(F.lit("answer to "), ask.cache_key(F.col("query"))).alias("answer"), F.col("ts").alias("updated_at"))
    return ask.put(_cache(spark), answers).select("query_hash", "normalized_query", "answer")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _vectors(spark, sf_dir)
    queries = chunks.where("id % 50 = 0").withColumnRenamed("id", "query_id")  # the stated query set, against all vectors
    return retrieval.top_k(queries, chunks, exclude_self=True)


def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "id", F.bround("distance", 5).alias("distance"), "rank")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the chunks of vectors of the same number."""
    docs = read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "text", "doc_id % 30 AS page", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'SECTION' END AS section_hint", "CASE WHEN doc_id % 8 = 0 THEN 'PARENT' END AS parent_section", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source", "CASE WHEN doc_id % 5 = 0 THEN '01.0' || doc_id % 9 END AS rule_number", "CASE WHEN doc_id % 6 = 0 THEN ' a diagram ' END AS figure_description"
    )
    return _vectors(spark, sf_dir).join(docs, "id", "left")


def retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = retrieval.format_context(retrieval.project_hits(_hits(spark, sf_dir), _chunks(spark, sf_dir)))
    return ask.build_prompts(context.select("query_id", F.concat(F.lit("question "), "query_id").alias("query")), context).select("query_id", "prompt")


def response_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = retrieval.response_context(retrieval.project_hits(_hits(spark, sf_dir), _chunks(spark, sf_dir)))
    return shown.select("query_id", F.explode("context_chunks").alias("c")).select("query_id", "c.*")


def ask_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a log: guard, cache, retrieval, prompt."""
    log = _log(spark, sf_dir).join(_vectors(spark, sf_dir), F.col("conv_id") == F.col("id"), "left").drop("id")
    return ask.route(log, _cache(spark), _chunks(spark, sf_dir)).select("query_id", "route", "answer", F.sha2("prompt", 256).alias("prompt_sha256"))


QUERIES = [question_guard, ask_routes, cache_after_log, cosine_top_k, retrieval_contexts, response_contexts, ask_log]

_LOG_SQL = r"""
log AS (
  SELECT conv_id * 1000 + turn AS query_id, turn * 60 + conv_id AS ts, conv_id % 13 != 0 AS use_cache,
         CASE WHEN conv_id % 5 = 0 THEN text || ' in 9th Edition' WHEN conv_id % 7 = 0 THEN 'the OLD  edition rules of ' || text WHEN conv_id % 3 = 0 THEN '  Question ' || conv_id % 40 || CASE WHEN turn % 4 = 0 THEN ' ' ELSE '' END
              WHEN conv_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS query
  FROM conversations WHERE role = 'user'),
checked AS (
  SELECT *, length(query) BETWEEN 3 AND 4000 AND length(regexp_replace(query, '^\s+|\s+$', '', 'g')) > 0 AS valid,
         regexp_matches(query, '$legacy') AS legacy,
         lower(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS cache_key FROM log),
hashed AS (SELECT *, sha256(cache_key) AS query_hash FROM checked)""".replace("$legacy", ask.LEGACY.replace("(?Ui)", "(?i)"))
_ROUTE_SQL = f"""{_LOG_SQL},
cache AS (SELECT sha256('question ' || id) AS query_hash, 'question ' || id AS normalized_query, CASE WHEN id % 5 = 0 THEN '' ELSE 'answer ' || id END AS answer FROM range(0, 40, 3) t(id)),
fills AS (SELECT *, valid AND NOT legacy AND use_cache AS fills FROM hashed),
placed AS (SELECT f.*, nullif(c.answer, '') AS known, row_number() OVER (PARTITION BY f.query_hash, f.fills ORDER BY ts, query_id) AS n FROM fills f LEFT JOIN cache c USING (query_hash)),
routes AS (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN legacy THEN 'refused' WHEN fills AND (known IS NOT NULL OR n > 1) THEN 'cached' ELSE 'retrieve' END AS route FROM placed)"""
#: From pairs (query_id, id, distance) to the best eight and what is told of them.
_TOLD_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= 8),
told AS (
  SELECT query_id, rank, coalesce(text, '') AS text, doc_id % 30 AS page, coalesce(CASE WHEN doc_id % 4 != 0 THEN 'SECTION' END, CASE WHEN doc_id % 8 = 0 THEN 'PARENT' END) AS section_hint, CASE WHEN doc_id % 3 != 0 THEN source END AS source,
         CASE WHEN doc_id % 5 = 0 THEN '01.0' || doc_id % 9 END AS rule_number, CASE WHEN doc_id % 6 = 0 THEN 'a diagram' END AS figure
  FROM hits LEFT JOIN documents ON id = doc_id)"""
_HITS_SQL = f"""
vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT q.id AS query_id, c.id, round(list_cosine_distance(q.v, c.v), 9) AS distance FROM vectors q JOIN vectors c ON q.id % 50 = 0 AND q.id != c.id),
{_TOLD_SQL}"""
_SHOWN_SQL = r"""
shown AS (
  SELECT query_id, rank, '### Context ' || rank || ' (' || coalesce(nullif(concat_ws(' | ', coalesce('Rule ' || rule_number, section_hint), 'page ' || page, source), ''), 'chunk ' || rank) || ')' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || coalesce(chr(10) || chr(10) || '**Diagram on this page:** ' || figure, '') AS block FROM told)"""
#: A prompt of a query and the blocks of its context.
_PROMPT_SQL = "'Use ONLY the rules below to answer the player''s question.' || chr(10) || chr(10) || '## Rules context' || chr(10) || {context} || chr(10) || chr(10) || '## Player question' || chr(10) || {query} || chr(10) || chr(10) || 'Give a complete ruling with citations. Walk through steps when timing or sequencing matters.' || chr(10) || 'If the context is insufficient, say so explicitly.'"
ORACLES = {
    "ask_log": f"""WITH {_ROUTE_SQL},
vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT DISTINCT query_id // 1000 AS conv FROM routes WHERE route = 'retrieve'),
pairs AS (SELECT q.id AS query_id, c.id, round(list_cosine_distance(q.v, c.v), 9) AS distance FROM asked JOIN vectors q ON q.id = conv CROSS JOIN vectors c),
{_TOLD_SQL},
{_SHOWN_SQL},
contexts AS (SELECT query_id AS conv, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM shown GROUP BY query_id),
final AS (SELECT r.*, context, CASE WHEN route != 'retrieve' THEN route WHEN context IS NULL THEN 'uncovered' ELSE 'prompted' END AS done FROM routes r LEFT JOIN contexts ON conv = query_id // 1000)
SELECT query_id, done AS route, CASE done WHEN 'refused' THEN 'Only the current edition of the rules is in scope.' WHEN 'uncovered' THEN 'The provided rules do not cover this specific interaction. No relevant rule text was retrieved from the index.' WHEN 'cached' THEN known END AS answer,
       CASE WHEN done = 'prompted' THEN sha256({_PROMPT_SQL.format(context="context", query="query")}) END AS prompt_sha256 FROM final""",
    "question_guard": f"WITH {_LOG_SQL} SELECT query_id, valid, legacy, cache_key, query_hash FROM hashed",
    "ask_routes": f"WITH {_ROUTE_SQL} SELECT query_id, route, CASE WHEN route = 'cached' THEN known END AS cached_answer FROM routes",
    "cache_after_log": f"""WITH {_ROUTE_SQL}, answers AS (SELECT DISTINCT query_hash, cache_key FROM routes WHERE route = 'retrieve' AND use_cache)
SELECT query_hash, cache_key AS normalized_query, 'answer to ' || cache_key AS answer FROM answers UNION ALL SELECT query_hash, normalized_query, answer FROM cache WHERE query_hash NOT IN (SELECT query_hash FROM answers)""",
    "cosine_top_k": f"WITH {_HITS_SQL} SELECT query_id, id, round_even(distance, 5) AS distance, rank FROM hits",
    "retrieval_contexts": f"""WITH {_HITS_SQL}, {_SHOWN_SQL}
SELECT query_id, {_PROMPT_SQL.format(context="string_agg(block, chr(10) || chr(10) ORDER BY rank)", query="'question ' || query_id")} AS prompt FROM shown GROUP BY query_id""",
    "response_contexts": f"""WITH {_HITS_SQL}, flat AS (SELECT *, translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM told)
SELECT query_id, rank, page, section_hint, rule_number, source, figure IS NOT NULL AS has_figure, CASE WHEN length(t) > 180 THEN left(t, 177) || '...' ELSE t END AS preview FROM flat""",
}
