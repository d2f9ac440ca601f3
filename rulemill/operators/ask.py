"""Questions: validation, the edition guard, the answer cache, routing and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions.text import present, strip
from rulemill.operators.ingest import embed
from rulemill.operators.retrieval import TOP_K, format_context, project_hits, top_k

SHORTEST, LONGEST = 3, 4000
# How a question names an edition or rules that no longer hold.
LEGACY = (
    r"(?Ui)\b(?:(?:9th|10th|8th|7th|6th|5th|4th|3rd|2nd|1st)\s+edition"
    r"|(?:ninth|tenth|eighth|seventh|sixth|fifth|fourth|third|second|first)\s+edition"
    r"|edition\s+(?:9|10|8|7|6|5|4|3|2|1)\b"
    r"|(?:old|previous|legacy|superseded|outdated|prior)\s+(?:edition\s+)?rules\b"
    r"|rules\s+from\s+(?:9th|10th|8th|7th)\b"
    r"|(?:9th|10th|8th)\s+ed\b)"
)
REFUSAL = "Only the current edition of the rules is in scope."
# Fixed value: the answer where nothing was found.
NOT_COVERED = "The provided rules do not cover this specific interaction. No relevant rule text was retrieved from the index."
# The parts of a prompt.
PROMPT = ("Use ONLY the rules below to answer the player's question.\n\n## Rules context\n", "\n\n## Player question\n", "\n\nGive a complete ruling with citations. Walk through steps when timing or sequencing matters.\nIf the context is insufficient, say so explicitly.")


def is_valid(query: Column) -> Column:
    return F.coalesce(F.length(query).between(SHORTEST, LONGEST) & (F.length(strip(query)) > 0), F.lit(False))


def is_legacy(query: Column) -> Column:
    return F.coalesce(query.rlike(LEGACY), F.lit(False))


def cache_key(query: Column) -> Column:
    return F.lower(strip(query))


def query_hash(query: Column) -> Column:
    return F.sha2(cache_key(query), 256)


def lookup(log: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds cached_answer to a log with query_hash: null where the cache has none or an empty
    one. The log's distinct keys are joined, so that a popular question is one row."""
    known = log.select("query_hash").distinct().join(cache.select("query_hash", present(F.col("answer")).alias("cached_answer")), "query_hash").where("cached_answer IS NOT NULL")
    return log.join(known, "query_hash", "left")


def put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache after answers (query_hash, query, normalized_query, answer, updated_at): the
    latest per key replaces the whole row."""
    names = [c for c in cache.columns if c != "query_hash"]
    latest = answers.groupBy("query_hash").agg(F.max_by(F.struct(*names), "updated_at").alias("r")).select("query_hash", "r.*")
    return cache.join(latest.select("query_hash"), "query_hash", "left_anti").unionByName(latest.select(*cache.columns))


def routed(log: DataFrame, cache: DataFrame) -> DataFrame:
    """log (query_id, ts, query, use_cache) -> adds query_hash, route and cached_answer.

    In order: invalid; refused (before any cache); cached, if the cache or an earlier request
    of the log has the key; else retrieve. Requests without use_cache neither read nor fill
    the cache.
    """
    df = lookup(log.withColumn("query_hash", query_hash(F.col("query"))), cache)
    asks = is_valid(F.col("query")) & ~is_legacy(F.col("query"))
    fills = asks & F.coalesce("use_cache", F.lit(True))
    # The first request that fills a key is told apart by its place alone: a plain minimum.
    first = df.where(fills).groupBy("query_hash").agg(F.min(F.struct("ts", "query_id")).alias("first"))
    df = df.join(first, "query_hash", "left")
    seen = F.col("cached_answer").isNotNull() | (F.struct("ts", "query_id") > F.col("first"))
    route = F.when(~is_valid(F.col("query")), "invalid").when(is_legacy(F.col("query")), "refused").when(fills & F.coalesce(seen, F.lit(False)), "cached").otherwise("retrieve")
    return df.withColumn("route", route).withColumn("cached_answer", F.when(F.col("route") == "cached", F.col("cached_answer"))).drop("first")


def build_prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """Adds prompt to queries that have a context."""
    return queries.join(context, "query_id").withColumn("prompt", F.concat(F.lit(PROMPT[0]), "context", F.lit(PROMPT[1]), "query", F.lit(PROMPT[2])))


def route(log: DataFrame, cache: DataFrame, chunks: DataFrame, k: int = TOP_K, encode_fn: Callable | None = None) -> DataFrame:
    """A whole log (query_id, ts, query, use_cache, embedding) against cache and chunks ->
    query_id, route (invalid, refused, cached, uncovered or prompted), answer, prompt. Only
    what is to be retrieved is searched for and, with `encode_fn` in place of a column
    embedding, encoded. The model's answer is left to the caller."""
    df = routed(log, cache)
    asked = df.where("route = 'retrieve'")
    asked = embed(asked.select("query_id", "query"), encode_fn, "query") if encode_fn else asked
    hits = project_hits(top_k(asked.select("query_id", "embedding"), chunks, k), chunks)
    prompts = build_prompts(df.select("query_id", "query"), format_context(hits)).select("query_id", "prompt")
    out = df.join(prompts, "query_id", "left")
    final = F.when(F.col("route") != "retrieve", F.col("route")).when(F.col("prompt").isNull(), "uncovered").otherwise("prompted")
    answer = F.when(F.col("route") == "refused", F.lit(REFUSAL)).when(final == "uncovered", F.lit(NOT_COVERED)).otherwise(F.col("cached_answer"))
    return out.select("query_id", final.alias("route"), answer.alias("answer"), F.when(final == "prompted", F.col("prompt")).alias("prompt"))

