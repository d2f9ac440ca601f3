"""Chat traffic as a stream: payloads, gates, limits, routes, retrieval, answers and replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulemill.operators import ask, chat
from rulemill.operators.ratelimit import REQUESTS, SECONDS, key_of, limit_stream
from rulemill.operators.retrieval import TOP_K
from rulemill.sources import paths
from rulemill.sources.files import messages
from rulemill.sources.folders import new_folder
from rulemill.sources.store import BUCKETS, KeyedStore
from rulemill.streaming.state import keyed_state

#: What is said to messages that aren't asked on, by reason.
REPLIES = {"text only": "Please ask in text.", "too short": "Please ask in a few more words.", "rate limit": "Too many questions at once, please wait a little."}
CACHE = "query_hash string, query string, normalized_query string, answer string, updated_at timestamp"


def gated(payloads: DataFrame, gate: chat.Gate = chat.Gate(), lateness: str = "10 minutes") -> DataFrame:
    """Decided messages of a stream of payloads; a message that comes twice within the
    watermark counts once."""
    rows = messages(payloads).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])
    return chat.decide_phone(rows, gate)


def limited(decided: DataFrame, max_requests: int = REQUESTS, window_seconds: float = SECONDS) -> DataFrame:
    """key, id, ts, allowed, decision, reason, query, chat_id of the messages that get a reply.
    Only what is to be asked counts for the limit, and becomes a reply where it is over it."""
    told = decided.where("decision != 'drop'").withColumn("key", key_of(F.col("sender"))).withColumn("asks", F.col("decision") == "ask")
    out = limit_stream(told, "key", "ts", "id", max_requests, window_seconds, "asks", ("decision", "reason", "query", "chat_id"))
    over = F.col("allowed").isNotNull() & ~F.coalesce("allowed", F.lit(True))
    return out.withColumns({"decision": F.when(over, "reply").otherwise(F.col("decision")), "reason": F.when(over, "rate limit").otherwise(F.col("reason"))})


def answer_cache(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedStore:
    """The cache of a stream: a row a key in buckets, to which each batch adds a segment. Answers from before
    the stream have epoch -1."""
    return KeyedStore(spark, folder, CACHE, "query_hash", ("updated_at",), buckets)


def _kept(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The rows from files, which are written once. A task that reads them knows nothing of how they were made; one
    that reads cached rows of a stream sends the driver some 20 KB of counts of all steps before."""
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def answered(rows: DataFrame, epoch: int, cache: str, chunks: DataFrame, encode_fn: Callable, reply_to: Callable[[Column], Column] | None = None, k: int = TOP_K, channel: str = "phone", replies: dict[str, str] = REPLIES, buckets: int = BUCKETS, work: str | None = None) -> DataFrame:
    """A batch of `limited` rows -> id, chat_id, decision, reason, route, answer, prompt, reply.

    Questions are routed against the cache as the batches before left it, and retrieved; `reply_to`
    makes an answer of a prompt (without it, prompted questions have none). Later questions of
    a batch with the key of an earlier one get its answer. New answers, also that nothing was
    found, go to the cache as this batch's; a batch that runs again reads and writes the same. Of the
    cache only the buckets of asked keys are read, in at most as many segments as it keeps. Questions
    are searched for and answered once; what came of it is in `work`, a folder that all executors share, as long as the result is read.
    """
    store = answer_cache(rows.sparkSession, cache, buckets)
    log = rows.where("decision = 'ask'").select(F.col("id").alias("query_id"), "ts", "query", F.lit(True).alias("use_cache"), ask.query_hash(F.col("query")).alias("query_hash"))
    routes = ask.route(log.drop("query_hash"), store.read(log, before=epoch), chunks, k, encode_fn)
    own = routes.withColumn("answer", F.coalesce("answer", reply_to(F.col("prompt")) if reply_to else F.lit(None).cast("string"))).join(log.select("query_id", "ts", "query", "query_hash").hint("merge"), "query_id")
    own = _kept(rows.sparkSession, own, work or new_folder(rows.sparkSession, "answers"))
    fresh = own.where("route IN ('prompted', 'uncovered') AND answer IS NOT NULL").groupBy("query_hash").agg(F.min_by(F.struct("query", ask.cache_key(F.col("query")).alias("normalized_query"), "answer", F.col("ts").alias("updated_at")), F.struct("ts", "query_id")).alias("r"))
    fresh = fresh.select("query_hash", "r.*")
    store.append(fresh, epoch)
    new = fresh.select("query_hash", F.col("answer").alias("own_answer"))
    told = own.join(new, "query_hash", "left").select(F.col("query_id").alias("id"), "route", F.when(F.col("route") == "cached", F.coalesce("answer", "own_answer")).otherwise(F.col("answer")).alias("answer"), "prompt")
    # Joined by a shuffle: by the size of its compressed file, text might be taken for small and sent through the driver.
    out = rows.select("id", "chat_id", "decision", "reason").join(told.hint("merge"), "id", "left").withColumn("sources", F.expr("cast(null as array<string>)"))
    said = F.coalesce(*[F.when(F.col("reason") == reason, F.lit(text)) for reason, text in replies.items()])
    return chat.format_reply(out, channel).withColumn("reply", F.when(F.col("decision") == "reply", said).otherwise(F.col("reply"))).drop("sources")


def answer_batches(messages: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], cache: str, chunks: DataFrame, encode_fn: Callable, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query that answers every batch of `limited` messages and hands the rows of
    `answered` to the sink, which reads them while it runs. It ends when it is stopped, or as `trigger` (arguments of the writer's)
    says; started again it goes on where it was."""
    spark = messages.sparkSession

    def batch(rows: DataFrame, epoch: int) -> None:
        folder = new_folder(spark, "batch")
        try:
            # A stream's own session deals all rows to as many tasks as its state has parts; what isn't a stream any more
            # needs but a few.
            rows = _kept(spark, rows, f"{folder}/rows")
            sink(answered(rows, epoch, cache, chunks, encode_fn, **options, work=f"{folder}/own"), epoch)
        finally:
            paths.remove(spark, folder)

    with keyed_state(spark):
        writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
