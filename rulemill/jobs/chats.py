"""Jobs over chat traffic: gates, limits and replies."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.jobs.questions import _PROMPT_SQL
from rulemill.operators import ask, chat, ingest, ratelimit
from rulemill.sources.files import messages
from rulemill.sources.folders import new_folder
from rulemill.sources.rowlog import read_log
from rulemill.sources.tables import read
from rulemill.streaming import chat as stream
from rulemill.streaming.state import keyed_state

_GATE = chat.Gate(allow_direct=False, allowed_groups="g1@g.us,g2@g.us", allowed_guilds="1, 2", allowed_channels="0,1,2,3,4,5", bot_id=7)
#: Turns as webhook payloads of one message each.
_PAYLOAD = """to_json(named_struct('messages', array(named_struct('id', conv_id || '-' || turn, 'from_me', conv_id % 17 = 0, 'type', CASE WHEN conv_id % 19 = 0 THEN 'image' ELSE 'text' END,
'chat_id', CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'g1@g.us' WHEN 2 THEN 'g9@g.us' ELSE 'user' || conv_id END, 'timestamp', turn * 60 + conv_id,
'text', named_struct('body', CASE WHEN conv_id % 38 = 0 THEN '' WHEN turn % 3 = 0 THEN '@RulesBot ' || text WHEN turn % 7 = 0 THEN ' @rulesbot  ab' ELSE text END), 'from', 'user/' || conv_id % 20)),
'event', named_struct('type', CASE WHEN turn % 9 = 8 THEN 'statuses' ELSE 'messages' END))) AS payload"""


def phone_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(read(spark, sf_dir, "conversations").selectExpr(_PAYLOAD))
    return chat.decide_phone(rows, _GATE).select("id", "decision", "reason", "query", ratelimit.key_of(F.col("sender")).alias("key"))


_SERVER = ("conv_id", "turn", "conv_id % 30 AS author_id", "conv_id % 23 = 0 AS author_is_bot", "CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 4 END AS guild_id", "conv_id % 8 AS channel_id", "CASE WHEN turn % 3 = 0 THEN array(7L) ELSE array(8L) END AS raw_mentions", "CASE WHEN turn % 4 = 1 THEN '<@!7> ' || text WHEN turn % 4 = 2 THEN '@rulesbot <@9>  x' ELSE text END AS content")


def server_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").selectExpr(*_SERVER)
    return chat.decide_server(rows, _GATE).select("conv_id", "turn", "decision", "reason", "query")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id", "'## Ruling' || chr(10) || '**Yes**, it is. ' || text || ' ' AS answer", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE array(source, 'core', source, '') END AS sources")


def phone_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_reply(_answers(spark, sf_dir), "phone").select("doc_id", "reply")


def server_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_reply(_answers(spark, sf_dir), "server").select("doc_id", "reply")


#: The events' users ask some times a day, so a limit of three in five days.
_MOST, _SECONDS = 3, 5 * 86_400


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ratelimit.limit(events, "key", "ts", _MOST, _SECONDS, order="event_id").select("key", "event_id", "allowed")


#: Batches in which the streams get their rows, and how late a row may come.
_BATCHES, _LATE = 5, "1 day"


def _drained(query, stop_after: int | None) -> None:
    """Stops a query once it has had all that its source has, or some batches, in the midst of its work."""
    if stop_after is None:
        query.processAllAvailable()
    while stop_after is not None and query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < stop_after):
        time.sleep(0.1)
    query.stop()


def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the streaming operator. The events come in several batches, each up to a day later
    than it happened, so out of order; the query is stopped in the middle and started again."""
    folder = new_folder(spark, "stream")
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000 - 1))
    # The clock goes on when there is nothing else: a row of no key moves the watermark past all others.
    clock = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    rows = events.count()
    ordered = events.withColumn("arrival", arrival).unionByName(clock.withColumn("arrival", F.lit((1 << 63) - 1)))
    ordered.repartitionByRange(_BATCHES + 2, "arrival").sortWithinPartitions("arrival").drop("arrival").write.parquet(f"{folder}/in")
    stream = read_log(spark, f"{folder}/in", events.schema, f"{folder}/cursor", -(-(rows + 1) // _BATCHES)).withWatermark("ts", _LATE)
    limited = ratelimit.limit_stream(stream, "key", "ts", "event_id", _MOST, _SECONDS)
    for stop_after in (2, None):
        with keyed_state(spark):
            query = limited.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start()
        _drained(query, stop_after)
    return spark.read.schema("key string, id long, allowed boolean").parquet(f"{folder}/out").where("key IS NOT NULL").select("key", F.col("id").alias("event_id"), "allowed")


#: Turns that come as payloads of a stream: questions of the user's own, repeated ones, ones of an
#: old edition, short ones and pictures; some payloads come twice.
_ASKED = """to_json(named_struct('messages', array(named_struct('id', conv_id || '-' || turn, 'from_me', conv_id % 17 = 0, 'type', CASE WHEN conv_id % 19 = 0 THEN 'image' ELSE 'text' END, 'chat_id', 'user' || conv_id, 'timestamp', 1000 + turn * 60 + conv_id % 50,
'text', named_struct('body', CASE WHEN conv_id % 19 = 0 THEN '' WHEN turn % 7 = 6 THEN '@rulesbot ab' WHEN conv_id % 5 = 0 THEN '@RulesBot rules from 9th, ' || text WHEN conv_id % 3 = 0 THEN '@RulesBot Question ' || conv_id % 7 ELSE '@RulesBot ' || text END), 'from', 'user/' || conv_id % 40)))) AS payload"""


def chat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of messages as a stream: payloads, gate, limit, cache, retrieval, prompt, answer
    and reply. Payloads come in several batches, up to a quarter of an hour late and so out of order; the
    query is stopped in the middle and started again. An answer names the length of its prompt."""
    folder = new_folder(spark, "chats")
    turns = read(spark, sf_dir, "conversations").withColumn("sent", F.expr("1000 + turn * 60 + conv_id % 50"))
    payloads = turns.selectExpr(_ASKED, "sent").union(turns.where("turn % 4 = 0").selectExpr(_ASKED, "sent"))
    arrival = F.col("sent") * 1000 + F.pmod(F.xxhash64("payload"), F.lit(900_000))
    # Behind all others a message of the bot itself, which is dropped, moves the watermark past them.
    clock = spark.range(1).select(F.expr("to_json(named_struct('messages', array(named_struct('id', 'clock', 'from_me', true, 'type', 'text', 'chat_id', 'x', 'timestamp', 4000000000L))))").alias("payload"), F.lit((1 << 63) - 1).alias("arrival"))
    rows = payloads.count()
    payloads.select("payload", arrival.alias("arrival")).unionByName(clock).repartitionByRange(_BATCHES + 2, "arrival").sortWithinPartitions("arrival").select("payload").write.parquet(f"{folder}/in")
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "doc_id % 30 AS page", "'SECTION' AS section_hint", "CAST(NULL AS STRING) AS parent_section", "source", "CAST(NULL AS STRING) AS rule_number", "CAST(NULL AS STRING) AS figure_description")
    # The store of chunks is there before the stream: batches read it, they don't make it again.
    read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id", "left").write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    log = read_log(spark, f"{folder}/in", "payload string", f"{folder}/cursor", -(-(rows + 1) // _BATCHES))
    limited = stream.limited(stream.gated(log, chat.Gate(allow_direct=False), "15 minutes"), 4, 600)
    for stop_after in (2, None):
        query = stream.answer_batches(
            limited, f"{folder}/state", lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}"), f"{folder}/cache", chunks, ingest.hashing_encoder(task="query"),
            reply_to=lambda prompt: F.concat(F.lit("answer to "), F.length(prompt), F.lit(" characters")), k=3, buckets=4,
        )
        _drained(query, stop_after)
    out = spark.read.schema("id string, chat_id string, decision string, reason string, route string, answer string, prompt string, reply string").parquet(f"{folder}/out/epoch=*")
    return out.select("id", "decision", "reason", "route", "reply", F.sha2("prompt", 256).alias("prompt_sha256"))


QUERIES = [chat_stream, phone_decisions, server_decisions, phone_replies, server_replies, rate_limit, rate_limit_stream]

_LIMIT_SQL = """
WITH RECURSIVE asked AS (SELECT user_id::VARCHAR AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT key, event_id, ts, n, ts AS start, 1 AS count, true AS allowed FROM asked WHERE n = 1
  UNION ALL
  SELECT a.key, a.event_id, a.ts, a.n, CASE WHEN a.ts - w.start >= INTERVAL 5 DAY THEN a.ts ELSE w.start END, CASE WHEN a.ts - w.start >= INTERVAL 5 DAY THEN 1 WHEN w.count >= 3 THEN w.count ELSE w.count + 1 END, a.ts - w.start >= INTERVAL 5 DAY OR w.count < 3
  FROM walk w JOIN asked a ON a.key = w.key AND a.n = w.n + 1)
SELECT key, event_id, allowed FROM walk
"""
_ANSWER_SQL = "SELECT doc_id, text, source, doc_id % 3 != 0 AS cited FROM documents"
ORACLES = {
    "chat_stream": rf"""
WITH RECURSIVE msg AS (
  SELECT conv_id || '-' || turn AS id, conv_id % 17 = 0 AS from_me, conv_id % 19 = 0 AS image, turn * 60 + conv_id % 50 AS ts, 'user_' || conv_id % 40 AS key,
         CASE WHEN turn % 7 = 6 THEN 'ab' WHEN conv_id % 5 = 0 THEN 'rules from 9th, ' || text WHEN conv_id % 3 = 0 THEN 'Question ' || conv_id % 7 ELSE text END AS body
  FROM conversations),
told AS (SELECT *, regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '^ | $', '', 'g') AS q, CASE WHEN image THEN 'text only' WHEN length(q) < 3 THEN 'too short' END AS reason FROM msg WHERE NOT from_me),
asked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM told WHERE reason IS NULL),
walk AS (
  SELECT key, id, ts, n, ts AS start, 1 AS count, true AS allowed FROM asked WHERE n = 1
  UNION ALL
  SELECT a.key, a.id, a.ts, a.n, CASE WHEN a.ts - w.start >= 600 THEN a.ts ELSE w.start END, CASE WHEN a.ts - w.start >= 600 THEN 1 WHEN w.count >= 4 THEN w.count ELSE w.count + 1 END, a.ts - w.start >= 600 OR w.count < 4
  FROM walk w JOIN asked a ON a.key = w.key AND a.n = w.n + 1),
log AS (SELECT a.id, a.ts, q, lower(q) AS cache_key, length(q) <= 4000 AS valid, regexp_matches(q, '{ask.LEGACY.replace("(?Ui)", "(?i)")}') AS legacy FROM asked a JOIN walk w ON a.id = w.id WHERE allowed),
placed AS (SELECT *, valid AND NOT legacy AS fills, row_number() OVER (PARTITION BY cache_key, valid AND NOT legacy ORDER BY ts, id) AS m, first_value(id) OVER (PARTITION BY cache_key, valid AND NOT legacy ORDER BY ts, id) AS first_id FROM log),
routes AS (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN legacy THEN 'refused' WHEN m > 1 THEN 'cached' ELSE 'prompted' END AS route FROM placed),
words AS (SELECT id, unnest(string_split_regex(lower(q), '\s+')) AS word FROM routes WHERE route = 'prompted'),
hashed AS (SELECT id, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h FROM words WHERE word != ''),
counts AS (SELECT id, (h % 64)::BIGINT AS k, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS c FROM hashed GROUP BY ALL),
grid AS (SELECT id, t.k, coalesce(c, 0) AS c FROM (SELECT DISTINCT id FROM counts) CROSS JOIN range(0, 64) t(k) LEFT JOIN counts USING (id, k)),
vectors AS (SELECT id, list(c ORDER BY k) AS v FROM grid GROUP BY id HAVING max(abs(c)) > 0),
pairs AS (SELECT q.id, e.vec_id, round(list_cosine_distance(q.v, e.embedding::DOUBLE[]), 9) AS distance FROM vectors q CROSS JOIN embeddings e),
hits AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, vec_id) AS rank FROM pairs QUALIFY rank <= 3),
blocks AS (SELECT h.id, rank, '### Context ' || rank || ' (' || coalesce(nullif(concat_ws(' | ', CASE WHEN doc_id IS NOT NULL THEN 'SECTION' END, 'page ' || doc_id % 30, source), ''), 'chunk ' || rank) || ')' || chr(10) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS block FROM hits h LEFT JOIN documents ON vec_id = doc_id),
prompts AS (SELECT id, {_PROMPT_SQL.format(context="string_agg(block, chr(10) || chr(10) ORDER BY rank)", query="any_value(q)")} AS prompt FROM blocks JOIN routes USING (id) GROUP BY id),
final AS (SELECT r.id, route, first_id, prompt FROM routes r LEFT JOIN prompts USING (id)),
said AS (
  SELECT f.id, f.route, f.prompt, CASE f.route WHEN 'refused' THEN 'Only the current edition of the rules is in scope.' WHEN 'prompted' THEN 'answer to ' || length(f.prompt) || ' characters' WHEN 'cached' THEN 'answer to ' || length(o.prompt) || ' characters' END AS reply
  FROM final f LEFT JOIN final o ON o.id = f.first_id)
SELECT t.id, CASE WHEN t.reason IS NULL AND s.id IS NOT NULL THEN 'ask' ELSE 'reply' END AS decision, CASE WHEN t.reason IS NOT NULL THEN t.reason WHEN s.id IS NULL THEN 'rate limit' END AS reason, s.route,
       CASE WHEN t.reason = 'text only' THEN 'Please ask in text.' WHEN t.reason = 'too short' THEN 'Please ask in a few more words.' WHEN s.id IS NULL THEN 'Too many questions at once, please wait a little.' ELSE s.reply END AS reply, sha256(s.prompt) AS prompt_sha256
FROM told t LEFT JOIN said s USING (id)
""",
    "phone_decisions": r"""
WITH msg AS (
  SELECT conv_id || '-' || turn AS id, conv_id % 17 = 0 AS from_me, CASE WHEN conv_id % 19 = 0 THEN 'image' ELSE 'text' END AS type, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'g1@g.us' WHEN 2 THEN 'g9@g.us' ELSE 'user' || conv_id END AS chat_id,
         trim(CASE WHEN conv_id % 38 = 0 THEN '' WHEN turn % 3 = 0 THEN '@RulesBot ' || text WHEN turn % 7 = 0 THEN ' @rulesbot  ab' ELSE text END) AS body, 'user_' || conv_id % 20 AS key
  FROM conversations WHERE turn % 9 != 8),
asked AS (SELECT *, regexp_matches(body, '(?i)@rulesbot\b') AS named, regexp_replace(regexp_replace(regexp_replace(body, '(?i)@rulesbot\b', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS q FROM msg),
told AS (
  SELECT *, CASE WHEN from_me THEN 'own message' WHEN chat_id = '' THEN 'no chat' WHEN chat_id = 'g9@g.us' THEN 'group not allowed' WHEN type != 'text' AND body != '' THEN 'not text' WHEN type != 'text' THEN 'text only' WHEN body = '' THEN 'empty' WHEN NOT named THEN 'not addressed' WHEN length(q) < 3 THEN 'too short' END AS reason FROM asked)
SELECT id, CASE WHEN reason IS NULL THEN 'ask' WHEN reason IN ('text only', 'too short') THEN 'reply' ELSE 'drop' END AS decision, reason, CASE WHEN reason IS NULL THEN q END AS query, key FROM told
""",
    "server_decisions": r"""
WITH msg AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '<@!7> ' || text WHEN turn % 4 = 2 THEN '@rulesbot <@9>  x' ELSE text END AS content FROM conversations),
asked AS (SELECT *, turn % 3 = 0 OR regexp_matches(content, '(?i)@rulesbot\b') AS named, regexp_replace(regexp_replace(regexp_replace(content, '<@!?\d+>|(?i:@rulesbot\b)', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS q FROM msg),
told AS (
  SELECT *, CASE WHEN conv_id % 30 = 7 THEN 'own message' WHEN NOT named THEN 'not addressed' WHEN conv_id % 4 NOT IN (1, 2) THEN 'group not allowed' WHEN conv_id % 8 > 5 THEN 'channel not allowed' WHEN conv_id % 23 = 0 THEN 'bot' WHEN length(q) < 3 THEN 'too short' END AS reason FROM asked)
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'ask' WHEN reason = 'too short' THEN 'reply' ELSE 'drop' END AS decision, reason, CASE WHEN reason IS NULL THEN q END AS query FROM told
""",
    "phone_replies": rf"""
WITH full_text AS (SELECT doc_id, 'RULING' || chr(10) || regexp_replace(regexp_replace('**Yes**, it is. ' || text, '\s+$', ''), '\*\*(.+?)\*\*', '*\1*', 'g') || CASE WHEN cited THEN chr(10) || chr(10) || '_Source: core, ' || source || '_' ELSE '' END AS t FROM ({_ANSWER_SQL}))
SELECT doc_id, CASE WHEN length(t) > 1600 THEN regexp_replace(left(t, 1597), '\s+$', '') || '...' ELSE t END AS reply FROM full_text
""",
    "server_replies": rf"""
WITH full_text AS (SELECT doc_id, '## Ruling' || chr(10) || regexp_replace('**Yes**, it is. ' || text, '\s+$', '') || CASE WHEN cited THEN chr(10) || chr(10) || '*Source: core, ' || source || '*' ELSE '' END AS t FROM ({_ANSWER_SQL}))
SELECT doc_id, CASE WHEN length(t) > 2000 THEN regexp_replace(left(t, 1997), '\s+$', '') || '...' ELSE t END AS reply FROM full_text
""",
    "rate_limit": _LIMIT_SQL,
    "rate_limit_stream": _LIMIT_SQL,
}
