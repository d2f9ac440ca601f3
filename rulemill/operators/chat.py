"""Chat messages: mentions, gates, decisions and reply formats of two kinds of channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions.text import present, rstrip, squeeze, strip

GROUP_SUFFIX = "@g.us"
#: Longest replies of the two channels.
PHONE_LIMIT, SERVER_LIMIT = 1600, 2000


@dataclass(frozen=True)
class Gate:
    """What a deployment answers. Lists of allowed ids are comma-joined; empty allows all."""

    mention: str = r"(?i)@rulesbot\b"
    require_mention: bool = True
    allow_direct: bool = True
    allowed_groups: str = ""
    allowed_guilds: str = ""
    allowed_channels: str = ""
    bot_id: int = 0
    shortest: int = 3


def has_mention(body: Column, pattern: str = Gate.mention) -> Column:
    return F.coalesce(body, F.lit("")).rlike(pattern)


def strip_mention(body: Column, pattern: str = Gate.mention) -> Column:
    return squeeze(F.regexp_replace(body, pattern, ""))


def is_group(chat_id: Column) -> Column:
    return chat_id.endswith(GROUP_SUFFIX)


def should_process(body: Column, chat_id: Column, gate: Gate = Gate()) -> Column:
    if not gate.require_mention:
        return F.lit(True)
    return has_mention(body, gate.mention) | (~is_group(chat_id) & F.lit(gate.allow_direct))


def _ids(listed: str) -> list[str]:
    return [x.strip() for x in listed.split(",") if x.strip()]


def allowed(value: Column, listed: str) -> Column:
    """True where the list is empty or has the value; null is in no list."""
    ids = _ids(listed)
    return F.coalesce(value.cast("string").isin(ids), F.lit(False)) if ids else F.lit(True)


def decide_phone(df: DataFrame, gate: Gate = Gate(), limited: Column | None = None) -> DataFrame:
    """Adds decision, reason and query to messages (from_me, chat_id, type, body). The first
    rule that fits decides; `limited` (of rows that pass all others) stands for the limiter."""
    chat_id, body = strip(F.coalesce("chat_id", F.lit(""))), strip(F.coalesce("body", F.lit("")))
    query = strip_mention(body, gate.mention)
    rules = [
        (F.coalesce("from_me", F.lit(False)), "drop", "own message"),
        (chat_id == "", "drop", "no chat"),
        (is_group(chat_id) & ~allowed(chat_id, gate.allowed_groups), "drop", "group not allowed"),
        ((F.coalesce("type", F.lit("")) != "text") & (body != ""), "drop", "not text"),
        (F.coalesce("type", F.lit("")) != "text", "reply", "text only"),
        (body == "", "drop", "empty"),
        (~should_process(body, chat_id, gate), "drop", "not addressed"),
        (F.length(query) < gate.shortest, "reply", "too short"),
    ]
    return _decided(df, rules, query, limited)


def server_query(content: Column, gate: Gate) -> Column:
    """The content without mentions of any user, by number or by name."""
    return squeeze(F.regexp_replace(F.regexp_replace(content, r"<@!?\d+>", ""), gate.mention, ""))


def decide_server(df: DataFrame, gate: Gate = Gate(), limited: Column | None = None) -> DataFrame:
    """The same for messages of servers (author_id, author_is_bot, guild_id, channel_id,
    content, raw_mentions). The mention is asked for first, whatever the gate requires."""
    content = F.coalesce("content", F.lit(""))
    mentioned = F.coalesce(F.array_contains("raw_mentions", F.lit(gate.bot_id)), F.lit(False)) | has_mention(content, gate.mention)
    query = server_query(content, gate)
    rules = [
        (F.coalesce(F.col("author_id") == gate.bot_id, F.lit(False)), "drop", "own message"),
        (~mentioned, "drop", "not addressed"),
        (~allowed(F.col("guild_id"), gate.allowed_guilds), "drop", "group not allowed"),
        (~allowed(F.col("channel_id"), gate.allowed_channels), "drop", "channel not allowed"),
        (F.coalesce("author_is_bot", F.lit(False)), "drop", "bot"),
        (F.length(query) < gate.shortest, "reply", "too short"),
    ]
    return _decided(df, rules, query, limited)


def _decided(df: DataFrame, rules: list[tuple[Column, str, str]], query: Column, limited: Column | None) -> DataFrame:
    if limited is not None:
        rules = [*rules, (limited, "reply", "rate limit")]
    hit = F.coalesce(*[F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))) for test, decision, reason in rules], F.struct(F.lit("ask").alias("decision"), F.lit(None).cast("string").alias("reason")))
    out = df.withColumn("hit", hit).withColumn("decision", F.col("hit.decision")).withColumn("reason", F.col("hit.reason")).drop("hit")
    return out.withColumn("query", F.when(F.col("decision") == "ask", query))


def _footer(sources: Column, mark: str) -> Column:
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce(sources, F.expr("cast(array() as array<string>)")), lambda s: present(s).isNotNull())))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"\n\n{mark}Source: "), F.array_join(names, ", "), F.lit(mark))).otherwise(F.lit(""))


def format_reply(df: DataFrame, channel: str, answer: str = "answer", sources: str = "sources") -> DataFrame:
    """Adds reply: the answer as the channel ("phone" or "server") shows it, with its sources
    (sorted, once each) and cut at the channel's limit. Null answers stay null."""
    text, limit, mark = F.col(answer), SERVER_LIMIT, "*"
    if channel == "phone":
        limit, mark = PHONE_LIMIT, "_"
        # A pattern can't change case, so headings are made upper line by line.
        heads = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"(?s)^#{1,6}\s+.+\z"), F.upper(F.regexp_replace(x, r"(?s)^#{1,6}\s+", ""))).otherwise(x))
        text = F.regexp_replace(F.array_join(heads, "\n"), r"(?d)\*\*(.+?)\*\*", "*$1*")
    full = F.concat(strip(text), _footer(F.col(sources), mark))
    return df.withColumn("reply", F.when(F.length(full) > limit, F.concat(rstrip(F.left(full, F.lit(limit - 3))), F.lit("..."))).otherwise(full))
