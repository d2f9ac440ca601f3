"""Column helpers that keep Unicode white space, line and rounding rules in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends besides the carriage return and line feed pair.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() only drops spaces)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+\z", "")


def squeeze(c: Column) -> Column:
    """Stripped, each run of white space one space."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def lines(c: Column) -> Column:
    """Lines without their ends; a line end at the very end starts no further line."""
    parts = F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1)
    return F.when(F.length(c) > 0, parts).otherwise(F.expr("cast(array() as array<string>)"))


def present(c: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(c, F.lit(""))


def clip(c: Column, limit: int, tail: str) -> Column:
    """At most `limit` characters, the last of which are `tail` if anything was cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - len(tail))), F.lit(tail))).otherwise(c)


def short_hash(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, colon-joined."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(32))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with the value computed once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
