"""Positions of all matches of a pattern, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of an array of matches: code points, end exclusive; `part` is the asked group.
NO_SPANS = "cast(array() as array<struct<start: int, end: int, match: string, part: string>>)"
AROUND = NO_SPANS.replace("part: string", "part: string, left: string, right: string")
#: Matches whose lengths are summed at once.
BLOCK = 256


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with the value computed once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def placed(v: Column, group: int = 0, around: bool = False) -> Column:
    """gaps, all (and parts) as an array of start, end, match, part (and left and right): the
    matches and the pieces between them give the positions; sums of blocks of lengths keep texts
    with very many matches from costing the square of their number."""
    lengths = F.zip_with(F.slice(v["gaps"], 1, F.size(v["all"])), v["all"], lambda g, m: F.length(g) + F.length(m))
    other = lambda i: F.coalesce(F.get(v["all"], i), F.lit(""))

    def with_lengths(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: _total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        bases = let(blocks, lambda s: F.transform(s, lambda _, i: _total(F.slice(s, F.lit(1), i))))

        def with_bases(base: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                start = F.get(base, b) + _total(F.slice(n, b * BLOCK + 1, i % BLOCK)) + F.length(F.get(v["gaps"], i))
                more = [F.concat(other(i - 1), F.get(v["gaps"], i)).alias("left"), F.concat(F.get(v["gaps"], i + 1), other(i + 1)).alias("right")] if around else []
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), (F.get(v["parts"], i) if group else m).alias("part"), *more)

            return F.transform(v["all"], one)

        return let(bases, with_bases)

    return let(lengths, with_lengths)


def matches(text: Column, pattern: str, group: int = 0, around: bool = False) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that matches no empty text. With
    `around`, each match also has left and right: the text up to and with the match before and
    after it."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts")] if group else []
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), *parts)
    return F.when(text.rlike(pattern), let(found, lambda v: placed(v, group, around))).otherwise(F.expr(AROUND if around else NO_SPANS))


def walked(text: Column, gap: str, pattern: str) -> Column:
    """gaps, all: the matches of a pattern and the texts before, between and behind them, of a
    pattern whose matches follow each other with only a `gap` between. The text is walked from
    match to match, so no place of it is tried as a start but those behind a gap."""
    part = lambda i: F.regexp_extract_all(text, F.lit(rf"\G({gap})({pattern})"), F.lit(i))

    def with_tail(v: Column) -> Column:
        lengths = F.zip_with(v["gaps"], v["all"], lambda g, m: F.length(g) + F.length(m))
        tail = let(_total(lengths), lambda n: F.substring(text, n + 1, F.length(text)))
        return F.struct(F.concat(v["gaps"], F.array(tail)).alias("gaps"), v["all"].alias("all"))

    return let(F.struct(part(1).alias("gaps"), part(2).alias("all")), with_tail)


def within(found: Column, pattern: str) -> Column:
    """The matches of a pattern in those of another, as `walked` has them, of a pattern that
    matches at the beginning of each of them."""
    inner = F.transform(found["all"], lambda m: F.struct(F.split(m, pattern, -1).alias("gaps"), F.regexp_extract_all(m, F.lit(pattern), F.lit(0)).alias("all")))

    def joined(v: Column) -> Column:
        rests = F.concat(F.array(F.lit("")), F.transform(v, lambda x: F.element_at(x["gaps"], -1)))

        def with_heads(heads: Column) -> Column:
            gaps = F.transform(v, lambda x, i: F.concat(F.array(F.get(heads, i)), F.slice(x["gaps"], F.lit(2), F.size(x["gaps"]) - 2)))
            return F.struct(F.concat(F.flatten(gaps), F.slice(heads, -1, 1)).alias("gaps"), F.flatten(F.transform(v, lambda x: x["all"])).alias("all"))

        return let(F.zip_with(rests, found["gaps"], lambda r, g: F.concat(r, g)), with_heads)

    return let(inner, joined)


def labelled(kinds: dict[str, Column]) -> Column:
    """Spans of several kinds, by name, as one array of (start, rank, end, kind)."""

    def of(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.concat(*[of(rank, kind, spans) for rank, (kind, spans) in enumerate(kinds.items())])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each stretch that spans (sorted by start) cover replaced by the mask."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, first, step)
    return F.when(F.size(spans) > 0, let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))).otherwise(text)
