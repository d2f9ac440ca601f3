"""Secret scans by a trigram index: Boolean queries from the rules, postings, verification."""

from __future__ import annotations

import re._constants as c
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, may_be_in, saved, text_of
from .spans import NO_SPANS, count_of, labelled, listed, masked, matches

#: Strings that a part of a pattern may stand for, and alternatives that a query may have.
MAX_STRINGS, MAX_ALTERNATIVES = 64, 64
#: Parts that rows of one key are dealt to where candidates are joined by a shuffle.
SALTS = 8


class Rule(NamedTuple):
    kind: str
    pattern: str  # as both Python and Java read it
    group: int = 0  # the part that must have
    least: int = 1  # this many characters, else the match is dropped


#: The base rules; a match that is too short is dropped, and the search goes on behind it.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of fewer than 24 can be passed over: no match starts inside a longest run.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules for other well-known formats of credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_NOTHING = [frozenset()]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _fewest(alternatives: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without those that ask more than another one does; too many say nothing."""
    kept = [a for a in set(alternatives) if not any(b < a for b in alternatives)]
    return sorted(kept, key=sorted) if len(kept) <= MAX_ALTERNATIVES else _NOTHING


def _strings(op, arg) -> set[str] | None:
    """All strings that a part stands for, lower-cased; None if there are too many."""
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return {""}
    if op is c.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                out.add(chr(value).lower())
            elif kind is c.RANGE and value[1] - value[0] < 8:
                out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is c.SUBPATTERN:
        return _sequence(arg[-1])[0]
    if op is c.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        low, high, body = arg
        own = _sequence(body)[0]
        if own is None or high is c.MAXREPEAT or high > 8:
            return None
        out, power = ({""} if low == 0 else set()), {""}
        for i in range(1, high + 1):
            power = {a + b for a in power for b in own}
            if len(power) > MAX_STRINGS:
                return None
            out |= power if i >= low else set()
        return out
    return None


def _needs(op, arg) -> list[frozenset[str]]:
    """What a part that stands for too many strings needs all the same."""
    if op is c.SUBPATTERN:
        return _sequence(arg[-1])[1]
    if op is c.BRANCH:
        return _fewest([a for x in arg[1] for a in _sequence(x)[1]])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
        return _sequence(arg[2])[1]
    return _NOTHING


def _sequence(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """The strings of a sequence if they are few, and its trigrams: one of the alternatives
    must be there as a whole."""
    run, needs, exact = {""}, _NOTHING, True

    def also(other: list[frozenset[str]]) -> list[frozenset[str]]:
        both = _fewest([a | b for a in needs for b in other])
        return needs if both == _NOTHING else both

    for op, arg in items:
        own = _strings(op, arg)
        longer = None if own is None else {a + b for a in run for b in own}
        if longer is not None and len(longer) <= MAX_STRINGS:
            run = longer
        else:
            exact = False
            needs = also(_fewest([_grams(x) for x in run]))
            run = {""} if own is None else own
            if own is None:
                needs = also(_needs(op, arg))
    needs = also(_fewest([_grams(x) for x in run]))
    return (run if exact else None), needs


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigrams (lower-cased) of which a text that matches has all of one alternative;
    None if the pattern has no such trigrams."""
    needs = _sequence(parser.parse(pattern))[1]
    return None if frozenset() in needs else needs


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """key, rules: the rules whose query a text fulfils, by postings of the queries'
    trigrams; `docs` has key and text (no nulls). Empty texts and empty tables have no candidates, a
    repeated key counts once, other columns aren't read. None if no rule has a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for a in q for g in a})
    if not grams:
        return None
    clauses = [(kind, i, gram, len(a)) for kind, q in queries.items() for i, a in enumerate(q) for gram in a]
    asked = docs.sparkSession.createDataFrame(clauses, "rule string, alternative int, gram string, needed int")
    low = docs.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select("key", F.explode(has).alias("gram"))
    # The clauses are as many as the rules' trigrams, whatever the corpus.
    met = postings.join(F.broadcast(asked), "gram").groupBy("key", "rule", "alternative").agg(F.count_distinct("gram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _told(keyed: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """`keyed` with _rm_rules of its _rm_key, by a broadcast of at most `limit` candidates. Beyond
    that only texts that a filter of the candidates' keys lets through move to them."""
    found = found.withColumnsRenamed({"key": "_rm_key", "rules": "_rm_rules"})
    if found.limit(limit + 1).count() <= limit:
        return keyed.join(F.broadcast(found), "_rm_key", "left")
    sifted = may_be_in(keyed, F.col("_rm_key"), found, F.col("_rm_key"), "_rm_may")
    # Equal rows have equal keys: each share of them has a salt of its own.
    salted = found.withColumn("_rm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    moved = sifted.where("_rm_may").withColumn("_rm_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["_rm_key", "_rm_salt"], "left").drop("_rm_salt")
    return sifted.where("NOT _rm_may").unionByName(moved, allowMissingColumns=True).drop("_rm_may")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Adds base_spans and all_spans, arrays of (start, rank, end, kind) sorted by start and
    then by the order of the rules; positions are code points, ends exclusive.

    Rules with trigrams are tried only on the texts that the index finds, all others on every
    text. Null and empty texts have no spans; repeated rows each get theirs; other columns stay, those
    named as a result are replaced. An empty table has no rows; patterns take time in proportion to a text's length.
    """
    rules = (*base, *more)
    keyed = docs.withColumn("_rm_text", text_of(docs)).withColumn("_rm_key", F.xxhash64("doc_id", "_rm_text"))
    found = candidates(keyed.select(F.col("_rm_key").alias("key"), F.col("_rm_text").alias("text")), rules)
    if found is not None:
        keyed = _told(keyed, saved(found, "candidates"), limit)
        indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    else:
        indexed = set()

    def verified(rule: Rule) -> Column:
        spans = F.filter(matches(F.col("_rm_text"), rule.pattern, rule.group), lambda s: F.length(s["part"]) >= rule.least)
        if rule.kind not in indexed:
            return spans
        return F.when(F.array_contains("_rm_rules", rule.kind), spans).otherwise(F.expr(NO_SPANS))

    spans = keyed.withColumns({f"_rm_{r.kind}": verified(r) for r in rules})
    names = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    out = spans.withColumn("base_spans", F.array_sort(labelled({r.kind: F.col(f"_rm_{r.kind}") for r in base}))).withColumn("all_spans", F.array_sort(labelled({r.kind: F.col(f"_rm_{r.kind}") for r in rules})))
    return out.select(*names, "base_spans", "all_spans")


def summary(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, the number of base spans by kind, a digest of the base spans, and all spans."""
    counts = [count_of(F.col("base_spans"), r.kind).alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """`docs` with every found secret masked in its text; all rows stay, null texts stay null.
    Texts of any length are masked whole; an empty table stays one; all columns stay."""
    aside = {c: f"_rm_own_{c}" for c in docs.columns if c in ("base_spans", "all_spans")}
    found = scan(docs.withColumnsRenamed(aside), base, more)
    out = found.withColumn("text", masked(F.col("text"), F.col("all_spans"), mask)).drop("base_spans", "all_spans")
    return out.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)
