"""Personal data: fixed patterns as seeds, and identifiers that their contexts lead to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, small, text_of, told
from .spans import count_of, labelled, let, listed, matches, placed, walked, within

#: The base kinds. Possessive parts keep the work in proportion to the text: where a run of
#: characters fails, its later parts fail too, unless the match before ended inside the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"  # shorter ones fail and hold no longer one
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: What may be an identifier: a match of a base kind, or a word with a digit or an at sign.
_MARKED = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
WORD = rf"(?<![^\x20\x09-\x0D]){_MARKED}"
TOKEN = f"{EMAIL}|{IP}|{CARD}|{PHONE}|{WORD}"
#: Where all of them are: words with a digit or an at sign, and such words in a row with spaces and
#: the other characters of a phone number alone between them. No match crosses an end of a row, and
#: a token stands at its beginning. The patterns, slow at every place of a text, are tried in these.
ROW, AHEAD = rf"{_MARKED}(?:\x20++(?:[().-]++\x20++)*+{_MARKED})*+", r"(?:[^0-9@]*[\x20\x09-\x0D])?+"
#: What isn't of the identifier: brackets, quotes and a name with a colon or an equals sign
#: ahead of it (which count as its left context), punctuation behind it.
LEAD = r"^[\"'(\[{<]*+(?:[A-Za-z_][A-Za-z_-]*+[=:]++[\"'(\[{<]*+)?+"
TAIL, PUNCTUATION = r"[.,;:!?\"')\]}>]++\z", r"^[.,;:!?\"')\]}>]*+"
#: Rounds of scoring; contexts and identifiers that a pattern needs; confidence that patterns
#: and identifiers need; share of a pattern's occurrences that must be next to a candidate.
ROUNDS, SUPPORT, CONFIDENCE, SPECIFIC = 3, 3, 0.5, 0.25
#: A pattern or instance with more than this share of all edges is joined by a broadcast: there
#: are at most as many of them as the share goes into one.
HEAVY = 1 / 20_000
#: Phrases that may be broadcast to count them; beyond it the corpus is counted first.
PHRASES = 1_000_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


def _is_card(match: Column) -> Column:
    return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def rows_of(text: Column) -> Column:
    """gaps, all: the rows of marked words, and what is between them."""
    none = F.struct(F.array(text).alias("gaps"), F.array().cast("array<string>").alias("all"))
    return F.when(text.rlike("[0-9@]"), walked(text, AHEAD, ROW)).otherwise(none)


def base_spans(rows: Column) -> dict[str, Column]:
    """Spans by kind, of the rows of a text."""

    def found(pattern: str) -> Column:
        moved = lambda row: lambda s: F.struct((row["start"] + s["start"]).alias("start"), (row["start"] + s["end"]).alias("end"), s["match"].alias("match"))
        return F.flatten(F.transform(rows, lambda row: F.transform(matches(row["match"], pattern), moved(row))))

    return {
        "email": found(EMAIL),
        "ip": F.filter(found(IP), lambda s: _is_ip(s["match"])),
        "card": F.filter(found(CARD), lambda s: _is_card(s["match"])),
        "phone": F.filter(found(PHONE), lambda s: _is_phone(s["match"])),
    }


def _is_seed(match: Column) -> Column:
    """Whether a token is of a base kind, or holds what is."""
    part = lambda pattern: F.regexp_extract(match, pattern, 0)
    return match.rlike(EMAIL) | _is_ip(part(IP)) | _is_card(part(CARD)) | (match.contains("+") & _is_phone(part(PHONE)))


def candidates(found: Column) -> Column:
    """start, end, instance, seed, l1, l2, r1, r2 of what may be an identifier in a text, by its rows
    and gaps: l1 and r1 are
    the words next to it, l2 and r2 two words, lower-cased, runs of digits as 0; empty at the
    ends of the text."""
    plain = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "[0-9]++", "0"), r"[\x20\x09-\x0D]++", " "))
    word, gap = r"[^\x20\x09-\x0D]++", r"[\x20\x09-\x0D]"

    def trimmed(s: Column) -> Column:
        lead = F.regexp_extract(s["match"], LEAD, 0)
        instance = F.regexp_replace(F.regexp_replace(s["match"], LEAD, ""), TAIL, "")
        return F.struct((s["start"] + F.length(lead)).alias("start"), instance.alias("instance"), _is_seed(s["match"]).alias("seed"), F.concat(s["left"], lead).alias("left"), s["right"].alias("right"))

    def told(s: Column) -> Column:
        before = lambda body: plain(F.regexp_extract(s["left"], rf"(?<![^\x20\x09-\x0D])({body}){gap}*+\z", 1))
        after = lambda body: plain(F.regexp_extract(s["right"], rf"{PUNCTUATION}{gap}*+({body})", 1))
        return F.struct(
            s["start"].alias("start"), (s["start"] + F.length(s["instance"])).alias("end"), s["instance"].alias("instance"), s["seed"].alias("seed"),
            before(word).alias("l1"), before(f"{word}{gap}++{word}").alias("l2"), after(word).alias("r1"), after(f"{word}{gap}++{word}").alias("r2"),
        )

    found = F.transform(F.transform(placed(within(found, TOKEN), around=True), trimmed), told)
    return F.filter(found, lambda c: c["instance"].rlike("[0-9@]"))


def _edges(contexts: DataFrame) -> DataFrame:
    """context, instance, seed, times, pattern: the lexical patterns of a context, one or two
    words on its left or right."""
    kinds = [F.when(F.length(c) > 0, F.concat(F.lit(c + " "), c)) for c in ("l1", "l2", "r1", "r2")]
    return contexts.select("context", "instance", "seed", "times", F.explode(F.array_compact(F.array(*kinds))).alias("pattern"))


def occurrences(docs: DataFrame, phrases: DataFrame, limit: int = PHRASES) -> DataFrame:
    """phrase, occurs: how often phrases of one or two words stand in the texts, written as the
    words of contexts are. Second words are only looked at behind a word that begins one of the
    phrases. Counts are combined before they are shuffled."""
    words = docs.select(F.split(F.lower(F.regexp_replace("text", "[0-9]++", "0")), r"[\x20\x09-\x0D]+").alias("word"))
    words = words.select("word", F.slice("word", 2, 1 << 30).alias("next")).select(F.explode(F.arrays_zip("word", "next")).alias("w")).select("w.*")
    either = lambda alone, follows: F.explode(F.array_compact(F.array(F.when(alone, F.col("word")), F.when(follows, F.concat_ws(" ", "word", "next"))))).alias("phrase")
    if phrases.limit(limit + 1).count() <= limit:
        parts = phrases.select(F.substring_index("phrase", " ", 1).alias("word"), F.get(F.split("phrase", " "), F.lit(1)).alias("second"))
        heads = parts.groupBy("word").agg(F.bool_or(F.col("second").isNull()).alias("alone"))
        pairs = parts.where("second IS NOT NULL").withColumnRenamed("word", "first")
        found = words.join(F.broadcast(heads), "word").join(F.broadcast(pairs), (F.col("word") == F.col("first")) & (F.col("next") == F.col("second")), "left")
        found = found.groupBy("word", "alone", F.col("second").alias("next")).agg(F.count(F.lit(1)).alias("n"))
        return found.select("n", either(F.col("alone"), F.col("next").isNotNull())).groupBy("phrase").agg(F.sum("n").alias("occurs"))
    found = words.select(either(F.lit(True), F.col("next").isNotNull()))
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("occurs")).join(phrases, "phrase", "left_semi")


def discover(may: DataFrame, count: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, specific: float = SPECIFIC) -> tuple[DataFrame, DataFrame]:
    """Candidates (instance, seed, l1, l2, r1, r2) -> patterns (pattern, n, score, trusted) and
    identifiers (instance, conf). `count` gives the occurrences (phrase, occurs) of a table of
    phrases in the corpus.

    A context is an instance with the words around it; however often a text is copied, it
    counts once. A pattern says something if it has `support` contexts and at least `specific`
    of the occurrences of its words are next to a candidate: "holder:" does, "the" doesn't.
    Patterns and instances score each other in every round. A pattern's score is the trust in
    the instances of its contexts over their number and one more; seeds have 1, all others what
    the round before gave them, so that identifiers induce patterns in their turn; in the first
    round they count half, being unknown. It is trusted with `confidence` and `support` different
    instances of that confidence. A context has the score of its best trusted pattern, or 0, and
    an instance's confidence is the mean over its contexts that have a pattern which says
    something. Ties don't matter: scores depend on sums alone.
    """
    contexts = may.groupBy("instance", "l1", "l2", "r1", "r2").agg(F.bool_or("seed").alias("seed"), F.count(F.lit(1)).alias("times"))
    contexts = saved(contexts.withColumn("context", F.monotonically_increasing_id()), "contexts")
    every = saved(_edges(contexts), "edges")
    total = every.count()
    sizes = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("met")).where(F.col("n") >= support)
    sizes = saved(sizes.withColumn("phrase", F.substring("pattern", 4, 1 << 30)), "sizes")
    known = saved(count(saved(sizes.select("phrase").distinct(), "phrases")), "occurrences")
    telling = saved(sizes.join(known, "phrase", "left").where(F.col("met") >= specific * F.coalesce("occurs", "met")).select("pattern", "n"), "telling")
    hot = F.col("n") > HEAVY * total
    edges = saved(told(every, telling, "pattern", hot).select("context", "instance", "seed", "pattern"), "edges")
    forget(contexts, every)
    patterns = found = None
    for _ in range(rounds):
        seeds = edges.where("seed").select("pattern", "instance", F.lit(1.0).alias("conf"), F.lit(1.0).alias("weight"))
        others = edges.where("NOT seed").select("pattern", "instance")
        others = others.select("*", F.lit(0.0).alias("conf"), F.lit(0.5).alias("weight")) if found is None else told(others, found, "instance", hot).select("pattern", "instance", "conf", F.lit(1.0).alias("weight"))
        pairs = seeds.union(others).groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum("conf").alias("trust"), F.max("conf").alias("conf"))
        scores = pairs.groupBy("pattern").agg(F.sum("n").alias("n"), (F.sum("trust") / (F.sum("weight") + 1)).alias("score"), F.count_if(F.col("conf") >= confidence).alias("known"))
        trusted = (F.col("known") >= support) & (F.col("score") >= confidence)
        before = (patterns, found)
        patterns = saved(scores.select("pattern", "n", "score", trusted.alias("trusted")), "patterns")
        met = told(edges.where("NOT seed"), patterns, "pattern", hot).groupBy("context", "instance").agg(F.max(F.when(F.col("trusted"), F.col("score")).otherwise(F.lit(0.0))).alias("score"))
        found = saved(met.groupBy("instance").agg(F.avg("score").alias("conf"), F.count(F.lit(1)).alias("n")), "instances")
        forget(*before)
    return patterns, found.where(F.col("conf") >= confidence).select("instance", "conf")


def scan(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, specific: float = SPECIFIC) -> DataFrame:
    """doc_id, base_spans, all_spans of every row: arrays of (start, rank, end, kind) by kind,
    then start. Kind `id` has the occurrences of discovered identifiers that no base span meets.

    Only doc_id and text are read, other columns are left out. Null and empty texts have no
    spans; very long texts cost in proportion to their length; repeated rows each get theirs,
    but count once in the scores; a corpus without seeds, or whose seeds share no context,
    discovers nothing; an empty table gives no rows.
    """
    docs = docs.select("doc_id", text_of(docs).alias("text"))
    spans = docs.select("doc_id", rows_of(F.col("text")).alias("found")).withColumn("rows", placed(F.col("found")))
    spans = spans.withColumns({f"k_{kind}": c for kind, c in base_spans(F.col("rows")).items()})
    spans = spans.withColumn("base_spans", labelled({kind: F.col(f"k_{kind}") for kind in ("email", "ip", "card", "phone")}))
    rows = saved(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base_spans", candidates(F.col("found")).alias("may")), "spans")
    may = rows.select("row", F.explode("may").alias("m")).select("row", "m.*")
    _, identifiers = discover(may, lambda phrases: occurrences(docs, phrases), rounds, support, confidence, specific)
    more = may.where("NOT seed").join(small(identifiers), "instance").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("rank"), "end", F.lit("id").alias("kind")))).alias("more"))
    out = rows.select("row", "doc_id", "base_spans").join(more, "row", "left")
    apart = F.filter("more", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return out.select("doc_id", "base_spans", F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(F.concat("base_spans", apart)).alias("all_spans"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, a digest of the base spans, and all spans."""
    counts = [count_of(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
