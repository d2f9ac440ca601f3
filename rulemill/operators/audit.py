"""Audits of numbered-rule chunks: doc_id, rule_number, title, chunk_type, page, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulemill.functions.text import lines, strip

# Labels of foreign parts with their patterns; a chunk gets the first that fits.
CONTAMINATION = (
    ("flowchart_frame_ref", r"(?Umd)Frame \d+\.\d+"),
    ("flowchart_marker", "►"),
    ("index_slash_stub", r"(?Umd)^\s*/\s*$"),
    ("shooting_flowchart", "SELECT TARGETS"),
    ("attack_flowchart", "IDENTICAL ATTACKS"),
    ("bare_page_number", r"(?Umd)^\d+\s*$"),
)
# A label that isn't held against a rule.
EXEMPT = ("shooting_flowchart", "04.02")
# What well-formed stratagems and actions have.
STRATAGEM_MARKERS = ("1CP", "2CP", "WHEN:", "TARGET:", "EFFECT:", "RESTRICTIONS:")
ACTION_MARKERS = ("MAXIMUM DISTANCE:", "ELIGIBLE IF:", "EFFECT:", "BEFORE MOVING:", "AFTER MOVING:")
STRATAGEM_CHAPTER, CHARGE_CHAPTER = "15", "11"
HEADERS_INSIDE = r"(?U)(?:\[[A-Z0-9 \-/']+\]|[A-Z][A-Z0-9 \-/']{2,100})\s+\d{2}\.\d{2}\b"
SHORT, LONG = 120, 3000


def chapter(rule_number: Column) -> Column:
    return F.substring_index(rule_number, ".", 1)


def minor(rule_number: Column) -> Column:
    return F.substring_index(rule_number, ".", -1).cast("int")


def _marks(text: Column, markers: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(text, F.lit(m)).cast("int")
    return total


def structure(chunks: DataFrame) -> DataFrame:
    """Totals per document: counts, first and last rule, lengths."""
    label, n = F.concat_ws(" ", "rule_number", "title"), F.length("text")
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min_by(label, "rule_number").alias("first_rule"), F.max_by(label, "rule_number").alias("last_rule"),
        F.min(n).alias("length_min"), F.floor(F.sum(n) / F.count(F.lit(1))).alias("length_avg"), F.max(n).alias("length_max"),
        F.count_if(F.col("chunk_type") == "keyword").alias("keywords"), F.count_if(F.col("chunk_type") == "core_rule").alias("core_rules"),
        F.count_if(n < SHORT).alias("short"), F.count_if(n > LONG).alias("long"),
    )


def by_chapter(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", chapter(F.col("rule_number")).alias("chapter")).agg(F.count(F.lit(1)).alias("chunks"))


def gaps(chunks: DataFrame) -> DataFrame:
    """doc_id, chapter, missing: minors between a chapter's first and last that no chunk has."""
    m = minor(F.col("rule_number"))
    found = chunks.groupBy("doc_id", chapter(F.col("rule_number")).alias("chapter")).agg(F.collect_set(m).alias("has"), F.min(m).alias("lo"), F.max(m).alias("hi"))
    return found.select("doc_id", "chapter", F.array_except(F.sequence("lo", "hi"), "has").alias("missing")).where(F.size("missing") > 0)


def expected(chunks: DataFrame, of_chapter: str, first: int, last: int) -> DataFrame:
    """doc_id, minor: what a chapter should have from first to last and lacks."""
    wanted = chunks.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("minor"))
    have = chunks.where(chapter(F.col("rule_number")) == of_chapter).select("doc_id", minor(F.col("rule_number")).alias("minor"))
    return wanted.join(have, ["doc_id", "minor"], "left_anti")


def lengths(chunks: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    n = F.length("text")
    return chunks.select("doc_id", "rule_number", "title", n.alias("length"), F.when(n < short, "short").when(n > long, "long").alias("kind")).where("kind IS NOT NULL")


def duplicate_titles(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "title").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


def findings(chunks: DataFrame) -> DataFrame:
    """doc_id, rule_number, title, page, severity, message: foreign parts and odd headers."""
    dirty = F.lit(None).cast("string")
    for label, pattern in reversed(CONTAMINATION):
        fits = F.col("text").rlike(pattern)
        if label == EXEMPT[0]:
            fits = fits & (F.col("rule_number") != EXEMPT[1])
        dirty = F.when(fits, label).otherwise(dirty)
    title, core = F.col("title"), F.col("chunk_type") == "core_rule"
    odd = ((title != strip(title)) | ((title != F.upper(title)) & core)) & title.rlike(r"(?U)\d{2}\.\d{2}")
    headless = core & ~F.startswith("text", title)
    told = F.array(
        F.struct(F.lit("warn").alias("severity"), dirty.alias("message")),
        F.struct(F.lit("fail").alias("severity"), F.when(odd, "title_contains_rule_number").alias("message")),
        F.struct(F.lit("warn").alias("severity"), F.when(headless, "header_mismatch").alias("message")),
    )
    return chunks.select("doc_id", "rule_number", "title", "page", F.explode(told).alias("f")).select("doc_id", "rule_number", "title", "page", "f.severity", "f.message").where("message IS NOT NULL")


def readiness(chunks: DataFrame) -> DataFrame:
    text, title, of = F.col("text"), F.col("title"), chapter(F.col("rule_number"))
    stratagem = (of == STRATAGEM_CHAPTER) | F.contains(F.upper(text), F.lit("STRATAGEM"))
    actions = _marks(text, ACTION_MARKERS)
    return chunks.groupBy("doc_id").agg(
        F.count_if(stratagem).alias("stratagems"), F.count_if(stratagem & (_marks(text, STRATAGEM_MARKERS) >= 3)).alias("stratagems_well_formed"),
        F.count_if(actions >= 1).alias("actions"), F.count_if(actions >= 2).alias("actions_well_formed"), F.count_if(F.col("chunk_type") == "keyword").alias("keywords"),
        F.count_if(F.contains(title, F.lit("BATTLE")) & F.contains(title, F.lit("SHOCK"))).alias("battle_shock"), F.count_if(F.contains(title, F.lit("CHARGE")) | (of == CHARGE_CHAPTER)).alias("charge"),
    )


def stratified_sample(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Up to n rules of each chapter, evenly spaced."""
    own = W.partitionBy("doc_id", "chapter")
    light = chunks.select("doc_id", "rule_number", chapter(F.col("rule_number")).alias("chapter"))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / n))
    ranked = light.withColumn("at", F.row_number().over(own.orderBy("rule_number")) - 1).withColumn("size", F.count(F.lit(1)).over(own))
    return ranked.where((F.col("size") <= n) | ((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < n))).select("doc_id", "chapter", "rule_number")


def extras_sample(chunks: DataFrame, width: int = 350) -> DataFrame:
    """Rules that a reader should look at, once each: stratagems, keywords and long ones."""
    odd = (chapter(F.col("rule_number")) == STRATAGEM_CHAPTER) | (F.col("chunk_type") == "keyword") | (F.length("text") > LONG)
    flat = F.translate("text", "\n", " ")
    shown = F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width - 1)), F.lit("…"))).otherwise(flat)
    # Of a rule's several chunks the one that comes first by title and text, whatever the partitions.
    return chunks.where(odd).groupBy("doc_id", "rule_number").agg(F.min(F.struct("title", shown.alias("preview"), "text")).alias("c")).select("doc_id", "rule_number", "c.title", "c.preview")


def marker_table(chunks: DataFrame, of_chapter: str = STRATAGEM_CHAPTER) -> DataFrame:
    five = tuple(m for m in STRATAGEM_MARKERS if m != "RESTRICTIONS:")
    return chunks.where(chapter(F.col("rule_number")) == of_chapter).select("doc_id", "rule_number", "title", "page", F.length("text").alias("length"), _marks(F.col("text"), five).alias("markers"), F.contains("text", F.lit("STRATAGEM")).alias("has_word"))


def swallowed(chunks: DataFrame) -> DataFrame:
    """Headers of other rules inside a chunk, and signs of a FAQ in it."""
    inner = F.filter(F.regexp_extract_all("text", F.lit(HEADERS_INSIDE), F.lit(0)), lambda h: ~h.endswith(F.col("rule_number")))
    faq = F.regexp_count("text", F.lit(r"(?Umd)^Q:\s"))
    app = F.contains("text", F.lit("CONTINUED IN THE APP"))
    return chunks.select("doc_id", "rule_number", F.size(inner).alias("headers"), F.array_join(inner, "; ").alias("listed"), faq.alias("faq_blocks"), app.alias("app_pointer")).where("headers > 0 OR faq_blocks > 0 OR app_pointer")


def wrapped_titles(chunks: DataFrame, plural: str = "MONSTER", rule: str = "17.01") -> DataFrame:
    return chunks.where(F.startswith("title", F.lit("AND ")) | (F.contains("title", F.lit(plural)) & (F.col("rule_number") == rule))).select("doc_id", "rule_number", "title")


def footer_noise(chunks: DataFrame) -> DataFrame:
    rows = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    last = F.get(rows, F.size(rows) - 1)
    return chunks.select("doc_id", "rule_number", "page", last.alias("footer")).where(F.col("footer").rlike(r"(?U)^\d{1,3}\z"))


def spot_checks(spark: SparkSession, chunks: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """doc_id, topic, found, ok: topics with the rules that should be there, a list in code that
    every document is asked. `spark` is not used."""
    wanted = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(r).alias("rule_number")) for t, rules in topics.items() for r in rules])
    pairs = chunks.select("doc_id").distinct().select("doc_id", F.inline(wanted))
    have = chunks.select("doc_id", "rule_number", F.lit(True).alias("has")).distinct()
    return pairs.join(have, ["doc_id", "rule_number"], "left").groupBy("doc_id", "topic").agg(F.array_sort(F.collect_list(F.when(F.col("has"), F.col("rule_number")))).alias("found"), F.coalesce(F.bool_or("has"), F.lit(False)).alias("ok"))
