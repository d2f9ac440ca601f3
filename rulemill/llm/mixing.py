"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, saved, told

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that a bucket of a source's keys is meant to hold; one bucket a source is sorted.
BUCKET_ROWS = 4_000
#: Rows of a source beyond which its share is broadcast, however many sources there are.
HOT_ROWS = 1_000_000
#: Marks of decorated junk; their share lowers a document's quality weight.
MARKS = "#$%&*!|"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.05 as marks fill the text; 1 for null and empty texts."""
    clean = F.length(F.translate(text, MARKS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(clean, F.lit(0.05))), F.lit(1.0))


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and other columns -> the same and target (double).

    The total is `share` of all sizes, shared by weight; a source stops at `cap` times its
    size and the excess goes to the others by weight. One row per source, all in one task, so
    that sources may be some hundred thousand: they are sorted by the level at which they fill
    up, and the level of the rest follows from two prefix sums. Sources without words, and all
    of an empty corpus, have target 0; a null source comes last; no rows, no targets.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = W.orderBy("fills", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("fills", F.lit(cap) * F.col("source_size") / F.col("w")).withColumn("level", level)
    held = F.first(F.when(F.col("level") <= F.col("fills"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.select(*sizes.columns, F.coalesce(F.least(F.col("w") * held, F.lit(cap) * F.col("source_size")), F.lit(cap) * F.col("source_size")).cast("double").alias("target"))


def _weighed(docs: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    """The written table of `docs` with _rm_size, _rm_weight, _rm_key (-ln(u) / weight) and
    _rm_row, which tells repeated rows apart."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))
    return docs.withColumns({"_rm_size": word_count(F.col("text")), "_rm_weight": weight, "_rm_key": -F.log(u) / weight, "_rm_row": F.monotonically_increasing_id()})


def _with_taken(rows: DataFrame, share: float, cap: float, weights: tuple[int, ...], bucket_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Adds size, source_size, target and taken to what `_weighed` gave.

    In each source's order of (key, doc_id, size, row) only the row matters at which the words
    run out: those before it give all their words, those behind it none. So no row moves but
    those of the bucket of keys in which that happens. Buckets are cut where equal shares of
    the source's keys are expected: keys of weight w are exponential with rate w, and the
    weights are counted by steps of a quarter of a doubling.
    """
    own = F.struct(F.col("_rm_key").alias("key"), "doc_id", F.col("_rm_size").alias("size"), F.col("_rm_row").alias("row"))
    step = F.round(4 * F.log2("_rm_weight")).cast("int")
    levels = rows.groupBy("source", step.alias("step")).agg(F.sum("_rm_size").alias("words"), F.count(F.lit(1)).alias("n"), F.avg("_rm_weight").alias("w"))
    sizes = levels.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("step", "w", "n"))).alias("levels"))
    sources = saved(targets(sizes, share, cap, weights), "sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", epochs).withColumn("quota", F.floor("target") - F.col("epochs") * F.col("source_size"))
    hot = F.col("rows") > HOT_ROWS
    buckets = F.ceil(F.col("rows") / F.lit(bucket_rows))
    above = F.aggregate("levels", F.lit(0.0), lambda total, x: total + x["n"] * F.exp(-x["w"] * F.col("_rm_key"))) / F.col("rows")
    keyed = told(rows.select("source", "doc_id", "_rm_key", "_rm_size", "_rm_row"), sources.select("source", "rows", "levels", "quota"), "source", hot, limit)
    keyed = keyed.select("source", "doc_id", "_rm_key", "_rm_size", "_rm_row", "quota", F.greatest(F.lit(0), F.least(buckets - 1, F.floor(buckets * (1 - above)))).alias("bucket"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("_rm_size").alias("words"), F.first("quota").alias("quota"))
    until = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    cut = totals.withColumn("until", until).where(F.col("until") > F.col("quota")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("c"))
    cut = saved(cut.select("source", F.col("c.bucket").alias("at"), F.col("c.before").alias("before")), "cuts")
    last = told(keyed, cut.withColumn("hot", F.lit(False)), "source", F.col("hot"), limit).where(F.col("bucket") == F.col("at"))
    before = F.col("before") + F.coalesce(F.sum("_rm_size").over(W.partitionBy("source").orderBy("_rm_key", "doc_id", "_rm_size", "_rm_row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    border = last.withColumn("before", before).where(F.col("before") + F.col("_rm_size") > F.col("quota")).groupBy("source").agg(F.min(F.struct(own.alias("row"), (F.col("quota") - F.col("before")).alias("rest"))).alias("border"))
    border = saved(border, "borders").withColumnRenamed("source", "s")
    plan = sources.join(border, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.struct("rows", "epochs", "border").alias("_rm_plan"))
    # A source that has words has a border, as less than an epoch is left for it.
    extra = F.when(own < F.col("_rm_plan.border.row"), F.col("_rm_size")).when(own == F.col("_rm_plan.border.row"), F.col("_rm_plan.border.rest")).otherwise(F.lit(0))
    out = told(rows, saved(plan, "plan"), "source", F.col("_rm_plan.rows") > HOT_ROWS, limit)
    taken = (F.col("_rm_plan.epochs") * F.col("_rm_size") + extra).cast("long")
    return out.withColumns({"size": F.col("_rm_size"), "taken": taken}).drop("_rm_size", "_rm_weight", "_rm_key", "_rm_row", "_rm_plan")


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 42, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row.

    Whole epochs of a source come first. What then is left of its target goes to documents in
    the order of -ln(u) / weight, u from a hash of doc_id and `seed`, until the words are
    used up; the document at the border gives its first words. So a source's taken words are
    its target rounded down, and reruns agree. Null texts have no words and take none; a null
    source is a source of its own; rows of equal key go by doc_id and size, repeated rows in the
    order in which they were read; an empty table gives no rows; other columns are left out.
    `weight` (> 0) defaults to `quality_weight`.
    """
    rows = _weighed(docs.select("doc_id", "source", "text"), weight, seed)
    return _with_taken(saved(rows.drop("text"), "sizes"), share, cap, weights, bucket_rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, weight: Column | None = None, seed: int = 42, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `docs` that the mix takes words of, with size, source_size, target and taken
    as `mix` has them: `taken` counts whole epochs first and then the text's first words. Rows
    that are repeated as a whole each have their own share. Other columns stay, those named as a
    result are replaced. `docs` is written once, so that rows are the same in all passes."""
    results = ("size", "source_size", "target", "taken")
    rows = saved(_weighed(docs.drop(*results), weight, seed), "weighed")
    return _with_taken(rows, share, cap, weights, bucket_rows).where("taken > 0").select(*[c for c in docs.columns if c not in results], *results)
