"""Page layouts, caption costs and the budget of a caption run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.operators.ordered import running_sum

# Prices in USD per million tokens (model, prompt, output).
PRICES = (("gemini-2.5-flash", 0.30, 2.50), ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-pro", 1.25, 10.0))
DEFAULT_MODEL = "gemini-2.5-pro"
# A page is heavy if it meets any row: least drawings, least images, characters
# that it must stay below (None: any), least drawings per 1000 characters.
HEAVY = ((70, 0, None, 0), (0, 8, None, 0), (25, 0, 2000, 15), (35, 0, 1200, 0), (20, 0, 1000, 20), (40, 0, 2800, 12))


def _ratio() -> Column:
    return F.col("drawing_count") / F.greatest(F.col("text_chars"), F.lit(1)) * 1000


def score(df: DataFrame) -> DataFrame:
    """Adds diagram_score and is_heavy to pages with drawing_count, image_count, text_chars."""
    heavy = F.lit(False)
    for drawings, images, below, ratio in HEAVY:
        row = (F.col("drawing_count") >= drawings) & (F.col("image_count") >= images)
        row = row if below is None else row & (F.col("text_chars") < below)
        heavy = heavy | (row & (_ratio() >= ratio) if ratio else row)
    return df.withColumn("diagram_score", F.bround(F.col("drawing_count") + 3 * F.col("image_count") + _ratio(), 2)).withColumn("is_heavy", heavy)


def flag_pages(layout: DataFrame) -> DataFrame:
    return score(layout).where("is_heavy").drop("is_heavy")


def prices(spark: SparkSession, rows=PRICES) -> DataFrame:
    return spark.createDataFrame(list(rows), "model string, prompt_rate double, output_rate double")


def billable_tokens(usage: Column) -> tuple[Column, Column]:
    """Prompt and output tokens of usage (prompt, output, thoughts, total): without output and
    thoughts, what the total has beyond the prompt; no usage at all is 0 and 0."""
    part = lambda name: F.coalesce(usage[name], F.lit(0))
    own = part("output") + part("thoughts")
    return part("prompt"), F.when(own > 0, own).otherwise(F.greatest(part("total") - part("prompt"), F.lit(0)))


def with_cost(usage: DataFrame, prices: DataFrame, default_model: str = DEFAULT_MODEL) -> DataFrame:
    """Adds cost_usd of model, prompt_tokens and output_tokens; unknown and null models cost
    what the default does, which the price list must have. Of a model's several prices the
    highest counts. The list has a row for each model there is and is broadcast."""
    rates = prices.groupBy("model").agg(F.max(F.struct("prompt_rate", "output_rate")).alias("_rate"))
    default = rates.where(F.col("model") == default_model).first()
    if default is None:
        raise ValueError(f"the price list has no row for the default model {default_model}")
    rate = lambda name: F.coalesce(F.col("_rate")[name], F.lit(default["_rate"][name]))
    cost = (F.col("prompt_tokens") * rate("prompt_rate") + F.col("output_tokens") * rate("output_rate")) / 1e6
    return usage.join(F.broadcast(rates), "model", "left").withColumn("cost_usd", cost).drop("_rate")


def apply_budget(df: DataFrame, budget_usd: float = 5.0, run: str = "run_id", order: str = "page") -> DataFrame:
    """Adds status, skip_reason and charged_usd to flagged pages with cost_usd, caption,
    dry_run. In page order a page is skipped once the costs before it reach the budget.
    Costs are never negative, so a prefix sum tells: what comes after the limit is skipped,
    and before it nothing was. A run's pages are shared by tasks (`running_sum`), however many it has."""
    df = running_sum(df, run, order, "cost_usd", "_rm_before")
    before = F.col("_rm_before")
    status = F.when(F.col("dry_run"), "dry_run").when(before >= budget_usd, "budget_exceeded").when(F.coalesce(F.trim("caption"), F.lit("")) == "", "empty_response").otherwise("captioned")
    reason = F.when(F.col("status").isin("budget_exceeded", "empty_response"), F.col("status"))
    df = df.withColumn("status", status).withColumn("skip_reason", reason).drop("_rm_before")
    return df.withColumn("charged_usd", F.when(F.col("status").isin("captioned", "empty_response"), F.col("cost_usd")).otherwise(F.lit(0.0)))


def summarise(pages: DataFrame, budget_usd: float = 5.0, run: str = "run_id") -> DataFrame:
    """A row per run over its scanned pages; `status` is null for pages that weren't flagged."""
    charged = F.col("status").isin("captioned", "empty_response")
    total = F.sum("charged_usd")
    return pages.groupBy(run).agg(
        F.count(F.lit(1)).alias("pages_scanned"), F.count("status").alias("pages_flagged"), F.count_if(F.col("status") == "captioned").alias("pages_captioned"), F.count("skip_reason").alias("pages_skipped"),
        F.coalesce(F.sum(F.when(charged, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(F.when(charged, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.bround(F.coalesce(total, F.lit(0.0)), 6).alias("cost_usd"), F.bround(F.lit(budget_usd) - F.coalesce(total, F.lit(0.0)), 6).alias("budget_left_usd"),
    )
