"""A training corpus from raw documents in five stages, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.llm import decontaminate, mixing, quality, secrets, simhash
from rulemill.llm.common import forget, saved, table


#: Documents that a Python worker gets at once. Like any job, the pipeline sizes the batches of
#: the session that it is given; the operators leave settings alone.
BATCH = "500"


def _sized(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null texts are judged as empty ones, rows
    that are repeated each; an empty table stays one."""
    _sized(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts of five-word shingles that resemble
    each other at 0.8 or more, chains included. Null and empty texts are one group; of a group the
    smallest doc_id stays, a null one only alone; repeated rows are duplicates."""
    _sized(spark)
    return simhash.deduplicate(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is of benchmark windows. Null and
    empty texts stay; repeated rows are judged each; an empty benchmark removes nothing."""
    _sized(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew (null texts stay null and
    have a null n_chars). Repeated rows are masked each; an empty table stays one."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words that it takes of each. Texts without words are taken
    nothing of and go; repeated rows each have their own share; a null source is a source."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: The classifier's trees and the fingerprints aren't SQL: tests hold the scores against a scalar
#: walk, the groups against all pairs, the masks and the mix against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. Every stage but the last is written to the shared
    folder and read by the next; the one before is then deleted. Of repeated rows one is left by the
    second stage; an empty table gives one."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "stage")
            forget(before)
            before = docs
    return docs
