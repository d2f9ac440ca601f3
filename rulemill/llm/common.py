"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Rows that a Python worker gets at once while a table is written.
ARROW_ROWS = 1_000

#: Texts that a worker turns into Python strings at once.
SLICE = 256

#: What separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a session whose
    executors are threads of the driver may do without: elsewhere a folder of this machine would
    lose what other machines write."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_dir(context.applicationId)
    return path.rstrip("/")


@contextlib.contextmanager
def _short_batches(spark: SparkSession):
    """Fewer rows than usual to a Python worker at once, until the block ends: batches are bounded
    to 64 MB anyway, but a worker needs several times their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(usual)) if int(usual) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession, wanted: bool):
    """The shuffle files of what runs in the block go when it is done, if that is wanted."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(name)
    spark.conf.set(name, "true" if wanted else usual)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def saved(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """`df` written once to the shared folder and read again: it cuts the lineage, and a
    lost executor costs no more than the tasks that read from it. With `tidy` the shuffles of the
    write leave no files behind, which nothing needs once the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with _short_batches(spark), _brief_shuffles(spark, tidy):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rm_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of `saved` that nothing reads any more."""
    for df in tables:
        if df is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df._rm_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (a written table) marked for broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def told(rows: DataFrame, of: DataFrame, key: str, hot: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` joined to `of`, a written table with one row for each `key` (null is a key too).
    Up to `limit` rows of it are broadcast. Beyond that those that are `hot` are, which the
    caller keeps to so many that their keys have a fair share of the rows each; all others are
    joined by a shuffle, in which no task then gets more than a small share."""
    of = of.withColumnRenamed(key, "_rm_told")
    on = F.col(key).eqNullSafe(F.col("_rm_told"))
    if of.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(of), on).drop("_rm_told")
    few = F.broadcast(of.where(hot))
    rest = rows.join(few.select("_rm_told"), on, "left_anti").join(of.where(~hot), on)
    return rows.join(few, on).drop("_rm_told").unionByName(rest.drop("_rm_told"))


#: Bits of the filter of `may_be_in`: 8 MB, whatever the number of keys.
SIEVE_BITS = 1 << 26


def may_be_in(rows: DataFrame, key: Column, keys: DataFrame, own: Column, name: str) -> DataFrame:
    """`rows` with a boolean `name`: whether `key` may be among `own` of `keys` (both hashes, no
    nulls); false is always right. The filter is a bitmap in parts, which is broadcast: its size is fixed, so with
    very many keys it only says true more often. Wide rows for which it says false needn't move."""
    at = lambda c: F.pmod(c, F.lit(SIEVE_BITS))
    parts = keys.select(at(own).alias("_rm_p")).groupBy(F.bitmap_bucket_number("_rm_p").alias("_rm_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_rm_p")).alias("_rm_bits"))
    place = F.bitmap_bit_position(at(key))
    bits = F.conv(F.hex(F.substring("_rm_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    told = F.coalesce(F.expr("1") == F.pmod(F.floor(bits / F.pow(F.lit(2), place % 8)), F.lit(2)), F.lit(False))
    return rows.join(F.broadcast(parts), F.bitmap_bucket_number(at(key)) == F.col("_rm_b"), "left").withColumn(name, told).drop("_rm_b", "_rm_bits")


def by_text(fn: Callable[[list[str]], list], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function of texts (without nulls): `fn` gets some hundred at a time and gives a
    value for each. A batch stays in Arrow but for these, so a worker never holds it twice."""

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        parts = [pa.array(fn(texts.slice(i, SLICE).to_pylist()), arrow) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return of


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(df[column], F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
