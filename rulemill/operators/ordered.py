"""Running sums and as-of lookups along groups of any size: a group is cut into ranges of its order, which
tasks share, and what each range needs of those before it is carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranges(df: DataFrame, order: str, parts: int | None = None) -> Column:
    """A number that grows with the numeric column `order`: the range of its values that a row is in, of about
    equal numbers of rows. Nulls are in the first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [1.0], 10_000)).first()[0] or []
    if parts < 2 or not cuts:
        return F.lit(0)
    found = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return F.size(F.filter(found, lambda c: c <= F.col(order)))


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str, ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group that come before by `order` (numeric,
    nulls first) and `ties`; 0 where there are none. A task holds a range of a group; of the ranges before it
    there is one row, their sum."""
    rows = df.withColumns({"_rm_part": ranges(df, order, parts), "_rm_value": F.col(value)})
    sums = rows.groupBy(group, "_rm_part").agg(F.sum("_rm_value").alias("_rm_value"))
    before = F.sum("_rm_value").over(W.partitionBy(group).orderBy("_rm_part").rowsBetween(W.unboundedPreceding, -1))
    heads = sums.select(group, "_rm_part", before.alias("_rm_value"), F.lit(0).alias("_rm_kind"))
    both = rows.withColumn("_rm_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    own = W.partitionBy(group, "_rm_part").orderBy("_rm_kind", order, *ties).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn(out, F.coalesce(F.sum("_rm_value").over(own), F.lit(0))).where("_rm_kind = 1").drop("_rm_part", "_rm_value", "_rm_kind")


def last_before(left: DataFrame, right: DataFrame, group: str, at: str, value: str, parts: int | None = None) -> DataFrame:
    """`left` with `value` of the last row of `right` (group, at, value) in its group whose `at` (numeric) is at
    or before its own; null where there is none. Equal places of `right` count by the larger value.
    Both sides are read and moved once; what reaches a range from those before it is one row."""
    starts = right.select(group, at, F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_rm_seen"), F.lit(1).alias("_rm_kind"))
    asks = left.withColumns({"_rm_seen": F.lit(None).cast(starts.schema["_rm_seen"].dataType), "_rm_kind": F.lit(2)})
    part = ranges(starts.select(at).unionByName(left.select(at)), at, parts)
    starts = starts.withColumn("_rm_part", part)
    last = starts.groupBy(group, "_rm_part").agg(F.max("_rm_seen").alias("_rm_seen"))
    # A carried row for the range behind each that has any, and one for every range that asks.
    wanted = last.unionByName(left.select(group, at).withColumn("_rm_part", part).select(group, "_rm_part").distinct().withColumn("_rm_seen", F.lit(None).cast(last.schema["_rm_seen"].dataType)))
    wanted = wanted.groupBy(group, "_rm_part").agg(F.max("_rm_seen").alias("_rm_seen"))
    carried = wanted.select(group, "_rm_part", F.max("_rm_seen").over(W.partitionBy(group).orderBy("_rm_part").rowsBetween(W.unboundedPreceding, -1)).alias("_rm_seen"), F.lit(0).alias("_rm_kind"))
    both = asks.withColumn("_rm_part", part).unionByName(starts, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    own = W.partitionBy(group, "_rm_part").orderBy(F.when(F.col("_rm_kind") > 0, F.col(at)).asc_nulls_first(), "_rm_kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_rm_found", F.max("_rm_seen").over(own)).where("_rm_kind = 2")
    return found.withColumn(value, F.col("_rm_found")["v"]).drop("_rm_part", "_rm_seen", "_rm_kind", "_rm_found")
