"""Operations on the total order of a table without a single-task window.

Rows are range-partitioned by the order; each slice is worked through by itself; what the slices before contribute is a
row per slice and is added to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.records import checkpointed


def sliced(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range partitions, numbered in ``_slice``. They are drawn by sampling, so they are fixed by a checkpoint."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], amount: Column, to: str) -> DataFrame:
    """The sum of ``amount`` over all rows up to each, itself included."""
    cut = sliced(df.withColumn("_amount", amount), order)
    before = cut.groupBy("_slice").agg(F.sum("_amount").alias("_sum")).select("_slice", F.coalesce(F.sum("_sum").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_amount").over(W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(before, "_slice").withColumn(to, F.col("_own") + F.col("_before")).drop("_own", "_before", "_slice", "_amount")


def numbered(df: DataFrame, order: list[Column], to: str, start: int = 0) -> DataFrame:
    """Number the rows in their order."""
    return running(df, order, F.lit(1), to).withColumn(to, (F.col(to) - 1 + start).cast("long"))


def runs(df: DataFrame, key: Column, order: list[Column], to: str = "run") -> DataFrame:
    """Number the runs of equal keys that follow each other, from 1; null equals null.

    Within a slice a run begins where the key changes; the first row of a slice is compared with the last of the slice before.
    """
    cut = sliced(df.withColumn("_runkey", key), order)
    w = W.partitionBy("_slice").orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.lag("_runkey").over(w).eqNullSafe(F.col("_runkey"))).cast("int"))
    cut = cut.withColumn("_own", F.sum(changed).over(w.rowsBetween(W.unboundedPreceding, 0)))
    position = F.struct(*order)
    ends = cut.groupBy("_slice").agg(F.max("_own").alias("_most"), F.min_by(F.struct("_runkey"), position)["_runkey"].alias("_first"), F.max_by(F.struct("_runkey"), position)["_runkey"].alias("_last"))
    v = W.orderBy("_slice")
    opens = F.when(F.row_number().over(v) == 1, 1).otherwise((~F.lag("_last").over(v).eqNullSafe(F.col("_first"))).cast("int"))
    ends = ends.withColumn("_opens", opens)
    before = ends.select("_slice", (F.sum("_opens").over(v.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("_most").over(v.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return cut.join(before, "_slice").withColumn(to, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_slice", "_runkey")


def blocks(df: DataFrame, size: int, to: str) -> DataFrame:
    """The rows as they are, numbered in ``to``; partitions hold blocks of ``size`` whole and in their order, and only the last block is shorter."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.withColumn("_slice", F.spark_partition_id()).withColumn(to, F.monotonically_increasing_id()))
    first = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"), F.min(to).alias("_first"))
    before = first.select("_slice", (F.sum("_rows").over(W.orderBy("_slice")) - F.col("_rows") - F.col("_first")).alias("_before"))
    dealt = cut.join(F.broadcast(before), "_slice").withColumn(to, F.col(to) + F.col("_before")).drop("_slice", "_before")
    return dealt.repartitionByRange(parts, F.floor(F.col(to) / size)).sortWithinPartitions(to)
