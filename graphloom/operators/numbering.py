"""Global positions and running sums without a single-partition window.

Rows are range-partitioned by the order, numbered inside their partition, and the partitions' totals (one row for
each partition) are summed up and added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import materialize


def laid_out(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, written, with ``loom_part`` and the increasing ``loom_at``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumns({"loom_part": F.spark_partition_id(), "loom_at": F.monotonically_increasing_id()}), "ranges")


def before_each_part(totals: DataFrame, total: str, first: int = 0) -> DataFrame:
    w = W.orderBy("loom_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("loom_base", F.coalesce(F.sum(total).over(w), F.lit(0)) + first)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with the row's place in ``order`` as the bigint ``name``, from ``first``. ``order`` should have no ties."""
    rows = laid_out(df, order)
    totals = rows.groupBy("loom_part").agg(F.min("loom_at").alias("loom_first"), F.count(F.lit(1)).alias("loom_n"))
    base = F.broadcast(before_each_part(totals, "loom_n", first))  # a row for each shuffle partition
    place = F.col("loom_base") + F.col("loom_at") - F.col("loom_first")
    return rows.join(base, "loom_part").select(*df.columns, place.cast("long").alias(name))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before this one as the bigint ``name``."""
    rows = laid_out(df, order)
    own = F.coalesce(F.sum(value).over(W.partitionBy("loom_part").orderBy("loom_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(before_each_part(rows.groupBy("loom_part").agg(F.sum(value).alias("loom_n")), "loom_n").select("loom_part", "loom_base"))
    return rows.withColumn("loom_own", own).join(base, "loom_part").select(*df.columns, (F.col("loom_base") + F.col("loom_own")).cast("long").alias(name))
