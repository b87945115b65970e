"""Places and running sums over a whole table, without a task that sees all of it.

Rows are ranged by their order into partitions, each partition is counted or
summed, and the sums of those before it (one number for each partition) are added
to a window within the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.shared import kept


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with ``name``: the sum of a value (a bigint) up to each row. Rows that are equal in ``order`` come in any order."""
    ranged = kept(rows.withColumn("_v", value.cast("bigint")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum("_v").alias("_s"))
    before = parts.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))  # a row for each partition
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.sum("_v").over(w) + F.col("_before")).drop("_v", "_part", "_before")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place, from 1."""
    return running(rows, order, F.lit(1), name)
