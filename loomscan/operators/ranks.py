"""Places in an order over large groups: ranges, counts and offsets, where a window would sort a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.sources.stores import cut


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rn") -> DataFrame:
    """df with each row's place (int, from 1) in its group by an order without ties, nulls placed as the order says.

    Rows are dealt to ranges of (group, order), so a group that holds most rows is spread over many tasks; a range's rows
    are numbered where they are, and the counts of the ranges before (a few rows for each range) are added. The ranges are
    stored first, so that the count and the numbering see the same ones.
    """
    keys = [F.asc_nulls_first(group), *order]
    parts = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    held = cut(parts, "ranges")
    sizes = held.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col(group).alias("__group"), "__part", "__before")
    own = held.withColumn("__rn", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)))
    met = own.join(offsets.withColumnRenamed("__part", "__of"), (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return met.select(*df.columns, (F.col("__rn") + F.col("__before")).cast("int").alias(name))
