"""Places by ranges against a window, with a group that holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomscan.operators.ranks import ranked


def test_ranks_by_ranges_equal_a_window(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 == 7, None).otherwise("small").alias("g"), F.when(F.col("id") % 13 != 0, F.xxhash64("id") % 100).alias("v"), "id")
    order = [F.desc_nulls_first("v"), F.asc("id")]
    got = {tuple(r) for r in ranked(df, "g", order).collect()}
    want = {tuple(r) for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert got == want and len(got) == 5000
    assert ranked(df.limit(0), "g", order).count() == 0
