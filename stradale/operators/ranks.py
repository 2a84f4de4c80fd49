"""Global ranks without a single-task window.

Rows are dealt out by ranges of their order and sorted within each; the stored parts' row counts, one
number a part, give each part's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored

#: Low bits of monotonically_increasing_id that number the rows of a part.
ROW_BITS = 33


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with the rank of each row, 0 first. Ties need a further column to be told apart."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(spark, dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_id", ROW_BITS))
    # one row a part
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, within + F.col("_before")).drop("_id", "_part", "_before")
