"""Places in an order over all rows, which no task has to sort or number alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.sources.shared import stored


def placed(rows: DataFrame, into: str, *order: str | Column) -> DataFrame:
    """The rows with their place, from 1, in this order; rows that are equal in it are in either one.

    Rows are range-partitioned and kept; a row's place is its place in its partition and the sizes of
    the partitions before it, of which there are as many as tasks.
    """
    kept = stored(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    parts = kept.groupBy(F.shiftright("_m", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = parts.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a task
    joined = kept.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(before), "_part")
    return joined.withColumn(into, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_part", "_before")
