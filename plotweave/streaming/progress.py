"""Progress events of runs, in batch and as a stream: late lower values never show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monotone(events: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("ts",), value: str = "progress") -> DataFrame:
    """Events above all that came before them in their run."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_before", F.max(value).over(w)).where(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")


def highest(events: DataFrame) -> DataFrame:
    """Streaming state: the highest progress of each run so far, one value a run (output mode update)."""
    return events.groupBy("run_id").agg(F.max("progress").alias("progress"), F.max("ts").alias("ts"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Highest progress a run reaches in each window; the watermark bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "run_id").agg(F.max("progress").alias("progress"), F.count(F.lit(1)).alias("events"))


def fan_out(events: DataFrame, sinks: dict, checkpoint: str):
    """Starts a query that gives each micro-batch to all sinks (name -> function of a DataFrame).

    A batch that is repeated after a failure has the same number, which sinks can use to ignore it.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for sink in sinks.values():
            sink(batch, number)
        batch.unpersist()

    return highest(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(deliver).start()
