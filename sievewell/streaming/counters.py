"""Counters over a stream: sums of deltas by key and tumbling slice, in bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slices(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Sums of delta by group, counter and slice of `width`. Rows later than `late` are dropped, which keeps the state bounded."""
    return stream.withWatermark("ts", late).groupBy("group_id", "counter_id", F.window("ts", width).alias("w")).agg(F.sum("delta").alias("count"))


def run_available(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is. Each micro-batch appends its updates under its number, so a repeated batch changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("group_id", "counter_id", F.col("w.start").alias("start"), "count")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last update of each slice."""
    newest = Window.partitionBy("group_id", "counter_id", "start").orderBy(F.desc("batch"))
    rows = spark.read.parquet(path)
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")


def apply_updates(verdicts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hook for a stream of verdicts: hands each micro-batch's counter updates, one row each, to `sink`."""
    updates = verdicts.filter("group_id IS NOT NULL").select("group_id", F.explode("counter_updates").alias("u")).select("group_id", "u.*")
    return updates.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
