"""Outcome flags of leads, kept up to date from a stream of events: an extension of the batch flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import FLAGS
from ..functions import flag


def flag_updates(events: DataFrame, delay: str = "14 days") -> DataFrame:
    """The flags of each lead so far, for update mode; late copies of an event (one id) within ``delay`` count once."""
    seen = events.withWatermark("event_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    made = [F.max(flag(F.col("event_type") == name)).alias(out) for name, out in FLAGS.items()]
    return seen.groupBy("lead_id").agg(*made, F.min(F.when(F.col("event_type") == "consultation_booked", F.col("event_at"))).alias("booked_at"))


def event_counts(events: DataFrame, width: str = "1 day", delay: str = "14 days") -> DataFrame:
    """(start, event_type, events) by tumbling window, for append mode: a window comes out once no event can be late for it."""
    counts = events.withWatermark("event_at", delay).groupBy(F.window("event_at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "events")


def keep(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge updates into a Parquet table of one row a lead; each batch writes a version of its own, so that a repeated batch is harmless.

    The version before stays, for a repeated batch and for readers; older ones are deleted. A batch costs a pass over the table, so that batches should be large or rare.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{number - 1}"
        at, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (before, f"{path}/v{number - 2}"))
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(at):
            batch = batch.unionByName(spark.read.parquet(before).join(batch.select("lead_id"), "lead_id", "left_anti"))
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        files.delete(old, True)

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
