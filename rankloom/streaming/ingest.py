"""Records as a stream: each micro-batch is deduped and merged into the snapshot of its date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.snapshot import dedupe
from rankloom.sources.records import write_snapshot


def into_snapshot(stream: DataFrame, path: str, date: str, checkpoint: str):
    """Starts a query that keeps the snapshot of a date current; a batch that is run again gives the same snapshot."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(date).cast("date")).drop("snapshot_date")
            rows = batch.unionByName(old, allowMissingColumns=True)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch
        merged = dedupe(rows)
        merged.write.mode("overwrite").parquet(f"{path}-next")
        write_snapshot(spark.read.parquet(f"{path}-next"), path, date)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, late rows dropped after the watermark; for streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
