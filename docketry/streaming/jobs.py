"""Structured Streaming: windowed counts of events and the label log's upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.labels import latest


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days", *, time: str = "ts", by: str = "event_type") -> DataFrame:
    """start, ``by``, n in tumbling windows; rows later than ``late`` behind the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def start_label_log(labels: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("qid", "doc")):
    """Appends a stream of labels to the log at ``table``; readers take ``latest``."""

    def append(batch: DataFrame, batch_id: int) -> None:
        latest(batch, *keys).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(table)

    return labels.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
