"""Streaming drift windows over events. An extension: the batch audit has no event time or late data.

The same plan serves a batch and a stream: a stream only adds the watermark, which bounds the state
to the windows that late rows may still reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_drift(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "6 hours", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean and population deviation of ``value`` by time window and key."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "mean", "std")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def resumable_sink(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Appends each micro-batch once: the batch id names its folder, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if trigger_once else q).start()
