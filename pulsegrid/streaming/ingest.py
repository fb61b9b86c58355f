"""Streaming ingest: the window configuration as watermark, window and dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.units import floor_div
from ..operators import scan


@dataclass(frozen=True)
class WindowConfig:
    """Sizes are Spark interval texts. ``allow_out_of_order`` false drops late rows at once."""

    size: str = "1 hour"
    slide: str | None = None
    offset: str = "0 seconds"
    lateness: str = "10 minutes"
    earliest_n: int | None = None
    allow_out_of_order: bool = True
    drop_same_value: bool = False


def prepared(stream: DataFrame, config: WindowConfig) -> DataFrame:
    """samples(device_id, measure_id, time_n, value) with an event time, late rows and repeats removed."""
    out = stream.withColumn("ts", F.timestamp_micros(floor_div(F.col("time_n"), 1000)))
    if config.earliest_n is not None:
        out = out.where(F.col("time_n") >= config.earliest_n)
    out = out.withWatermark("ts", config.lateness if config.allow_out_of_order else "0 seconds")
    keys = ["device_id", "measure_id", "ts", "time_n"] + ["value"] * config.drop_same_value
    return out.dropDuplicatesWithinWatermark(keys) if out.isStreaming else out.dropDuplicates(keys)


def windowed(samples: DataFrame, config: WindowConfig) -> DataFrame:
    """Counts and means per device, measure and window."""
    w = F.window("ts", config.size, config.slide or config.size, config.offset)
    out = samples.groupBy("device_id", "measure_id", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select("device_id", "measure_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "mean")


def sessions(samples: DataFrame, gap: str) -> DataFrame:
    """Runs of samples with pauses below ``gap``: coverage with a tolerance, as a stream."""
    out = samples.groupBy("device_id", "measure_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("device_id", "measure_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def ingest(stream: DataFrame, dataset, checkpoint: str, on_conflict: str = "last", once: bool = True) -> StreamingQuery:
    """Write a stream of samples to a dataset, a micro-batch at a time.

    A batch is deduplicated in itself and then merged by the dataset's policy, so a
    batch that is run again after a failure changes nothing (``last`` or ``first``).
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "write_seq" in batch.columns else batch.withColumn("write_seq", F.lit(batch_id + 1).cast("long"))
        dataset.write(scan.dedup(rows, ["measure_id", "device_id"]), on_conflict)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
