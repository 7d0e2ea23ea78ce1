"""Structured Streaming over cells: windows of arriving depth cells, and batch plans applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def wet_counts(cells: DataFrame, time: str, value: str, threshold: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Wet and dry cells and the mean depth of each event-time window; cells later than ``late`` are dropped by the watermark."""
    wet = F.col(value) >= threshold
    grouped = cells.withWatermark(time, late).groupBy(F.window(time, window))
    return grouped.agg(F.count_if(wet).alias("wet"), F.count_if(~wet).alias("dry"), F.avg(value).alias("mean_depth")).select(F.col("window.start").alias("start"), "wet", "dry", "mean_depth")


def latest_cells(cells: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Cells (r, c) once each for an event time, whatever repeats arrive within the watermark."""
    return cells.withWatermark(time, late).dropDuplicatesWithinWatermark(["r", "c", time])


def apply_to_batches(cells: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs a batch plan (such as a super-resolution) on every micro-batch and writes its rows under ``path``.

    Each batch has a folder of its own, overwritten when a batch is repeated after a failure: exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
