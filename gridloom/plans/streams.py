"""Batch runs of the streaming plans: the same functions accept static tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.tiles import wet_counts
from .relations import S, query, snap, table


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (WHERE value / 50 >= 0.7) AS wet, count(*) FILTER (WHERE value / 50 < 0.7) AS dry, {S('avg(value / 50)')} AS mean_depth FROM events GROUP BY 1")
def stream_wet_counts(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select("ts", (F.col("value") / 50).alias("v"))
    return wet_counts(cells, "ts", "v", 0.7).select("start", "wet", "dry", snap("mean_depth").alias("mean_depth"))
