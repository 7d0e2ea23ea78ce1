"""Tile-local normalisation of elevations.

Empty tables give empty results. Repeated cells count once for each row, nulls in no statistic, and give a null. Further
columns are carried by ``normalize_tiles``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, dem_to_unit


def check_stats(stats: Mapping[str, float]) -> tuple[float, float, float]:
    """p_clip, dem_min and dem_max of given statistics, or ValueError."""
    if missing := {"p_clip", "dem_min", "dem_max"} - set(stats):
        raise ValueError(f"missing statistics: {sorted(missing)}")
    p, low, high = (float(stats[k]) for k in ("p_clip", "dem_min", "dem_max"))
    if not all(map(math.isfinite, (p, low, high))) or p < 0 or high <= low:
        raise ValueError(f"unusable statistics: {dict(stats)}")
    return p, low, high


def usable_stats(p: Column, low: Column, high: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(p) & finite(low) & finite(high) & (p >= 0) & (high > low)


def tile_stats(cells: DataFrame, z: str, by: Sequence[str], percent: float = 95.0) -> DataFrame:
    """p_clip (exact percentile of elevations from 0 up), dem_min and dem_max of each tile."""
    if not (math.isfinite(percent) and 0 < percent <= 100):
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    bounded = clamp(F.col(z), 0)
    grouped = cells.groupBy(*by).agg(F.percentile(bounded, percent / 100).alias("p_clip"), F.min(bounded).alias("_low"), F.max(bounded).alias("_high"))
    return grouped.select(*by, "p_clip", F.least("_low", "p_clip").alias("dem_min"), F.least("_high", "p_clip").alias("dem_max"))


def normalize_tiles(cells: DataFrame, z: str, by: Sequence[str], percent: float = 95.0, stats: DataFrame | None = None) -> DataFrame:
    """Cells with ``z_unit``, by their own tile's statistics or by given ones."""
    stats = tile_stats(cells, z, by, percent) if stats is None else stats
    return cells.join(stats, list(by)).withColumn("z_unit", dem_to_unit(F.col(z), F.col("p_clip"), F.col("dem_min"), F.col("dem_max")))


def summarize_stats(stats: DataFrame) -> DataFrame:
    span = F.col("dem_max") - F.col("dem_min")
    named = {f"{n}_{k}": f(c) for n, c in (("dem_p_clip", F.col("p_clip")), ("dem_range", span)) for k, f in (("min", F.min), ("mean", F.avg), ("max", F.max))}
    return stats.agg(F.count("*").alias("tile_count"), *(c.alias(n) for n, c in named.items()))
