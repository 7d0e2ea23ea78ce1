"""Overlapping windows over a grid, feathered weights and mosaics, as relations.

Empty tables give empty results. A repeated cell is covered, weighted and summed once for each of its rows; nulls have no
part in sums. Columns that an operator doesn't name are carried, but for aggregations; names that begin with "_" are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Least weight of a feathered cell and least sum of weights divided by.
LEAST_WEIGHT, LEAST_SUM = 1e-3, 1e-6


def stride_of(tile: int, overlap: int) -> int:
    if not 0 <= overlap < tile:
        raise ValueError(f"overlap must be at least 0 and below the tile {tile}, not {overlap}")
    return tile - overlap


def starts_of(total: Column, tile: int, stride: int) -> Column:
    """Array of window starts along an axis: every ``stride``, and one that ends with the axis."""
    last = total - tile
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))))


def tile_starts(sizes: DataFrame, total: str, tile: int, stride: int) -> DataFrame:
    """Rows of ``sizes`` exploded to (i, start)."""
    return sizes.select("*", F.posexplode(starts_of(F.col(total).cast("long"), tile, stride)).alias("i", "start"))


def window_origins(spark: SparkSession, height: int, width: int, tile: int, stride: int) -> DataFrame:
    """yi, xi, y0, x0 of every window in row-major order, with flags of the scene's first and last ones."""
    size = spark.range(1).select(starts_of(F.lit(height).cast("long"), tile, stride).alias("ys"), starts_of(F.lit(width).cast("long"), tile, stride).alias("xs"))
    rows = size.select("xs", F.size("ys").alias("ny"), F.posexplode("ys").alias("yi", "y0"))
    out = rows.select("yi", "y0", "ny", F.size("xs").alias("nx"), F.posexplode("xs").alias("xi", "x0"))
    first_last = {"first_y": F.col("yi") == 0, "last_y": F.col("yi") == F.col("ny") - 1, "first_x": F.col("xi") == 0, "last_x": F.col("xi") == F.col("nx") - 1}
    return out.withColumns(first_last).select("yi", "xi", "y0", "x0", *first_last)


def feather(i: Column, tile: int, overlap: int, first: Column | bool = False, last: Column | bool = False) -> Column:
    """Weight of cell ``i`` along a window's axis: ramps over the overlaps, 1 between; flat at the scene's outer edges."""
    first, last = (F.lit(x) if isinstance(x, bool) else x for x in (first, last))
    down, up = (tile - i) / (overlap + 1.0), (i + 1) / (overlap + 1.0)
    outer = (first & (i < overlap)) | (last & (i >= tile - overlap))
    ramp = F.when(outer, F.lit(1.0)).when(i >= tile - overlap, down).when(i < overlap, up).otherwise(F.lit(1.0))
    return F.least(F.greatest(ramp, F.lit(LEAST_WEIGHT)), F.lit(1.0))


def covering_windows(cells: DataFrame, windows: DataFrame, tile: int) -> DataFrame:
    """Cells joined with every window that covers them.

    A range join as an equi-join: a window is listed under each bucket of ``tile`` cells it touches (four at most), a
    cell under its own; the bounds are a residual filter. So a cell meets few windows and nothing is a nested loop.
    """
    buckets = lambda k: F.sequence(F.expr(f"{k} div {tile}"), F.expr(f"({k} + {tile} - 1) div {tile}"))
    listed = windows.withColumn("_by", F.explode(buckets("y0"))).withColumn("_bx", F.explode(buckets("x0")))
    keyed = cells.withColumns({"_by": F.expr(f"r div {tile}"), "_bx": F.expr(f"c div {tile}")})
    joined = keyed.join(listed, ["_by", "_bx"]).drop("_by", "_bx")
    return joined.where((F.col("r") >= F.col("y0")) & (F.col("r") < F.col("y0") + tile) & (F.col("c") >= F.col("x0")) & (F.col("c") < F.col("x0") + tile))


def weighted(tiles: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Window cells (r, c, y0, x0 and the edge flags) with their feathered weight ``w``."""
    wy = feather(F.col("r") - F.col("y0"), tile, overlap, F.col("first_y"), F.col("last_y"))
    wx = feather(F.col("c") - F.col("x0"), tile, overlap, F.col("first_x"), F.col("last_x"))
    return tiles.withColumn("w", wy * wx)


def feather_blend(tiles: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of all windows' values at each cell; one aggregation with map-side sums. No weight gives 0."""
    sums = tiles.groupBy(*by, "r", "c").agg(F.sum(F.col(value) * F.col("w")).alias("_v"), F.sum("w").alias("_w"))
    return sums.select(*by, "r", "c", F.when(F.col("_w") > 0, F.col("_v") / F.greatest(F.col("_w"), F.lit(LEAST_SUM))).otherwise(0.0).alias(value))


def hard_mosaic(tiles: DataFrame, values: str = "px", width: int = 32) -> DataFrame:
    """Disjoint tiles (y0, x0, flat pixels) as cells: a projection."""
    cells = tiles.select("y0", "x0", F.posexplode(values).alias("_i", "v"))
    return cells.select((F.col("y0") + F.expr(f"_i div {width}")).alias("r"), (F.col("x0") + F.col("_i") % width).alias("c"), "v")


def numbered(cells: DataFrame, name: str, block: int = 4096) -> DataFrame:
    """Cells numbered from 1 in row-major order; one task sees one number for each ``block`` rows, no more."""
    counts = cells.groupBy("r").agg(F.count("*").alias("_n")).withColumn("_b", F.expr(f"r div {block}"))
    before = lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    blocks = counts.groupBy("_b").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select("_b", before(Window.orderBy("_b")).alias("_earlier"))
    rows = counts.withColumn("_before", before(Window.partitionBy("_b").orderBy("r"))).join(blocks, "_b")
    rows = rows.select("r", (F.col("_before") + F.col("_earlier")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy("c"))
    return cells.withColumn("_k", inside).join(rows, "r").withColumn(name, F.col("_before") + F.col("_k")).drop("_k", "_before")
