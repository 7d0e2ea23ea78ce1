"""Putting grids on each other: joins on derived cell keys, resampling, padding and windows.

A grid is a DataFrame with the cell keys ``r`` and ``c`` and value columns; further key columns (a raster's or a
tile's id) go in ``by``. Every operator is an equi-join or an aggregation on cell keys, so it shuffles once on them.

Empty tables give empty results; null values are left out of means and count as absent, null keys match nothing. Cells
are distinct: where one is repeated, joins give each of its rows and aggregations count each. Columns that an operator
doesn't name are carried by joins and projections and dropped by aggregations; names that begin with "_" are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo


def scale_join(fine: DataFrame, coarse: DataFrame, scale: int, by: Sequence[str] = ()) -> DataFrame:
    """Each fine cell with the values of the coarse cell it lies in (unmatched fine cells keep nulls)."""
    coarse = coarse.withColumnsRenamed({"r": "_cr", "c": "_cc"})
    keyed = fine.withColumns({"_cr": F.expr(f"r div {scale}"), "_cc": F.expr(f"c div {scale}")})
    return keyed.join(coarse, [*by, "_cr", "_cc"], "left").drop("_cr", "_cc")


def upsample_nearest(coarse: DataFrame, scale: int) -> DataFrame:
    """Every coarse cell as scale x scale fine cells: a projection, without a join."""
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    out = coarse.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return out.withColumns({"r": F.col("r") * scale + F.col("_a"), "c": F.col("c") * scale + F.col("_b")}).drop("_a", "_b")


def resample_nearest(source: DataFrame, targets: DataFrame, scale: float, by: Sequence[str] = ()) -> DataFrame:
    """Target cells with the values of the source cell under their centre; ``scale`` is target cells per source cell."""
    source = source.withColumnsRenamed({"r": "_sr", "c": "_sc"})
    at = lambda k: F.floor((F.col(k) + 0.5) / scale)
    return targets.withColumns({"_sr": at("r"), "_sc": at("c")}).join(source, [*by, "_sr", "_sc"], "left").drop("_sr", "_sc")


def resample_bilinear(source: DataFrame, value: str, scale: int, height: int | Column, width: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """``value`` on a grid ``scale`` times finer, from the four nearest source centres; edges are clamped, nulls left out.

    Each source cell sends its weighted value to the fine cells it touches, so the work is one aggregation with
    map-side sums instead of four joins. ``height`` and ``width`` are the source's.
    """
    edge = {"r": height if isinstance(height, Column) else F.lit(height), "c": width if isinstance(width, Column) else F.lit(width)}
    reach = F.sequence(F.lit(-scale), F.lit(2 * scale - 1))

    def along(k: str) -> tuple[Column, Column]:
        fine = F.col(k) * scale + F.col(f"_{k}")
        place = F.least(F.greatest((fine + 0.5) / scale - 0.5, F.lit(0.0)), (edge[k] - 1).cast("double"))
        return fine, F.greatest(F.lit(0.0), 1 - F.abs(place - F.col(k)))

    spread = source.where(F.col(value).isNotNull()).withColumn("_r", F.explode(reach)).withColumn("_c", F.explode(reach))
    (fr, wr), (fc, wc) = along("r"), along("c")
    inside = (fr >= 0) & (fc >= 0) & (fr < edge["r"] * scale) & (fc < edge["c"] * scale)
    touched = spread.select(*by, fr.alias("r"), fc.alias("c"), (wr * wc).alias("_w"), F.col(value).alias("_v"), inside.alias("_in")).where("_in and _w > 0")
    return touched.groupBy(*by, "r", "c").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(value))


def pad_grid(cells: DataFrame, values: Sequence[str], multiple: int) -> DataFrame:
    """The grid filled up with zeros on the right and at the bottom to multiples of ``multiple``; gaps become 0 too."""
    size = cells.agg(F.coalesce(F.max("r") + 1, F.lit(0)).alias("h"), F.coalesce(F.max("c") + 1, F.lit(0)).alias("w"))
    up = lambda k: F.ceil(F.col(k) / multiple) * multiple
    rows = size.where("h > 0 and w > 0").select(F.explode(F.sequence(F.lit(0), up("h") - 1)).alias("r"), up("w").alias("w"))
    keys = rows.select("r", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("c"))
    return keys.join(cells.select("r", "c", *values), ["r", "c"], "left").fillna(0.0, list(values))


def crop(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.where((F.col("r") < height) & (F.col("c") < width))


def average_pool(cells: DataFrame, value: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, F.expr(f"r div {size}").alias("r"), F.expr(f"c div {size}").alias("c")).agg(F.avg(value).alias(value))


def window_of_bounds(bounds: tuple[float, float, float, float], left: float, top: float, resolution: float) -> tuple[int, int, int, int]:
    """First row and column (rounded down), height and width (rounded half up) of a bounding box (left, bottom, right, top)."""
    x0, y0, x1, y1 = bounds
    if not (x0 < x1 and y0 < y1):
        raise ValueError(f"bounds out of order: {bounds}")
    first = lambda d: int(d // resolution)
    length = lambda d: int(d / resolution + 0.5)
    return first(top - y1), first(x0 - left), length(y1 - y0), length(x1 - x0)


def read_window(cells: DataFrame, row: int, column: int, height: int, width: int) -> DataFrame:
    """Cells of a window, numbered from its corner: a filter. A scene's files are pruned by ``rasters.read_scene`` instead."""
    inside = cells.where(F.col("r").between(row, row + height - 1) & F.col("c").between(column, column + width - 1))
    return inside.withColumns({"r": F.col("r") - row, "c": F.col("c") - column})


def mosaic_last_wins(layers: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """One grid of overlapping layers: the valid value of the latest layer at each cell."""
    valid = layers.where(F.col(value).isNotNull())
    return valid.groupBy(*by, "r", "c").agg(F.max_by(value, order).alias(value))


def grid_cells(spark: SparkSession, height: int, width: int) -> DataFrame:
    """r and c of every cell of a grid."""
    return spark.range(height * width).select(F.expr(f"id div {width}").alias("r"), (F.col("id") % width).alias("c"))


def warp_mosaic(cells: DataFrame, rasters: DataFrame, grid: dict, bucket: int = 256) -> DataFrame:
    """r, c and value of a target grid from rasters on grids and in coordinate systems of their own.

    ``rasters``: ord, raster_id, height, width, a, e, c, f and crs, a short table; ``cells``: raster_id, r, c, value;
    ``grid``: height, width, a, e, c, f and crs of the target. A target cell takes the mean of the valid ones among the
    four source centres around its own, weighted bilinearly, if its centre lies on the raster; where rasters overlap,
    the valid one with the highest ``ord``. Target cells without value have no row. A raster without ``crs`` raises.
    Target cells meet the rasters whose projected bounds touch their bucket, so nothing is a nested loop.
    """
    spark, target = cells.sparkSession, grid["crs"]
    systems = [r.crs for r in rasters.select("crs").distinct().collect()]  # a handful
    if target is None or None in systems:
        raise ValueError("every raster needs a coordinate system")
    points = grid_cells(spark, grid["height"], grid["width"]).withColumns({"_by": F.expr(f"r div {bucket}"), "_bx": F.expr(f"c div {bucket}")})
    columns = ("height", "width", "a", "e", "c", "f")
    own = rasters.select("ord", "raster_id", "crs", *(F.col(k).alias(f"_{k}") for k in columns))
    layers = []
    for crs in systems:
        here = own.where(F.col("crs") == crs)
        boxes = here.withColumns({"xmin": F.col("_c"), "xmax": F.col("_c") + F.col("_width") * F.col("_a"), "ymin": F.col("_f") + F.col("_height") * F.col("_e"), "ymax": F.col("_f")})
        boxes = geo.reproject_bounds(boxes, crs, target)
        rows, columns_ = [(F.col("ymax") - grid["f"]) / grid["e"], (F.col("ymin") - grid["f"]) / grid["e"]], [(F.col("xmin") - grid["c"]) / grid["a"], (F.col("xmax") - grid["c"]) / grid["a"]]
        spans = []
        for (first, last), n in ((rows, grid["height"]), (columns_, grid["width"])):
            spans.append((F.greatest(F.floor(first) - 1, F.lit(0)), F.least(F.floor(last) + 1, F.lit(n - 1))))
        boxes = boxes.where((spans[0][0] <= spans[0][1]) & (spans[1][0] <= spans[1][1]))
        touched = lambda s: F.explode(F.sequence(F.floor(s[0] / bucket), F.floor(s[1] / bucket)))
        listed = boxes.withColumn("_by", touched(spans[0])).withColumn("_bx", touched(spans[1])).drop("xmin", "xmax", "ymin", "ymax")
        centres = points.withColumns({"_x": grid["c"] + (F.col("c") + 0.5) * grid["a"], "_y": grid["f"] + (F.col("r") + 0.5) * grid["e"]})
        met = geo.reproject(centres, "_x", "_y", target, crs).join(listed, ["_by", "_bx"]).drop("_by", "_bx")
        met = met.withColumns({"_x": (F.col("_x") - F.col("_c")) / F.col("_a"), "_y": (F.col("_y") - F.col("_f")) / F.col("_e")})
        layers.append(met.where("_x >= 0 and _y >= 0 and _x < _width and _y < _height").select("ord", "raster_id", "r", "c", "_x", "_y"))
    if not layers:
        return cells.select("r", "c", "value").limit(0)
    met = reduce(DataFrame.unionAll, layers)
    low = {k: F.floor(F.col(k) - 0.5) for k in ("_x", "_y")}
    corner = lambda k, d: (low[k] + d, 1 - F.abs(F.col(k) - 0.5 - low[k] - d))
    corners = F.array(*(F.struct(corner("_y", i)[0].alias("r"), corner("_x", j)[0].alias("c"), (corner("_y", i)[1] * corner("_x", j)[1]).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = met.select("ord", "raster_id", "r", "c", F.explode(corners).alias("_s")).where("_s.w > 0").select("ord", "raster_id", "r", "c", F.col("_s.r").alias("_r"), F.col("_s.c").alias("_c"), F.col("_s.w").alias("_w"))
    source = cells.where("value is not null").select("raster_id", F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
    means = asked.join(source, ["raster_id", "_r", "_c"]).groupBy("ord", "r", "c").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
    return mosaic_last_wins(means, "value", "ord")
