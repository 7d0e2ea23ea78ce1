"""Downscaling of a coarse water surface by cost-distance growth over fine terrain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import depth_of, grown_surface, merge_growth, terrain_cost, wet_partial
from ..sources.storage import stash
from . import arrays, graph
from .align import scale_join
from .graph import keep_anchored, nearest_fill

#: Side of the blocks that are resampled at once.
BLOCK = 256


def grow(coarse: DataFrame, dem: DataFrame, scale: int, height: int, width: int, coarse_limit: float | None = 10, decay: float = 0.001, pixel: float = 1.0) -> DataFrame:
    """r, c, wse, depth and phase (anchor or grown) of the wet cells of the fine grid.

    ``coarse`` has r, c, wse (null: dry), ``dem`` has r, c, z (null: no ground). 1. The surface is resampled to the
    fine grid and kept where it lies above the ground (anchors). 2. Elsewhere it grows from the anchor that is cheapest
    to reach over the terrain, falling by ``decay`` for each unit of distance to the nearest anchor, within
    ``coarse_limit`` coarse cells of one (None: however far). Paths may be as dear as they come. 3. Components without
    an anchor are dropped. Ground without any surface to fill from costs as if the surface lay on it. Empty tables
    give an empty result; cells must be distinct; other columns are left aside.
    """
    limit = None if coarse_limit is None else coarse_limit * scale
    finer = arrays.Grid(height * scale, width * scale, arrays.Axis(0.0, 1 / scale), arrays.Axis(0.0, 1 / scale))

    def resampled(surface: DataFrame) -> DataFrame:
        """Bilinear, from the cells that have a value."""
        return arrays.cells_of(arrays.resample_cells(surface, "wse", arrays.Grid(height, width), finer, BLOCK), "wse").where(~F.isnan("wse"))

    surface = resampled(coarse)
    cells = dem.select("r", "c", "z").join(surface, ["r", "c"], "left")
    cells = stash(cells.select("r", "c", "z", wet_partial(F.col("wse"), F.col("z")).alias("anchor")))
    near = nearest_fill(cells.select("r", "c", "anchor"), "anchor", limit, distinct=True).select("r", "c", F.col("distance").alias("steps"))
    filled = nearest_fill(coarse.select("r", "c", "wse"), "wse", distinct=True)
    smooth = resampled(filled).withColumnRenamed("wse", "smooth")
    priced = cells.join(smooth, ["r", "c"], "left").withColumn("cost", terrain_cost(F.coalesce("smooth", "z"), F.col("z")))
    reached = graph.allocate(priced, "cost", "anchor").select("r", "c", F.col("value").alias("source"))
    joined = cells.join(near, ["r", "c"], "left").join(reached, ["r", "c"], "left")
    grown = grown_surface(F.col("source"), F.col("steps") * pixel, decay)
    wse = merge_growth(F.col("anchor"), grown, F.col("steps"), F.col("z"), limit)
    wet = stash(joined.select("r", "c", "z", wse.alias("wse"), F.when(F.col("anchor").isNotNull(), "anchor").otherwise("grown").alias("phase")).where("wse is not null"))
    kept = keep_anchored(wet, wet.where("phase = 'anchor'")).select("r", "c")
    return wet.join(kept, ["r", "c"], "left_semi").select("r", "c", "wse", depth_of(F.col("wse"), F.col("z")).alias("depth"), "phase")


def anchors_by_scale(cells: DataFrame, coarse: DataFrame, scale: int) -> DataFrame:
    """Fine cells with the coarse surface of their own coarse cell, where it lies above the ground."""
    joined = scale_join(cells, coarse.select("r", "c", "wse"), scale)
    return joined.withColumn("anchor", wet_partial(F.col("wse"), F.col("z")))
