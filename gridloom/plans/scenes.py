"""Super-resolution of raster files from end to end: checks, clipping, the model's own scale, output."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import arrays, validate
from ..operators.normalize import check_stats
from ..operators.predict import Predictor
from ..sources import ascii, geotiff, registry

log = logging.getLogger("gridloom")

#: Tolerance between the bounds of depths and of elevations cut to them, in units of their system.
BOUNDS = 1e-6
#: Options where neither the caller nor the model's sidecar states them.
MAX_DEPTH, PERCENT, TILE = 5.0, 95.0, 32
#: A model's sidecar: this file in its folder.
SIDECAR = "train_config.json"
#: Cells that a task reads, about.
READ_CELLS = 1 << 22


class Placement(NamedTuple):
    """Both grids, the window of the elevations' file that covers the depths, and the output's georeference."""

    coarse: arrays.Grid
    fine: arrays.Grid
    row: int
    column: int
    crs: str | None

    @property
    def ratio(self) -> float:
        """Fine cells along a coarse one."""
        return abs(self.coarse.columns.step / self.fine.columns.step)


class Options(NamedTuple):
    max_depth: float
    percent: float
    stats: dict | None
    tile: int | None
    scale: int | None
    resolution: float


def options(model: str | Path | None = None, max_depth: float | None = None, percent: float | None = None) -> Options:
    """Given options first, then those of the model's sidecar, then the usual ones.

    The sidecar's statistics count if it has all three; its tile is the first side of ``input_shape``.
    """
    file = Path(model).expanduser().parent / SIDECAR if model else None
    said = json.loads(file.read_text()) if file and file.is_file() else {}
    first = lambda given, key, usual: float(given if given is not None else usual if said.get(key) is None else said[key])
    stats = said.get("dem_stats") or {}
    whole = {"p_clip", "dem_min", "dem_max"} <= stats.keys()
    side = (said.get("input_shape") or [None])[0]
    return Options(
        first(max_depth, "max_depth", MAX_DEPTH),
        first(percent, "dem_pct_clip", PERCENT),
        dict(zip(("p_clip", "dem_min", "dem_max"), check_stats(stats), strict=True)) if whole else None,
        int(side) if isinstance(side, int | float) and float(side).is_integer() else None,
        None if said.get("upscale") is None else int(said["upscale"]),
        registry.dem_resolution(str(said.get("dem_fp") or "")),
    )


def place(spark: SparkSession, low: dict, high: dict) -> Placement:
    """Checks two rasters' headers against each other and cuts the elevations to the depths' bounds.

    The elevations need a projected system; depths without one are taken to be in it. Elevations that reach further
    are clipped, with a warning; they must cover the depths, whose bounds must lie on edges of their cells.
    """
    bounds = lambda g: {"xmin": g["c"], "xmax": g["c"] + g["width"] * g["a"], "ymin": g["f"] + g["height"] * g["e"], "ymax": g["f"]}
    sides = {"lr": low, "hr": high}
    row = {f"{k}_{s}": v for s, g in sides.items() for k, v in (("bands", 1), ("crs", g["crs"]), ("projected", g["crs"] is not None and geo.is_projected(g["crs"])), ("a", g["a"]), ("e", g["e"]))}
    schema = ", ".join(f"{k} {'int' if k.startswith('bands') else 'string' if k.startswith('crs') else 'boolean' if k.startswith('projected') else 'double'}" for k in row)
    pair = spark.createDataFrame([tuple(row.values())], schema)
    for s, g in sides.items():
        pair = pair.withColumn(f"bounds_{s}", F.struct(*(F.lit(float(v)).alias(k) for k, v in bounds(g).items())))
    found = validate.grid_compatibility(pair).first()
    if found["verdict"] != "ok":
        raise ValueError({"crs": f"the rasters' coordinate systems differ: {low['crs']} and {high['crs']}", "no crs": "the elevations have no coordinate system", "geographic": f"the coordinate system must be projected, not {high['crs']}"}.get(found["verdict"], found["verdict"]))
    if found["inherits_crs"]:
        log.warning("the depths have no coordinate system; the elevations' %s is taken", high["crs"])
    if not found["square"]:
        log.warning("the elevations' cells aren't square: %s x %s", high["a"], high["e"])
    if found["clip"]:
        log.warning("the rasters' bounds differ; elevations are clipped to the depths")
    edge = lambda g, k, n: g["f"] + n * g["e"] if k == "e" else g["c"] + n * g["a"]
    spans = []
    for k, n, name in (("e", "height", "rows"), ("a", "width", "columns")):
        first = round((edge(low, k, 0) - edge(high, k, 0)) / high[k])
        size = round(low[n] * low[k] / high[k])
        if first < 0 or size < 1 or first + size > high[n]:
            raise ValueError(f"the elevations don't cover the depths: {name} {first} to {first + size} of {high[n]}")
        if abs(edge(high, k, first) - edge(low, k, 0)) > BOUNDS or abs(edge(high, k, first + size) - edge(low, k, low[n])) > BOUNDS:
            raise ValueError(f"the depths' bounds must lie on edges of the elevations' cells ({name})")
        spans.append((first, size))
    (row_, height), (column, width) = spans
    return Placement(
        arrays.Grid(low["height"], low["width"], arrays.Axis(low["f"], low["e"]), arrays.Axis(low["c"], low["a"])),
        arrays.Grid(height, width, arrays.Axis(edge(high, "e", row_), high["e"]), arrays.Axis(edge(high, "a", column), high["a"])),
        row_,
        column,
        high["crs"],
    )


def is_text(path: str) -> bool:
    return path.lower().endswith(".asc")


def read(spark: SparkSession, path: str, row: int, column: int, height: int, width: int) -> DataFrame:
    """r, c and value of a window of a file, of which no other blocks are read; nodata is null, other NaN stays (text has none)."""
    if is_text(path):
        cells = ascii.read_cells(spark, path)
    elif geotiff.is_ranged(path):
        touched = (F.col("y") < row + height) & (F.col("y") + F.col("height") > row) & (F.col("x") < column + width) & (F.col("x") + F.col("width") > column)
        tasks = max(1, min(10_000, height * width // READ_CELLS + spark.sparkContext.defaultParallelism))
        cells = geotiff.ranged_cells(spark.createDataFrame([(path,)], "raster_id string"), tasks, touched, keep_nan=True)
    else:
        cells = geotiff.read_cells(spark, path, keep_nan=True)
    inside = cells.where(F.col("r").between(row, row + height - 1) & F.col("c").between(column, column + width - 1))
    return inside.select((F.col("r") - row).alias("r"), (F.col("c") - column).alias("c"), "value")


def header(spark: SparkSession, path: str) -> dict:
    if is_text(path):
        return ascii.headers(spark, path).first().asDict()
    if geotiff.is_ranged(path):
        return geotiff.ranged_headers(spark.createDataFrame([(path,)], "raster_id string")).first().asDict()
    return geotiff.catalog(spark, path).first().asDict()


def super_resolve(spark: SparkSession, depth: str, dem: str, placed: Placement, predictor: Predictor, tile: int, overlap: int, max_depth: float = MAX_DEPTH, percent: float = PERCENT) -> DataFrame:
    """Tile arrays of fine depths on the elevations' grid, cut to the depths' bounds; ``placed`` is from ``place``.

    Depths must be finite and at least 0, elevations finite; nodata counts as 0 on both sides.
    """
    low = read(spark, depth, 0, 0, placed.coarse.height, placed.coarse.width)
    high = read(spark, dem, placed.row, placed.column, placed.fine.height, placed.fine.width)
    group = max(2, 512 // (tile * predictor.scale))
    return arrays.super_resolve(low, high, placed.coarse, placed.fine, predictor, tile, overlap, max_depth, percent, group=group, sound=True)


def write(scene: DataFrame, placed: Placement, out: str) -> str:
    """Writes tile arrays as one file (text if it is named so), or, where ``out`` ends in a slash, as a scene of tiles; checks what was written."""
    cells = arrays.cells_of(scene, "depth")
    where = {"a": placed.fine.columns.step, "e": placed.fine.rows.step, "c": placed.fine.columns.origin, "f": placed.fine.rows.origin, "crs": placed.crs}
    if out.endswith("/"):
        log.info("%d tiles", geotiff.write_tiles(cells, "depth", out, **where).count())
        return out
    if is_text(out):
        ascii.write_raster(cells, "depth", out, placed.fine.height, placed.fine.width, **{k: v for k, v in where.items() if k != "crs"})
        found = header(scene.sparkSession, out)
    else:
        geotiff.write_raster(cells, "depth", out, placed.fine.height, placed.fine.width, **where)
        found = geotiff.header(geotiff.Ranged(out))
    if (found["height"], found["width"]) != placed.fine[:2] or any(abs(found[k] - where[k]) > BOUNDS for k in "aecf"):
        raise ValueError(f"what was written to {out} has another extent or place")
    return out
