"""Item catalogues with footprints: spatial filters over bounding boxes, a search service and mosaics of its assets."""

from __future__ import annotations

import json
import shutil
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import align
from . import geotiff
from .storage import stash, unstash

#: The public catalogue of Canada's elevations.
HRDEM = {"url": "https://datacube.services.geo.ca/stac/api/", "collection": "hrdem-mosaic-1m", "asset": "dtm"}
PAGE = 200


def _level(sides: list[Column], cell: float) -> Column:
    """The least level, of cells of ``cell`` times a power of two, at which a box is no larger than a cell."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*sides, F.lit(cell)) / cell))).cast("int")


def overlapping(items: DataFrame, queries: DataFrame, asset: str, cell: float) -> DataFrame:
    """Items (xmin, ymin, xmax, ymax, assets map) that have ``asset`` and overlap a query box (qx0, qy0, qx1, qy1).

    Boxes lie on levels by their size, each with cells twice as large as the one below. Two boxes meet on the level of
    the larger one, where both touch four cells at most: an equi-join, with the bounds as residual filter, in which a
    box has no more rows the larger it is. ``cell`` is the least level's side. Query bounds out of order raise; items
    with null bounds overlap nothing; repeated items and queries do no harm.
    """
    ordered = F.assert_true((F.col("qx0") < F.col("qx1")) & (F.col("qy0") < F.col("qy1")), F.lit("query bounds out of order")).isNull()
    usable = items.where(F.col("assets").isNotNull() & F.element_at("assets", F.lit(asset)).isNotNull())
    boxes = usable.where(" and ".join(f"{k} is not null" for k in ("xmin", "ymin", "xmax", "ymax"))).select("item_id", "xmin", "ymin", "xmax", "ymax").withColumn("_own", _level([F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")], cell))
    asked = queries.where(ordered).select("qx0", "qy0", "qx1", "qy1").withColumn("_own", _level([F.col("qx1") - F.col("qx0"), F.col("qy1") - F.col("qy0")], cell))
    levels = [sorted(r[0] for r in side.select("_own").distinct().collect()) for side in (boxes, asked)]  # a handful

    def listed(side: DataFrame, x: tuple[str, str], y: tuple[str, str], others: list[int], own: str) -> DataFrame:
        """A box under the cells that it touches on its own level and on the other side's larger ones."""
        above = F.filter(F.array(*(F.lit(k) for k in others)).cast("array<int>"), lambda k: k > F.col("_own"))
        put = side.withColumn("_level", F.explode(F.concat(F.array("_own"), above)))
        size = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
        touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
        return put.withColumn("_gx", touched(*x)).withColumn("_gy", touched(*y)).withColumnRenamed("_own", own)

    left = listed(boxes, ("xmin", "xmax"), ("ymin", "ymax"), levels[1], "_item_level")
    right = listed(asked, ("qx0", "qx1"), ("qy0", "qy1"), levels[0], "_query_level")
    inside = (F.col("xmin") < F.col("qx1")) & (F.col("xmax") > F.col("qx0")) & (F.col("ymin") < F.col("qy1")) & (F.col("ymax") > F.col("qy0")) & (F.col("_level") == F.greatest("_item_level", "_query_level"))
    found = left.join(right, ["_level", "_gx", "_gy"]).where(inside).select("item_id").distinct()
    return usable.join(found, "item_id", "left_semi")


def mosaic_layout(assets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The grid of each mosaic: the first asset's resolution over the bounds of all, at least one cell a side."""
    grid = assets.groupBy(*by).agg(F.min_by("res", "ord").alias("res"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    cells = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / F.col("res")))
    return grid.withColumns({"width": cells("xmin", "xmax"), "height": cells("ymin", "ymax")})


@dataclass
class Fetched:
    """A mosaic and what it was made from; a mosaic that this session had already made names no items."""

    source: str
    path: str
    url: str
    collection: str
    asset: str
    items: list[str] = field(default_factory=list)


def _pages(url: str, collection: str, bbox: tuple[float, ...]) -> Iterator[dict]:
    """Answers of a search, following its links to the next page."""
    address, body = urllib.parse.urljoin(url.rstrip("/") + "/", "search"), {"collections": [collection], "bbox": list(bbox), "limit": PAGE}
    while address:
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(address, data, {"Content-Type": "application/json"})) as r:
            page = json.load(r)
        yield page
        link = next((x for x in page.get("links", ()) if x.get("rel") == "next"), {})
        address = link.get("href")
        more = link.get("body", {})
        body = None if link.get("method", "GET").upper() == "GET" else {**body, **more} if link.get("merge") and body else more


def search(url: str, collection: str, bbox: tuple[float, float, float, float], asset: str) -> list[tuple[str, str]]:
    """Identifier and address of ``asset`` of each item whose footprint meets ``bbox`` (degrees), in the service's order.

    No items, or none with the asset, raise.
    """
    items = [i for page in _pages(url, collection, bbox) for i in page.get("features", ())]
    if not items:
        raise LookupError(f"{url} has no items of {collection} in {bbox}")
    found = [(str(i["id"]), i["assets"][asset]["href"]) for i in items if i.get("assets", {}).get(asset, {}).get("href")]
    if not found:
        raise LookupError(f"no item of {collection} in {bbox} has the asset {asset!r}")
    return found


def mosaic_key(crs: Column, bounds: list[Column], url: Column, collection: Column, asset: Column) -> Column:
    """The key of a mosaic: a digest of what it is made from."""
    text = F.concat_ws("|", crs, F.format_string("%.8f,%.8f,%.8f,%.8f", *bounds), url, collection, asset)
    return F.substring(F.sha2(text, 256), 1, 24)


def chosen_nodata(wanted: Column, source: Column) -> Column:
    """The nodata of a mosaic: the depths', else the elevations', else the usual one."""
    return F.coalesce(wanted, source, F.lit(geotiff.DEFAULTS["nodata"]))


#: Mosaics that this session made, by their key.
_MADE: dict[str, str] = {}


def mosaic(spark: SparkSession, depth: str, paths: list[str], out: str, parallel: int | None = None) -> str:
    """Elevations of ``paths`` (shared or HTTP; later ones win) on the extent and system of the raster ``depth``.

    The resolution is the first raster's, in the depths' system. Headers and blocks of the files are read by ranges in
    the tasks; only blocks that may reach into the extent are.
    """
    low = geotiff.catalog(spark, depth).first()
    files = spark.createDataFrame(list(enumerate(paths)), "ord long, raster_id string").repartition(max(1, min(len(paths), 64)), "ord")
    heads = geotiff.ranged_headers(files).distinct().cache()
    rasters = files.join(heads, "raster_id").cache()
    first = rasters.orderBy("ord").first()
    if low["crs"] is None or first["crs"] is None:
        raise ValueError("depths and elevations need a coordinate system")
    left, top, right, bottom = low["c"], low["f"], low["c"] + low["width"] * low["a"], low["f"] + low["height"] * low["e"]
    a, e = first["a"], -first["e"]
    if first["crs"] != low["crs"]:
        corner = [(x, y) for x in (left, right) for y in (top, bottom)]
        there = [tuple(r) for r in geo.reproject(spark.createDataFrame(corner, "x double, y double"), "x", "y", low["crs"], first["crs"]).collect()]
        # the diagonals' ratio, as cells have no size of their own in another system
        a = e = first["a"] * ((right - left) ** 2 + (top - bottom) ** 2) ** 0.5 / ((there[0][0] - there[3][0]) ** 2 + (there[0][1] - there[3][1]) ** 2) ** 0.5
    width, height = (max(1, -int(-d // s)) for d, s in ((right - left - 1e-9 * a, a), (top - bottom - 1e-9 * e, e)))
    grid = {"height": height, "width": width, "a": (right - left) / width, "e": -(top - bottom) / height, "c": left, "f": top, "crs": low["crs"]}
    box = spark.createDataFrame([(left, bottom, right, top)], "xmin double, ymin double, xmax double, ymax double")
    wanted = None
    for crs in {r.crs for r in rasters.select("crs").distinct().collect()}:
        b = geo.reproject_bounds(box, low["crs"], crs).first()
        for r in rasters.where(F.col("crs") == crs).collect():  # one row for each file
            x0, x1, y0, y1 = (b.xmin - r.c) / r.a - 1, (b.xmax - r.c) / r.a + 1, (b.ymax - r.f) / r.e - 1, (b.ymin - r.f) / r.e + 1
            near = (F.col("raster_id") == r.raster_id) & (F.col("x") <= x1) & (F.col("x") + F.col("width") >= x0) & (F.col("y") <= y1) & (F.col("y") + F.col("height") >= y0)
            wanted = near if wanted is None else wanted | near
    cells = geotiff.ranged_cells(heads, parallel or spark.sparkContext.defaultParallelism, wanted)
    merged = align.warp_mosaic(cells, rasters, grid)
    nodata = spark.range(1).select(chosen_nodata(F.lit(low["nodata"]), F.lit(first["nodata"]))).first()[0]
    merged = stash(merged)
    if merged.isEmpty():
        raise LookupError("the elevations have no valid cell on the depths' extent")
    geotiff.write_raster(merged, "value", out, height, width, nodata, grid["a"], grid["e"], left, top, grid["crs"])
    unstash(merged)
    for cached in (rasters, heads):
        cached.unpersist()
    return out


def fetch_hrdem(spark: SparkSession, depth: str, out: str | None, folder: str, url: str = HRDEM["url"], collection: str = HRDEM["collection"], asset: str = HRDEM["asset"]) -> Fetched:
    """Elevations for a raster of depths from a search service; a mosaic that this session made is copied, not made anew."""
    low = geotiff.catalog(spark, depth).first()
    if low["crs"] is None:
        raise ValueError("the depths need a coordinate system to search for elevations")
    bounds = (low["c"], low["f"] + low["height"] * low["e"], low["c"] + low["width"] * low["a"], low["f"])
    key = spark.range(1).select(mosaic_key(F.lit(low["crs"]), [F.lit(b) for b in bounds], F.lit(url), F.lit(collection), F.lit(asset))).first()[0]
    to = str(out or Path(folder) / f"{key}.tif")
    made = _MADE.get(key)
    if made and Path(made).exists():
        if out and Path(out).resolve() != Path(made).resolve():
            Path(out).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(made, out)
        return Fetched("hrdem", to if out else made, url, collection, asset)
    box = spark.createDataFrame([bounds], "xmin double, ymin double, xmax double, ymax double")
    degrees = geo.reproject_bounds(box, low["crs"], "EPSG:4326").first()
    found = search(url, collection, tuple(degrees), asset)
    mosaic(spark, depth, [href for _, href in found], to)
    _MADE[key] = to
    return Fetched("hrdem", to, url, collection, asset, [i for i, _ in found])


#: Sources of elevations by name.
SOURCES = {"hrdem": fetch_hrdem}


def fetch(name: str, *args, **options) -> Fetched:
    """Elevations from the source of that name, whatever its case."""
    source = SOURCES.get(name.strip().lower())
    if source is None:
        raise KeyError(f"no source of elevations {name!r}; there are {sorted(SOURCES)}")
    return source(*args, **options)
