import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import align
from gridloom.sources import geotiff

#: Known places: longitude, latitude, system, x, y.
PLACES = [
    (9.0, 0.0, "EPSG:32632", 500000.0, 0.0),
    (3.0, 0.0, "EPSG:32631", 500000.0, 0.0),
    (-95.0, 49.0, "EPSG:3979", 0.0, 0.0),
    (180.0, 0.0, "EPSG:3857", 20037508.342789244, 0.0),
]


def project(spark, lon, lat, crs):
    return geo.reproject(spark.createDataFrame([(lon, lat)], "x double, y double"), "x", "y", "EPSG:4326", crs).first()


@pytest.mark.parametrize("lon, lat, crs, x, y", PLACES)
def test_places(spark, lon, lat, crs, x, y):
    got = project(spark, lon, lat, crs)
    assert abs(got.x - x) < 1.0 and abs(got.y - y) < 1.0


def test_transverse_mercator(spark):
    """Its central meridian is 0.9996 of the ellipsoid's arc, and it is conformal: that leaves one such map."""
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    for lat in (-35.0, 10.0, 48.0, 80.0):
        steps = (np.arange(200_000) + 0.5) / 200_000 * np.radians(lat)
        arc = (geo.AXIS * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5).sum() * np.radians(lat) / 200_000
        assert abs(project(spark, 15.0, lat, "EPSG:32633").y - 0.9996 * arc) < 1e-3
        d = 1e-4
        at = [project(spark, 13.0 + i * d, lat + j * d, "EPSG:32633") for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        s = np.sin(np.radians(lat))
        parallel = np.cos(np.radians(lat)) / np.sqrt(1 - e2 * s**2)
        meridian = (1 - e2) / (1 - e2 * s**2) ** 1.5
        east, north = ((a.x - b.x, a.y - b.y) for a, b in (at[:2], at[2:]))
        assert abs(east[0] / parallel - north[1] / meridian) < 1e-3 and abs(east[1] / parallel + north[0] / meridian) < 1e-3


def test_conic_keeps_its_parallels(spark):
    """Along a standard parallel the conic's scale is 1: a thousandth of a degree is as long as on the ellipsoid."""
    for lat in (49.0, 77.0):
        a, b = project(spark, -80.0, lat, "EPSG:3979"), project(spark, -79.999, lat, "EPSG:3979")
        e2 = geo.FLATTENING * (2 - geo.FLATTENING)
        length = np.radians(0.001) * geo.AXIS * np.cos(np.radians(lat)) / np.sqrt(1 - e2 * np.sin(np.radians(lat)) ** 2)
        assert abs(np.hypot(a.x - b.x, a.y - b.y) / length - 1) < 1e-7


@pytest.mark.parametrize("crs, lon", [("EPSG:32633", 13.2), ("EPSG:32755", 148.1), ("EPSG:3979", -70.0), ("EPSG:3857", 13.0), ("EPSG:4326", 5.0), ("EPSG:25832", 11.5), ("EPSG:2169", 6.1)])
def test_there_and_back(spark, crs, lon):
    points = spark.createDataFrame([(lon + i / 3, lat) for i in range(4) for lat in (-60.0, -10.0, 0.0, 45.5, 71.25)], "lon double, lat double")
    there = geo.reproject(points.select("lon", "lat", F.col("lon").alias("x"), F.col("lat").alias("y")), "x", "y", "EPSG:4326", crs)
    back = geo.reproject(there, "x", "y", crs, "EPSG:4326")
    worst = back.agg(F.max(F.abs(F.col("x") - F.col("lon"))), F.max(F.abs(F.col("y") - F.col("lat")))).first()
    assert max(worst) < (1e-9 if crs != "EPSG:2169" else 5e-8)  # a shift at height 0 comes back some millimetres off


def test_unknown_systems(spark):
    for crs in ("EPSG:2170", "4326", "EPSG:x"):
        with pytest.raises(ValueError):
            geo.reproject(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y", "EPSG:4326", crs)


def test_bounds(spark):
    boxes = spark.createDataFrame([(1, -100.0, 50.0, -90.0, 60.0), (2, None, 50.0, -90.0, 60.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    whole, empty = geo.reproject_bounds(boxes, "EPSG:4326", "EPSG:3979").orderBy("id").collect()
    middle = project(spark, -95.0, 50.0, "EPSG:3979")
    corner = project(spark, -100.0, 50.0, "EPSG:3979")
    assert abs(whole.ymin - middle.y) < 200 and whole.ymin < corner.y and abs(whole.xmin + whole.xmax) < 1e-6
    assert empty.id == 2 and geo.reproject_bounds(boxes.limit(0), "EPSG:4326", "EPSG:3979").count() == 0


def test_boxes_of_one_file_are_dealt_over_tasks(spark):
    """A file of boxes is one task's; their edges' points are many. Rows that repeat a box stay, with all their columns."""
    boxes = spark.range(40, numPartitions=1).selectExpr("cast(id div 2 as string) as name", "5.7 + id div 2 / 100 as xmin", "49.4D as ymin", "5.8 + id div 2 / 100 as xmax", "49.5D as ymax", "array(id) as ids")
    out = geo.reproject_bounds(boxes, "EPSG:4326", "EPSG:2169")
    assert out.columns == boxes.columns and out.rdd.getNumPartitions() > 1
    rows = sorted(out.collect(), key=lambda r: r.ids)
    assert [(r.name, r.ids) for r in rows] == [(str(k // 2), [k]) for k in range(40)]
    assert all(rows[k][1:5] == rows[k + 1][1:5] for k in range(0, 40, 2)) and rows[0].xmin < rows[2].xmin


def test_files_with_a_system(spark, tmp_path):
    a = np.random.default_rng(3).random((70, 33)).astype(np.float32)
    for crs in ("EPSG:32633", "EPSG:4326", None):
        data = geotiff.encode(a, 2.0, -2.0, 5.0, 9.0, -9999.0, crs=crs)
        assert np.array_equal(a, geotiff.decode(data)[0]) and geotiff.header(data)["crs"] == crs


@pytest.mark.parametrize("large", [False, True])
def test_large_offsets(monkeypatch, large):
    monkeypatch.setattr(geotiff, "LARGE", 0 if large else 10**9)
    a = np.random.default_rng(4).random((50, 21)).astype(np.float32)
    data = geotiff.encode(a, nodata=-1.5, rows=7, crs="EPSG:3979")
    back, grid = geotiff.decode(data)[0], geotiff.header(data)
    assert np.array_equal(a, back) and grid["nodata"] == -1.5 and grid["crs"] == "EPSG:3979" and data[2] == (43 if large else 42)


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", "<u2", ">i4"])
def test_predictors(kind):
    values = (np.random.default_rng(5).random((9, 12)) * 1000).astype(kind)
    if values.dtype.kind == "f":
        size = values.dtype.itemsize
        planes = values.astype(f">f{size}").view(np.uint8).reshape(9, 12, size).transpose(0, 2, 1).reshape(9, -1)
        held, predictor = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 3
    else:
        held, predictor = np.diff(values, axis=1, prepend=values.dtype.type(0)).astype(kind).tobytes(), 2
    block = {"compression": 1, "dtype": kind, "stride": 12, "predictor": predictor, "height": 9, "width": 12}
    assert np.array_equal(geotiff.unpack(held, block), values)


def test_written_by_strips_and_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geotiff, "STRIP_CELLS", 70)
    cells = spark.range(40).select((F.col("id") % 10 * 3).alias("r"), (F.col("id") * 7 % 11).alias("c"), F.col("id").cast("double").alias("v")).dropDuplicates(["r", "c"])
    want = np.full((30, 11), -9999.0)
    for row in cells.collect():
        want[row.r, row.c] = row.v
    place = {"a": 2.0, "e": -2.0, "c": 10.0, "f": 90.0, "crs": "EPSG:32633"}
    cells = spark.createDataFrame([(int(r), int(c), float(want[r, c])) for r, c in zip(*np.nonzero(want != -9999.0), strict=True)], "r long, c long, v double")
    path = geotiff.write_raster(cells, "v", str(tmp_path / "out" / "x.tif"), 30, 11, **place)
    data = (tmp_path / "out" / "x.tif").read_bytes()
    values, grid = geotiff.decode(data)[0], geotiff.header(data)
    assert np.array_equal(values, want) and {k: grid[k] for k in place} == place and not list((tmp_path / "out").glob("*.part"))
    tiles = geotiff.write_tiles(cells, "v", str(tmp_path / "tiles"), 8, **place).collect()
    seen = np.full((30, 11), -9999.0)
    for t in tiles:
        part, g = geotiff.decode(open(t.path, "rb").read())
        assert (g["c"], g["f"]) == (10.0 + t.tile_col * 16, 90.0 - t.tile_row * 16) and part.shape == (t.height, t.width)
        seen[t.tile_row * 8 : t.tile_row * 8 + t.height, t.tile_col * 8 : t.tile_col * 8 + t.width] = part
    assert np.array_equal(seen, want)
    ranged = geotiff.ranged_cells(spark.createDataFrame([(path,)], "raster_id string"), 3)
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, geotiff.read_cells(spark, path).withColumn("raster_id", F.lit(path)).collect()))
    some = geotiff.ranged_cells(spark.createDataFrame([(path,)], "raster_id string"), 3, F.col("y") < 12)
    assert 11 <= some.agg(F.max("r")).first()[0] < 18
    assert geotiff.ranged_headers(spark.createDataFrame([(path,)], "raster_id string")).first().height == 30
    empty = geotiff.write_raster(cells.limit(0), "v", str(tmp_path / "none.tif"), 5, 4)
    assert (geotiff.decode(open(empty, "rb").read())[0] == -9999.0).all()


def test_warp(spark):
    """Elevations that are linear in longitude and latitude stay so on another system's grid; the latest raster wins."""
    n = 60
    place = {"a": 0.01, "e": -0.01, "c": 12.0, "f": 48.0}
    rows, columns = np.mgrid[0:n, 0:n]
    ground = (12 + (columns + 0.5) * 0.01) * 10 + (48 - (rows + 0.5) * 0.01)
    cells = [("a", int(r), int(c), float(ground[r, c])) for r in range(n) for c in range(n)] + [("b", int(r), int(c), -5.0 if c < 10 else None) for r in range(n) for c in range(n)]
    rasters = spark.createDataFrame([(k, name, n, n, *place.values(), "EPSG:4326") for k, name in enumerate("ab")], "ord int, raster_id string, height int, width int, a double, e double, c double, f double, crs string")
    cells = spark.createDataFrame(cells, "raster_id string, r long, c long, value double")
    west, north = project(spark, 12.2, 47.8, "EPSG:32633")
    grid = {"height": 20, "width": 30, "a": 500.0, "e": -500.0, "c": west, "f": north, "crs": "EPSG:32633"}
    got = align.warp_mosaic(cells, rasters, grid, bucket=8).collect()
    centres = align.grid_cells(spark, 20, 30).withColumns({"x": west + (F.col("c") + 0.5) * 500.0, "y": north - (F.col("r") + 0.5) * 500.0})
    want = {(r.r, r.c): r.x * 10 + r.y for r in geo.reproject(centres, "x", "y", "EPSG:32633", "EPSG:4326").collect()}
    assert len(got) == 600 and all(abs(r.value - want[r.r, r.c]) < 1e-6 for r in got)
    same = align.warp_mosaic(cells, rasters, {"height": n, "width": n + 3, **place, "crs": "EPSG:4326"}).collect()
    assert len(same) == n * n and all(r.value == -5.0 if r.c < 10 else abs(r.value - ground[r.r, r.c]) < 1e-9 for r in same)
    with pytest.raises(ValueError):
        align.warp_mosaic(cells, rasters, {**grid, "crs": None})


def test_ranges():
    with pytest.raises(ValueError):
        geotiff.header(b"II")
    out = io.BytesIO()
    geotiff.write_strips(out, [geotiff.strip(np.ones((2, 3)))], 2, 3, 2)
    assert geotiff.header(out.getvalue())["width"] == 3


def helmert(lon, lat, from_, to, shift):
    """By the earth's centre and fixed-point iteration."""
    e2 = from_[1] * (2 - from_[1])
    n = from_[0] / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    at = np.array([n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat)])
    x, y, z = shift(at)
    e2, p, phi = to[1] * (2 - to[1]), math.hypot(x, y), lat
    for _ in range(50):
        n = to[0] / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        phi = math.atan2(z + e2 * n * math.sin(phi), p)
    return math.atan2(y, x), phi


def test_luxembourg(spark):
    """Datum and grid against formulas of their own: a seven-parameter shift, a meridian's arc by summing, angles kept."""
    intl, grs = (6378388.0, 1 / 297), (6378137.0, 1 / 298.257222101)
    rx, ry, rz = (math.radians(t / 3600) for t in (-0.33746, -3.09264, 2.53861))
    turn = (1 + 0.4598e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    move = np.array([-189.681, 18.3463, -42.7695])
    back = lambda v: np.linalg.solve(turn, v - move)
    arc = lambda a, b: float(np.trapezoid(intl[0] * (1 - e2) / (1 - e2 * np.sin(k := np.linspace(a, b, 200_001)) ** 2) ** 1.5, k))
    e2 = intl[1] * (2 - intl[1])
    for lon, lat in ((6.17, 49.6), (6.1, 49.75), (6.4, 50.1)):
        got = project(spark, lon, lat, "EPSG:2169")
        east, north = helmert(math.radians(lon), math.radians(lat), grs, intl, back)
        m, t, nu = east - math.radians(6 + 10 / 60), math.tan(north), intl[0] / math.sqrt(1 - e2 * math.sin(north) ** 2)
        c, a = e2 / (1 - e2) * math.cos(north) ** 2, m * math.cos(north)
        x = 80000 + nu * (a + (1 - t**2 + c) * a**3 / 6 + (5 - 18 * t**2 + t**4 + 72 * c - 58 * e2 / (1 - e2)) * a**5 / 120)
        y = 100000 + arc(math.radians(49 + 50 / 60), north) + nu * t * (a**2 / 2 + (5 - t**2 + 9 * c + 4 * c**2) * a**4 / 24)
        assert abs(got.x - x) < 1e-3 and abs(got.y - y) < 1e-3
        # without the shift the place would be hundreds of metres off
        assert 20 < math.hypot(math.degrees(east) - lon, math.degrees(north) - lat) * 111_000 < 400
