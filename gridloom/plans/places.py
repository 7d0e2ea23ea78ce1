"""Queries of coordinate systems: projected bounds and mosaics warped onto another grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import align
from .relations import LR, NODATA, S, lr, query, snap, table

_N, _FACTOR, _ORIGIN = geo.cone(geo.CONICS[3979])
_E = geo.ECCENTRICITY
_PSI = f"atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))"

_EDGES = (
    "b AS (SELECT s_suppkey, -140.0 + s_suppkey % 80 AS x0, 42.0 + s_suppkey % 37 AS y0, -138.5 + s_suppkey % 80 AS x1, 43.25 + s_suppkey % 37 AS y1 FROM supplier), "
    f"k AS (SELECT i / {geo.DENSIFY + 1.0} AS t FROM range({geo.DENSIFY + 2}) r(i)), "
    "p AS (SELECT s_suppkey, x0 + (x1 - x0) * t AS lon, unnest([y0, y1]) AS lat FROM b, k UNION ALL SELECT s_suppkey, unnest([x0, x1]), y0 + (y1 - y0) * t FROM b, k), "
    f"q AS (SELECT s_suppkey, {_FACTOR!r} * exp(-{_N!r} * ({_PSI})) AS rho, {_N!r} * radians(lon + 95) AS theta FROM p)"
)


@query(
    f"WITH {_EDGES} SELECT s_suppkey, {S('min(rho * sin(theta))')} AS xmin, {S(f'min({_ORIGIN!r} - rho * cos(theta))')} AS ymin, {S('max(rho * sin(theta))')} AS xmax, {S(f'max({_ORIGIN!r} - rho * cos(theta))')} AS ymax FROM q GROUP BY s_suppkey"
)
def reproject_bounds(spark, sf_dir):
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 80 - 140.0).alias("xmin"), (k % 37 + 42.0).alias("ymin"), (k % 80 - 138.5).alias("xmax"), (k % 37 + 43.25).alias("ymax"))
    out = geo.reproject_bounds(boxes, "EPSG:4326", "EPSG:3979")
    return out.select("s_suppkey", *(snap(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


_LUX = geo.TRANSVERSE[2169]
_BACK, _TURN = geo.inverse_shift(_LUX.shift)
_RADIUS, _FORTH, _ = geo.series(_LUX.ellipsoid)
_A, _E2, _LE = _LUX.ellipsoid.axis, _LUX.ellipsoid.eccentricity**2, _LUX.ellipsoid.eccentricity
_B = _A * (1 - _LUX.ellipsoid.flattening)
_TURNED = ", ".join(f"{_BACK[i]!r} + {_TURN[i][0]!r} * x + {_TURN[i][1]!r} * y + {_TURN[i][2]!r} * z AS {k}" for i, k in enumerate("xyz"))
_ETA = " + ".join(["eta", *(f"{f!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, f in enumerate(_FORTH, 1))])
_XI = " + ".join(["xi", *(f"{f!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, f in enumerate(_FORTH, 1))])
_SHIFTED = (
    "b AS (SELECT s_suppkey, 5.7 + (s_suppkey % 70) / 100.0 AS x0, 49.4 + (s_suppkey % 60) / 100.0 AS y0, 5.8 + (s_suppkey % 70) / 100.0 AS x1, 49.55 + (s_suppkey % 60) / 100.0 AS y1 FROM supplier), "
    f"k AS (SELECT i / {geo.DENSIFY + 1.0} AS t FROM range({geo.DENSIFY + 2}) r(i)), "
    "p AS (SELECT s_suppkey, x0 + (x1 - x0) * t AS lon, unnest([y0, y1]) AS lat FROM b, k UNION ALL SELECT s_suppkey, unnest([x0, x1]), y0 + (y1 - y0) * t FROM b, k), "
    f"n AS (SELECT *, {geo.AXIS!r} / sqrt(1 - {geo.ECCENTRICITY**2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM p), "
    f"g AS (SELECT s_suppkey, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - {geo.ECCENTRICITY**2!r}) * sin(radians(lat)) AS z FROM n), "
    f"h AS (SELECT s_suppkey, {_TURNED} FROM g), u AS (SELECT *, sqrt(x * x + y * y) AS far, atan2(z * {_A!r}, sqrt(x * x + y * y) * {_B!r}) AS u FROM h), "
    f"l AS (SELECT s_suppkey, atan2(y, x) - radians({_LUX.longitude!r}) AS east, atan2(z + {(_A / _B) ** 2 - 1!r} * {_B!r} * pow(sin(u), 3), far - {_E2!r} * {_A!r} * pow(cos(u), 3)) AS phi FROM u), "
    f"c AS (SELECT s_suppkey, east, sinh(atanh(sin(phi)) - {_LE!r} * atanh({_LE!r} * sin(phi))) AS tau FROM l), "
    "m AS (SELECT s_suppkey, asinh(sin(east) / sqrt(tau * tau + cos(east) * cos(east))) AS eta, atan2(tau, cos(east)) AS xi FROM c), "
    f"q AS (SELECT s_suppkey, {_LUX.east!r} + {_RADIUS!r} * ({_ETA}) AS x, {_LUX.north!r} + {_RADIUS!r} * ({_XI} - {geo.northing(_LUX)!r}) AS y FROM m)"
)


@query(f"WITH {_SHIFTED} SELECT s_suppkey, {S('min(x)')} AS xmin, {S('min(y)')} AS ymin, {S('max(x)')} AS xmax, {S('max(y)')} AS ymax FROM q GROUP BY s_suppkey")
def shifted_bounds(spark, sf_dir):
    """Boxes of degrees on another datum's grid."""
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", (5.7 + k % 70 / 100.0).alias("xmin"), (49.4 + k % 60 / 100.0).alias("ymin"), (5.8 + k % 70 / 100.0).alias("xmax"), (49.55 + k % 60 / 100.0).alias("ymax"))
    out = geo.reproject_bounds(boxes, "EPSG:4326", "EPSG:2169")
    return out.select("s_suppkey", *(snap(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


#: A grid of degrees, and a finer one in Mercator's metres inside it.
_SOURCE = {"a": 0.01, "e": -0.01, "c": 10.0, "f": 50.0}
_TARGET = {"height": 150, "width": 90, "a": 700.0, "e": -700.0, "c": math.radians(10.2) * geo.AXIS, "f": math.asinh(math.tan(math.radians(49.99))) * geo.AXIS, "crs": "EPSG:3857"}

_WARP = (
    "s AS (SELECT 0 AS ord, r, c, v FROM lr WHERE v <> -9999 UNION ALL SELECT 1, r, c, 2 * v FROM lr WHERE v <> -9999 AND c < 40), n AS (SELECT max(r) + 1 AS h FROM lr), "
    f"t AS (SELECT r, c, (degrees(({_TARGET['c']!r} + (c + 0.5) * 700) / {geo.AXIS!r}) - 10.0) / 0.01 AS x, (degrees(atan(sinh(({_TARGET['f']!r} - (r + 0.5) * 700) / {geo.AXIS!r}))) - 50.0) / -0.01 AS y FROM range({_TARGET['height']}) a(r), range({_TARGET['width']}) b(c)), "
    "k AS (SELECT r, c, floor(y - 0.5)::BIGINT + i AS sr, floor(x - 0.5)::BIGINT + j AS sc, (1 - abs(y - 0.5 - floor(y - 0.5) - i)) * (1 - abs(x - 0.5 - floor(x - 0.5) - j)) AS w FROM t, n, range(2) a(i), range(2) b(j) WHERE x >= 0 AND y >= 0 AND x < 100 AND y < h), "
    "m AS (SELECT ord, k.r, k.c, sum(w * v) / sum(w) AS value FROM k JOIN s ON s.r = sr AND s.c = sc WHERE w > 0 GROUP BY ALL)"
)


@query(f"WITH {LR}, {_WARP} SELECT r, c, {S('arg_max(value, ord)')} AS value FROM m GROUP BY r, c")
def warp_mosaic(spark, sf_dir):
    coarse = lr(spark, sf_dir).where(F.col("v") != NODATA)
    cells = coarse.select(F.lit("low").alias("raster_id"), "r", "c", F.col("v").alias("value"))
    cells = cells.unionAll(coarse.where("c < 40").select(F.lit("top"), "r", "c", F.col("v") * 2))
    height = lr(spark, sf_dir).agg((F.max("r") + 1).alias("height"))
    named = F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("low").alias("raster_id")), F.struct(F.lit(1).alias("ord"), F.lit("top").alias("raster_id"))))
    rasters = height.select(named.alias("x"), "height").select("x.*", "height", F.lit(100).alias("width"), *(F.lit(v).alias(k) for k, v in _SOURCE.items()), F.lit("EPSG:4326").alias("crs"))
    return align.warp_mosaic(cells, rasters, _TARGET).select("r", "c", snap("value").alias("value"))
