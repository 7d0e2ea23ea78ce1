"""Coordinate systems as column formulas: geographic, Mercator, transverse Mercator (UTM) and conformal conic.

Series on the ellipsoid, good to well below a millimetre within a zone. WGS 84, NAD 83 and their likes count as one
datum; older ones are shifted to it by seven parameters, at height 0. Systems that aren't known here raise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of GRS 80, which WGS 84 equals to a tenth of a millimetre.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
#: Points added between two corners of a box before its edges are projected.
DENSIFY = 21

_GEOGRAPHIC = {4326, 4269, 4258, 4617, 4979}


@dataclass(frozen=True)
class Conic:
    """A Lambert conformal conic with two standard parallels, in degrees; no false origin."""

    first: float
    second: float
    latitude: float
    longitude: float


#: The conic of Canada's national grids.
CONICS = {3979: Conic(49.0, 77.0, 49.0, -95.0)}


def _code(crs: str) -> int:
    kind, _, code = crs.upper().partition(":")
    if kind != "EPSG" or not code.isdigit():
        raise ValueError(f"a coordinate system is named by its EPSG code, not {crs!r}")
    return int(code)


def is_projected(crs: str) -> bool:
    """Whether coordinates are lengths. By its number, where the system isn't among those known here: 4000 to 4999 are degrees."""
    code = _code(crs)
    return code not in _GEOGRAPHIC and not 4000 <= code < 5000


def _zone(code: int) -> tuple[float, float] | None:
    """Central meridian and false northing of a UTM zone's code."""
    for first, last, north in ((32601, 32660, 0.0), (32701, 32760, 1e7), (26901, 26923, 0.0), (25828, 25838, 0.0)):
        if first <= code <= last:
            return (code % 100) * 6.0 - 183.0, north
    return None


@dataclass(frozen=True)
class Ellipsoid:
    axis: float
    flattening: float

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))


GRS80 = Ellipsoid(AXIS, FLATTENING)


@dataclass(frozen=True)
class Shift:
    """Seven parameters from a datum to WGS 84: metres, seconds of arc (positions turn), parts per million."""

    x: float
    y: float
    z: float
    turn_x: float
    turn_y: float
    turn_z: float
    scale: float

    def rows(self) -> tuple[list[float], list[list[float]]]:
        """Translation and the matrix of the turn and the scale."""
        a, b, c = (math.radians(t / 3600) for t in (self.turn_x, self.turn_y, self.turn_z))
        m = 1 + self.scale * 1e-6
        return [self.x, self.y, self.z], [[m, -m * c, m * b], [m * c, m, -m * a], [-m * b, m * a, m]]


@dataclass(frozen=True)
class Transverse:
    """A transverse Mercator; latitude and longitude of its origin in degrees."""

    ellipsoid: Ellipsoid
    latitude: float
    longitude: float
    factor: float
    east: float
    north: float
    shift: Shift | None = None


#: Luxembourg's grid on the International ellipsoid of 1924, and its datum's shift.
TRANSVERSE = {2169: Transverse(Ellipsoid(6378388.0, 1 / 297.0), 49 + 50 / 60, 6 + 10 / 60, 1.0, 80000.0, 100000.0, Shift(-189.681, 18.3463, -42.7695, -0.33746, -3.09264, 2.53861, 0.4598))}


def series(ellipsoid: Ellipsoid = GRS80) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of the transverse Mercator's two series, to the fourth power of n."""
    n = ellipsoid.flattening / (2 - ellipsoid.flattening)
    radius = ellipsoid.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forth, back


ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _conformal(latitude: Column, e: float = ECCENTRICITY) -> Column:
    """tan of the conformal latitude."""
    s = F.sin(latitude)
    return F.sinh(F.atanh(s) - e * F.atanh(e * s))


def _geodetic(conformal: Column, e: float = ECCENTRICITY) -> Column:
    """The latitude of a conformal latitude, by its series."""
    e2, e4, e6, e8 = (e ** (2 * k) for k in range(1, 5))
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    return sum((F.lit(t) * F.sin(2 * k * conformal) for k, t in enumerate(terms, 1)), conformal)


def cone(conic: Conic) -> tuple[float, float, float]:
    """Exponent, factor and the radius of the origin's parallel."""
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (ECCENTRICITY * math.sin(math.radians(d))) ** 2)
    t = lambda d: math.exp(-(math.atanh(math.sin(math.radians(d))) - ECCENTRICITY * math.atanh(ECCENTRICITY * math.sin(math.radians(d)))))
    n = (math.log(m(conic.first)) - math.log(m(conic.second))) / (math.log(t(conic.first)) - math.log(t(conic.second)))
    factor = AXIS * m(conic.first) / (n * t(conic.first) ** n)
    return n, factor, factor * t(conic.latitude) ** n


Step = Callable[[Column, Column], tuple[Column, Column]]


def _shifted(here: Ellipsoid, there: Ellipsoid, translation: list[float], matrix: list[list[float]]) -> Step:
    """Longitude and latitude in degrees on another datum, by way of the earth's centre; the height is 0."""

    def step(lon: Column, lat: Column) -> tuple[Column, Column]:
        east, north = F.radians(lon), F.radians(lat)
        e2 = here.flattening * (2 - here.flattening)
        normal = here.axis / F.sqrt(1 - e2 * F.sin(north) * F.sin(north))
        at = normal * F.cos(north) * F.cos(east), normal * F.cos(north) * F.sin(east), normal * (1 - e2) * F.sin(north)
        x, y, z = (sum((k * v for k, v in zip(row, at, strict=True)), F.lit(t)) for t, row in zip(translation, matrix, strict=True))
        short, far = there.axis * (1 - there.flattening), F.sqrt(x * x + y * y)
        # Bowring's formula, exact to a nanometre this near to the ground
        reduced = F.atan2(z * there.axis, far * short)
        e2, second = there.flattening * (2 - there.flattening), (there.axis / short) ** 2 - 1
        up = z + second * short * F.pow(F.sin(reduced), 3)
        return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(up, far - e2 * there.axis * F.pow(F.cos(reduced), 3)))

    return step


def inverse_shift(shift: Shift) -> tuple[list[float], list[list[float]]]:
    """Translation and matrix from WGS 84."""
    translation, m = shift.rows()
    size = sum(m[0][j] * (m[1][(j + 1) % 3] * m[2][(j + 2) % 3] - m[1][(j + 2) % 3] * m[2][(j + 1) % 3]) for j in range(3))
    inverse = [[(m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3]) / size for j in range(3)] for i in range(3)]
    return [-sum(inverse[i][j] * translation[j] for j in range(3)) for i in range(3)], inverse


def northing(t: Transverse) -> float:
    """The origin's place along the central meridian, in radii."""
    _, forth, _ = series(t.ellipsoid)
    s, e = math.sin(math.radians(t.latitude)), t.ellipsoid.eccentricity
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return xi + sum(f * math.sin(2 * k * xi) for k, f in enumerate(forth, 1))


def _transverse(code: int) -> Transverse | None:
    if zone := _zone(code):
        return Transverse(GRS80, 0.0, zone[0], 0.9996, 500000.0, zone[1])
    return TRANSVERSE.get(code)


def _from_degrees(code: int) -> list[Step]:
    """Steps from longitude and latitude in degrees to x and y."""
    if code in _GEOGRAPHIC:
        return []
    if code == 3857:
        return [lambda lon, lat: (F.radians(lon) * AXIS, F.asinh(F.tan(F.radians(lat))) * AXIS)]
    if t := _transverse(code):
        radius, forth, _ = series(t.ellipsoid)
        origin = northing(t)
        return [
            *([_shifted(GRS80, t.ellipsoid, *inverse_shift(t.shift))] if t.shift else []),
            lambda lon, lat: (F.radians(lon - t.longitude), F.radians(lat)),
            lambda east, phi: (east, _conformal(phi, t.ellipsoid.eccentricity)),
            lambda east, tau: (F.asinh(F.sin(east) / F.sqrt(tau * tau + F.cos(east) * F.cos(east))), F.atan2(tau, F.cos(east))),
            lambda eta, xi: (
                sum((F.lit(f) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, f in enumerate(forth, 1)), eta),
                sum((F.lit(f) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, f in enumerate(forth, 1)), xi),
            ),
            lambda x, y: (t.east + t.factor * radius * x, t.north + t.factor * radius * (y - origin)),
        ]
    if conic := CONICS.get(code):
        n, factor, origin = cone(conic)
        return [
            lambda lon, lat: (n * F.radians(lon - conic.longitude), F.radians(lat)),
            lambda theta, phi: (theta, factor * F.exp(-n * F.asinh(_conformal(phi)))),
            lambda theta, rho: (rho * F.sin(theta), origin - rho * F.cos(theta)),
        ]
    raise ValueError(f"EPSG:{code} isn't supported")


def _to_degrees(code: int) -> list[Step]:
    """Steps from x and y to longitude and latitude in degrees."""
    if code in _GEOGRAPHIC:
        return []
    if code == 3857:
        return [lambda x, y: (F.degrees(x / AXIS), F.degrees(F.atan(F.sinh(y / AXIS))))]
    geodetic = lambda lon, conformal: (lon, F.degrees(_geodetic(conformal)))
    if t := _transverse(code):
        radius, _, back = series(t.ellipsoid)
        origin = northing(t)
        return [
            lambda x, y: ((x - t.east) / (t.factor * radius), (y - t.north) / (t.factor * radius) + origin),
            lambda u, v: (
                u - sum((F.lit(b) * F.cos(2 * k * v) * F.sinh(2 * k * u) for k, b in enumerate(back, 1)), F.lit(0.0)),
                v - sum((F.lit(b) * F.sin(2 * k * v) * F.cosh(2 * k * u) for k, b in enumerate(back, 1)), F.lit(0.0)),
            ),
            lambda eta, xi: (t.longitude + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.asin(F.sin(xi) / F.cosh(eta))),
            lambda lon, conformal: (lon, F.degrees(_geodetic(conformal, t.ellipsoid.eccentricity))),
            *([_shifted(t.ellipsoid, GRS80, *t.shift.rows())] if t.shift else []),
        ]
    if conic := CONICS.get(code):
        n, factor, origin = cone(conic)
        return [
            lambda x, y: (conic.longitude + F.degrees(F.atan2(x, origin - y)) / n, F.sqrt(x * x + (origin - y) * (origin - y))),
            lambda lon, rho: (lon, F.atan(F.sinh(-F.log(rho / factor) / n))),
            geodetic,
        ]
    raise ValueError(f"EPSG:{code} isn't supported")


def _steps(source: str, target: str) -> list[Step]:
    """Small steps, each a column or a lambda of its own, so that formulas don't multiply within each other."""
    here, there = _code(source), _code(target)
    return [] if here == there else _to_degrees(here) + _from_degrees(there)


def reproject(points: DataFrame, x: str, y: str, source: str, target: str) -> DataFrame:
    """``points`` with its columns ``x`` and ``y``, in ``source``, replaced by those in ``target``; nulls stay null."""
    for step in _steps(source, target):
        to_x, to_y = step(F.col(x), F.col(y))
        points = points.withColumns({x: to_x, y: to_y})
    return points


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _at(edge: Callable[[Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
    return lambda k: _point(*edge(k))


def reproject_bounds(boxes: DataFrame, source: str, target: str, densify: int = DENSIFY) -> DataFrame:
    """Boxes (xmin, ymin, xmax, ymax and other columns) in another system: the bounds of their densified edges.

    The boxes are dealt over tasks, each edge's points are rows there, and a box's bounds are gathered in the task that
    has it: one shuffle, of boxes. Null bounds give null bounds; boxes across the antimeridian aren't split.
    """
    steps = F.sequence(F.lit(0), F.lit(densify + 1))
    along = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / (densify + 1)
    edges = (
        lambda k: (along("xmin", "xmax", k), F.col("ymin")),
        lambda k: (along("xmin", "xmax", k), F.col("ymax")),
        lambda k: (F.col("xmin"), along("ymin", "ymax", k)),
        lambda k: (F.col("xmax"), along("ymin", "ymax", k)),
    )
    dealt = boxes.withColumn("_box", F.monotonically_increasing_id()).repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_box")
    points = dealt.withColumn("_point", F.explode(F.concat(*(F.transform(steps, _at(edge)) for edge in edges))))
    put = reproject(points.withColumns({"_x": F.col("_point.x"), "_y": F.col("_point.y")}), "_x", "_y", source, target)
    ends = {"xmin": F.min("_x"), "ymin": F.min("_y"), "xmax": F.max("_x"), "ymax": F.max("_y")}
    return put.groupBy("_box").agg(*(ends.get(c, F.first(f"`{c}`")).alias(c) for c in boxes.columns)).drop("_box")
