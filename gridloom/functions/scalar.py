"""Cell formulas as column expressions. They stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depths below this count as dry in outputs and metrics.
DRY_DEPTH = 1e-3
#: Tolerances of comparisons between floats: |a - b| <= ABSOLUTE + RELATIVE * |b|.
ABSOLUTE, RELATIVE = 1e-8, 1e-5


def is_close(value: Column, other: Column | float, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> Column:
    other = F.lit(other) if isinstance(other, int | float) else other
    return F.abs(value - other) <= absolute + relative * F.abs(other)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def clamp(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """``value`` within bounds; null stays null. NaN isn't ordered like that in Spark: check inputs first."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def nodata_to_null(value: Column, nodata: float | None) -> Column:
    return value if nodata is None else F.when(value != nodata, value)


def nodata_to_zero(value: Column, nodata: float | None) -> Column:
    return value if nodata is None else F.when(is_close(value, nodata), F.lit(0.0)).otherwise(value)


def _log_denominator(max_depth: float) -> float:
    if not (math.isfinite(max_depth) and max_depth > 0):
        raise ValueError(f"max_depth must be finite and above 0, not {max_depth}")
    return math.log1p(max_depth)


def depth_to_unit(depth: Column, max_depth: float) -> Column:
    """Depths of 0 to ``max_depth`` on a logarithmic scale of 0 to 1."""
    return clamp(F.log1p(clamp(depth, 0, max_depth)) / _log_denominator(max_depth), 0, 1)


def unit_to_depth(unit: Column, max_depth: float) -> Column:
    return clamp(F.expm1(clamp(unit, 0, 1) * _log_denominator(max_depth)), 0, max_depth)


def dem_to_unit(z: Column, p_clip: Column, dem_min: Column, dem_max: Column) -> Column:
    """Elevations on a scale of 0 to 1 between a tile's bounds.

    A tile without range gives 0 if it lies at 0, and raises otherwise.
    """
    span = dem_max - dem_min
    flat = F.when(F.abs(dem_min) <= ABSOLUTE, F.lit(0.0)).otherwise(F.raise_error(F.lit("a flat DEM tile above 0 has no range")).cast("double"))
    return F.when(span <= 0, flat).otherwise(clamp((clamp(z, 0, p_clip) - dem_min) / span, 0, 1))


def mask_dry(depth: Column, max_depth: float, dry: float = DRY_DEPTH) -> Column:
    """Depths within 0 to ``max_depth``, with those below ``dry`` at 0."""
    bounded = clamp(depth, 0, max_depth)
    return F.when(bounded < dry, F.lit(0.0)).otherwise(bounded)


def wet_partial(wse: Column, dem: Column) -> Column:
    """Water surface where it lies above the ground, else null."""
    return F.when(wse > dem, wse)


def depth_of(wse: Column, dem: Column) -> Column:
    return F.when(wse.isNotNull() & dem.isNotNull(), F.greatest(wse - dem, F.lit(0.0)))


def terrain_cost(wse: Column, dem: Column, factor: float = 1.0) -> Column:
    """1 where the surface lies above the ground, more the higher the ground lies above it; null without ground."""
    delta = wse - dem
    return F.when(dem.isNotNull(), F.when(delta > 0, F.lit(1.0)).otherwise(1.0 + F.abs(delta) * factor))


def grown_surface(filled: Column, distance: Column, decay: float) -> Column:
    return filled - distance * decay


def merge_growth(anchor: Column, grown: Column, distance: Column, dem: Column, limit: float | None) -> Column:
    """The anchor's surface, else the grown one where it is near enough and above the ground."""
    near = F.lit(True) if limit is None else distance < limit
    return F.when(dem.isNotNull(), F.coalesce(anchor, F.when(near & (grown > dem), grown)))


def product(dimensions: Column) -> Column:
    """The product of an array of whole numbers, 1 if it is empty."""
    return F.aggregate(dimensions, F.lit(1).cast("long"), lambda s, x: s * x)
