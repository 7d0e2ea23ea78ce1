"""Checks of inputs: counts of violations in one pass, and compatibility of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import is_finite

#: Tolerance between bounds of two grids.
BOUNDS_TOLERANCE = 1e-6


def require_numeric(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, NumericType):
            raise TypeError(f"{c} must be numeric, not {df.schema[c].dataType.simpleString()}")


def violations(cells: DataFrame, depth: str, dem: str) -> DataFrame:
    """One row: cells, cells whose depth or elevation isn't finite, negative depths, whether all are sound."""
    require_numeric(cells, depth, dem)
    d, z = is_finite(F.col(depth).cast("double")), is_finite(F.col(dem).cast("double"))
    return cells.agg(
        F.count("*").alias("n_cells"), F.count_if(~d).alias("bad_depth"), F.count_if(~z).alias("bad_dem"), F.count_if(F.col(depth) < 0).alias("negative_depth"), F.bool_and(d & z & (F.col(depth) >= 0)).alias("sound")
    )


def bounds_differ(a: Column, b: Column, tolerance: float = BOUNDS_TOLERANCE) -> Column:
    """Whether two bounds (structs xmin, ymin, xmax, ymax) differ by more than ``tolerance`` anywhere."""
    out = F.lit(False)
    for k in ("xmin", "ymin", "xmax", "ymax"):
        out = out | (F.abs(a[k] - b[k]) > tolerance)
    return out


def grid_compatibility(pairs: DataFrame) -> DataFrame:
    """For pairs of catalog rows (bands, crs, projected, bounds, a, e with suffixes _lr and _hr): the verdict on each.

    A missing coarse CRS is taken from the fine grid; ``verdict`` names the first reason against, ``clip`` and
    ``square`` are warnings.
    """
    crs = F.coalesce("crs_lr", "crs_hr")
    verdict = (
        F.when((F.col("bands_lr") != 1) | (F.col("bands_hr") != 1), "bands").when(F.col("crs_hr").isNull(), "no crs").when(crs != F.col("crs_hr"), "crs").when(~F.col("projected_hr"), "geographic").otherwise("ok")
    )
    return pairs.withColumns({
        "verdict": verdict,
        "inherits_crs": F.col("crs_lr").isNull(),
        "clip": bounds_differ(F.col("bounds_lr"), F.col("bounds_hr")),
        "square": F.abs(F.abs(F.col("a_hr")) - F.abs(F.col("e_hr"))) <= BOUNDS_TOLERANCE,
    })
