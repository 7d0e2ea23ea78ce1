"""Queries of rasters whose scales have no whole ratio: a model that makes three cells of a coarse one, on a grid that has two."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import arrays, predict
from .relations import DEM, HR, LR, MAX_DEPTH, NODATA, UNIT, WIDTH, ZERO, S, dem, lr, query, snap
from .windows import LOW, OVERLAP, SCALE, _ramp, _shape, starts_sql

#: The model's cells along a coarse one, and its windows and their overlap.
MODEL = 3
FINE, SHARED = LOW * MODEL, OVERLAP // SCALE * MODEL


def _grid(height: int, width: int, per_coarse: int) -> arrays.Grid:
    return arrays.Grid(height * per_coarse, width * per_coarse, arrays.Axis(0.0, 1 / per_coarse), arrays.Axis(0.0, 1 / per_coarse))


def _taps(name: str, cells: str, source: str, ratio: str, reach: str, steps: int) -> str:
    """Rows (t, s, w): target cells, source cells and weights; ``ratio`` is source cells along a target one."""
    place = f"((t + 0.5) * {ratio} - 0.5)"
    return (
        f"{name} AS (SELECT t, s, 1 - abs(s - p) / {reach} AS w FROM (SELECT t, {place} AS p, floor({place} - {reach})::BIGINT + k AS s FROM range({cells}) x(t), range(1, {steps + 1}) y(k)) "
        f"WHERE s >= 0 AND s < {source} AND 1 - abs(s - p) / {reach} > 1e-9)"
    )


_ROWS, _COLUMNS = "(SELECT (max(r) + 1)::BIGINT FROM lr)", f"{WIDTH}"


@query(
    f"WITH {DEM}, {_taps('ty', f'{MODEL} * {_ROWS}', f'{SCALE} * {_ROWS}', '(2.0::DOUBLE / 3)', '1', 2)}, {_taps('tx', f'{MODEL} * {_COLUMNS}', f'{SCALE} * {_COLUMNS}', '(2.0::DOUBLE / 3)', '1', 2)} "
    f"SELECT ty.t AS r, tx.t AS c, {S('sum(ty.w * tx.w * z) / sum(ty.w * tx.w)')} AS z FROM dem JOIN ty ON ty.s = dem.r JOIN tx ON tx.s = dem.c GROUP BY ty.t, tx.t"
)
def resample_rational(spark, sf_dir):
    """Elevations from two to three cells along a coarse one."""
    z = dem(spark, sf_dir)
    height = -(-_shape(z)[0] // SCALE)
    fine = _grid(height, WIDTH, SCALE)
    out = arrays.resample_cells(z, "z", fine, _grid(height, WIDTH, MODEL), 128)
    return arrays.cells_of(out, "z").select("r", "c", snap("z").alias("z"))


_WINDOWS = (
    f"u AS (SELECT r, c, {UNIT} AS u FROM (SELECT r, c, {ZERO} AS d FROM lr)), size AS (SELECT ceil((max(r) + 1) / {LOW})::BIGINT * {LOW} AS h, ceil((max(c) + 1) / {LOW})::BIGINT * {LOW} AS w FROM lr), "
    "pad AS (SELECT a.r, b.c, coalesce(u, 0) AS u FROM range((SELECT h FROM size)) a(r) CROSS JOIN range((SELECT w FROM size)) b(c) LEFT JOIN u ON u.r = a.r AND u.c = b.c), "
    f"ys AS (SELECT s AS y0, row_number() OVER (ORDER BY s) - 1 AS yi, count(*) OVER () AS ny FROM ({starts_sql(f'(SELECT h * {MODEL} FROM size)', FINE, FINE - SHARED)})), "
    f"xs AS (SELECT s AS x0, row_number() OVER (ORDER BY s) - 1 AS xi, count(*) OVER () AS nx FROM ({starts_sql(f'(SELECT w * {MODEL} FROM size)', FINE, FINE - SHARED)})), "
    f"pt AS (SELECT y0, x0, yi = 0 AS first_y, yi = ny - 1 AS last_y, xi = 0 AS first_x, xi = nx - 1 AS last_x, i, j, least(greatest((i + 0.5) / {MODEL} - 0.5, 0), {LOW - 1}) AS y, least(greatest((j + 0.5) / {MODEL} - 0.5, 0), {LOW - 1}) AS x FROM ys, xs, range({FINE}) a(i), range({FINE}) b(j)), "
    f"nb AS (SELECT y0, x0, i, j, first_y, last_y, first_x, last_x, y0 // {MODEL} + least(floor(y)::BIGINT + a, {LOW - 1}) AS r, x0 // {MODEL} + least(floor(x)::BIGINT + b, {LOW - 1}) AS c, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS k FROM pt, range(2) f(a), range(2) g(b)), "
    "tile AS (SELECT y0, x0, i, j, first_y, last_y, first_x, last_x, least(greatest(exp(least(greatest(sum(k * u), 0), 1) * ln(6)) - 1, 0), 5) AS v FROM nb JOIN pad USING (r, c) GROUP BY ALL), "
    f"w AS (SELECT y0 + i AS r, x0 + j AS c, v, {_ramp('i', 'first_y', 'last_y', FINE, SHARED)} * {_ramp('j', 'first_x', 'last_x', FINE, SHARED)} AS w FROM tile), "
    f"m AS (SELECT r, c, sum(v * w) / sum(w) AS v FROM w WHERE r < {MODEL} * {_ROWS} AND c < {MODEL} * {_COLUMNS} GROUP BY r, c)"
)
_BLOCKS = f"SELECT r // 16 AS br, c // 16 AS bc, count(*) AS n, {S('avg(CASE WHEN d < 1e-3 THEN 0 ELSE d END)')} AS mean_depth, {S('max(CASE WHEN d < 1e-3 THEN 0 ELSE d END)')} AS max_depth FROM d GROUP BY ALL"


def _by_block(cells):
    return cells.groupBy(F.expr("r div 16").alias("br"), F.expr("c div 16").alias("bc")).agg(F.count("*").alias("n"), snap(F.avg("depth")).alias("mean_depth"), snap(F.max("depth")).alias("max_depth"))


def _resolved(spark, sf_dir, per_coarse: int):
    """Depths by the model, on the grid with so many cells along a coarse one."""
    low = lr(spark, sf_dir).select("r", "c", scalar.nodata_to_zero(F.col("v"), NODATA).alias("v"))
    z = dem(spark, sf_dir)
    height = -(-_shape(z)[0] // SCALE)
    if per_coarse == MODEL:
        z = arrays.cells_of(arrays.resample_cells(z, "z", _grid(height, WIDTH, SCALE), _grid(height, WIDTH, MODEL), 128), "z")
    out = arrays.super_resolve(low, z, _grid(height, WIDTH, 1), _grid(height, WIDTH, per_coarse), predict.BilinearPredictor(MODEL), LOW, OVERLAP // SCALE, MAX_DEPTH, group=8, block=128)
    return _by_block(arrays.cells_of(out, "depth"))


@query(f"WITH {HR}, {_WINDOWS}, d AS (SELECT r, c, v AS d FROM m) {_BLOCKS}")
def superres_depths(spark, sf_dir):
    """Depths are blended, not the model's units; elevations are resampled to the model's grid beforehand."""
    return _resolved(spark, sf_dir, MODEL)


@query(
    f"WITH {LR}, {_WINDOWS}, {_taps('ty', f'{SCALE} * {_ROWS}', f'{MODEL} * {_ROWS}', '1.5::DOUBLE', '1.5::DOUBLE', 4)}, {_taps('tx', f'{SCALE} * {_COLUMNS}', f'{MODEL} * {_COLUMNS}', '1.5::DOUBLE', '1.5::DOUBLE', 4)}, "
    f"d AS (SELECT ty.t AS r, tx.t AS c, least(greatest(sum(ty.w * tx.w * v) / sum(ty.w * tx.w), 0), 5) AS d FROM m JOIN ty ON ty.s = m.r JOIN tx ON tx.s = m.c GROUP BY ty.t, tx.t) {_BLOCKS}"
)
def superres_other_scale(spark, sf_dir):
    """Elevations go from the fine grid to the model's, depths back from there."""
    return _resolved(spark, sf_dir, SCALE)
