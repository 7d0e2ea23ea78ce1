"""Queries of tiling, prediction, mosaics, metrics and the flagship super-resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import arrays, metrics, predict, tiling
from .relations import DEM, HR, LR, MAX_DEPTH, NODATA, PAIRS, UNIT, WIDTH, ZERO, S, dem, hr, lr, pairs, query, snap, table

TILE, OVERLAP = 32, 8
#: The coarse tile of the flagship, and the fine one.
LOW, SCALE = 16, 2


def starts_sql(total: str, tile: int = TILE, stride: int = TILE - OVERLAP) -> str:
    return f"SELECT DISTINCT s FROM (SELECT unnest(range(0, greatest({total} - {tile} + 1, 1), {stride})) AS s UNION ALL SELECT {total} - {tile})"


_SIZE = "size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM hr)"
_WINDOWS = (
    _SIZE + f", ys AS (SELECT s AS y0, row_number() OVER (ORDER BY s) - 1 AS yi, count(*) OVER () AS ny FROM ({starts_sql('(SELECT h FROM size)')})), "
    f"xs AS (SELECT s AS x0, row_number() OVER (ORDER BY s) - 1 AS xi, count(*) OVER () AS nx FROM ({starts_sql('(SELECT w FROM size)')})), "
    "windows AS (SELECT yi, xi, y0, x0, yi = 0 AS first_y, yi = ny - 1 AS last_y, xi = 0 AS first_x, xi = nx - 1 AS last_x FROM ys, xs)"
)


def _ramp(i: str, first: str, last: str, tile: int = TILE, overlap: int = OVERLAP) -> str:
    return (
        f"least(greatest(CASE WHEN {i} >= {tile - overlap} THEN CASE WHEN {last} THEN 1.0 ELSE ({tile} - ({i}))::DOUBLE / {overlap + 1} END "
        f"WHEN {i} < {overlap} THEN CASE WHEN {first} THEN 1.0 ELSE ({i} + 1)::DOUBLE / {overlap + 1} END ELSE 1.0 END, 1e-3), 1.0)"
    )


def _shape(cells):
    h, w = cells.agg(F.max("r"), F.max("c")).first()
    return (h or 0) + 1, (w or 0) + 1


@query(
    "WITH t AS (SELECT p_partkey AS k, 20 + p_size AS total FROM part) SELECT k, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, s AS start FROM "
    "(SELECT DISTINCT k, s FROM (SELECT k, unnest(range(0, greatest(total - 20 + 1, 1), 12)) AS s FROM t UNION ALL SELECT k, total - 20 FROM t))"
)
def tile_starts(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (20 + F.col("p_size")).alias("total"))
    return tiling.tile_starts(sizes, "total", 20, tiling.stride_of(20, 8)).select("k", F.col("i").cast("long").alias("i"), F.col("start").cast("long").alias("start"))


@query(f"WITH {HR}, {_WINDOWS} SELECT yi, xi, y0::BIGINT AS y0, x0::BIGINT AS x0, first_y, last_y, first_x, last_x FROM windows")
def window_origins(spark, sf_dir):
    w = tiling.window_origins(spark, *_shape(hr(spark, sf_dir)), TILE, tiling.stride_of(TILE, OVERLAP))
    return w.withColumns({k: F.col(k).cast("long") for k in ("yi", "xi", "y0", "x0")})


@query(f"WITH {HR}, k AS (SELECT DISTINCT c % {TILE} AS i FROM hr) SELECT i, {S(_ramp('i', 'false', 'false'))} AS inner_weight, {S(_ramp('i', 'true', 'false'))} AS first_weight, {S(_ramp('i', 'false', 'true'))} AS last_weight FROM k")
def feather_ramp(spark, sf_dir):
    """Weights of the columns of the grid within their tiles."""
    i = F.col("i")
    w = {"inner_weight": (False, False), "first_weight": (True, False), "last_weight": (False, True)}
    return hr(spark, sf_dir).select((F.col("c") % TILE).alias("i")).distinct().select(i, *(snap(tiling.feather(i, TILE, OVERLAP, *edges)).alias(n) for n, edges in w.items()))


def _windowed(spark, sf_dir):
    cells = hr(spark, sf_dir).select("r", "c", "raw")
    windows = tiling.window_origins(spark, *_shape(cells), TILE, tiling.stride_of(TILE, OVERLAP))
    return tiling.covering_windows(cells, windows, TILE)


@query(f"WITH {HR}, {_WINDOWS} SELECT y0::BIGINT AS y0, x0::BIGINT AS x0, count(*) AS n, {S('sum(raw)')} AS total FROM hr JOIN windows ON r >= y0 AND r < y0 + {TILE} AND c >= x0 AND c < x0 + {TILE} GROUP BY ALL")
def range_join_windows(spark, sf_dir):
    return _windowed(spark, sf_dir).groupBy("y0", "x0").agg(F.count("*").alias("n"), snap(F.sum("raw")).alias("total"))


_BLEND = f"w AS (SELECT r, c, {{value}} AS v, {_ramp('r - y0', 'first_y', 'last_y')} * {_ramp('c - x0', 'first_x', 'last_x')} AS w FROM hr JOIN windows ON r >= y0 AND r < y0 + {TILE} AND c >= x0 AND c < x0 + {TILE})"


@query(f"WITH {HR}, {_WINDOWS}, {_BLEND.format(value='raw + (yi * 3 + xi) % 5')} SELECT r, c, {S('sum(v * w) / greatest(sum(w), 1e-6)')} AS v FROM w GROUP BY r, c")
def feather_blend(spark, sf_dir):
    tiles = _windowed(spark, sf_dir).withColumn("v", F.col("raw") + (F.col("yi") * 3 + F.col("xi")) % 5)
    return tiling.feather_blend(tiling.weighted(tiles, TILE, OVERLAP), "v").select("r", "c", snap("v").alias("v"))


@query(f"WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings) SELECT (vec_id // 25) * 8 + i // 8 AS r, (vec_id % 25) * 8 + i % 8 AS c, {S('v::DOUBLE')} AS v FROM e")
def hard_mosaic(spark, sf_dir):
    k = F.col("vec_id")
    tiles = table(spark, sf_dir, "embeddings").select((F.expr("vec_id div 25") * 8).alias("y0"), (k % 25 * 8).alias("x0"), F.col("embedding").alias("px"))
    return tiling.hard_mosaic(tiles, "px", 8).select("r", "c", snap(F.col("v").cast("double")).alias("v"))


_CHIPS = (
    "e AS (SELECT vec_id, unnest(range(0, 64)) AS i, least(greatest(unnest(embedding)::DOUBLE, 0), 1) AS v FROM embeddings), "
    "p AS (SELECT vec_id, r, c, least(greatest((r + 0.5) / 2 - 0.5, 0), 7) AS y, least(greatest((c + 0.5) / 2 - 0.5, 0), 7) AS x FROM (SELECT DISTINCT vec_id FROM e), range(16) a(r), range(16) b(c)), "
    "k AS (SELECT p.vec_id, p.r, p.c, (floor(y)::BIGINT + a) * 8 + floor(x)::BIGINT + b AS i, floor(x)::BIGINT + b AS sx, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM p, range(2) f(a), range(2) g(b)), "
    "m AS (SELECT k.vec_id, k.r, k.c, sum(w * v) / sum(w) AS v FROM k JOIN e USING (vec_id, i) WHERE w > 0 AND sx < 8 GROUP BY ALL)"
)


@query(f"WITH {_CHIPS} SELECT vec_id, count(*) AS n, {S('sum(v)')} AS total, {S('max(v)')} AS top, {S('sum(v * (r * 16 + c))')} AS moment FROM m GROUP BY vec_id")
def predict_tiles(spark, sf_dir):
    chips = table(spark, sf_dir, "embeddings")
    unit = lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))
    tiles = chips.select("vec_id", F.transform("embedding", unit).alias("depth"), F.array_repeat(F.lit(0.0), 256).alias("dem"))
    out = predict.predict_tiles(tiles, predict.BilinearPredictor(2), "depth", "dem", 8).select("vec_id", F.posexplode("px").alias("i", "v"))
    return out.groupBy("vec_id").agg(F.count("*").alias("n"), snap(F.sum("v")).alias("total"), snap(F.max("v")).alias("top"), snap(F.sum(F.col("v") * F.col("i"))).alias("moment"))


def super_resolve(depth, dem_cells, scale: int, tile: int, overlap: int, max_depth: float, nodata: float | None, predictor=None, percent: float = 95.0, blend_depths: bool = True):
    """r, c and depth of the fine grid from coarse depths (r, c, v) and elevations (r, c, z) that begin at the same corner.

    ``arrays.super_resolve`` on grids with ``scale`` fine cells a coarse one, as far as the elevations reach.
    """
    height, width = _shape(dem_cells)
    fine = arrays.Grid(height, width, arrays.Axis(0.0, 1.0), arrays.Axis(0.0, 1.0))
    coarse = arrays.Grid(-(-height // scale), -(-width // scale), arrays.Axis(0.0, float(scale)), arrays.Axis(0.0, float(scale)))
    low = depth.select("r", "c", scalar.nodata_to_zero(F.col("v"), nodata).alias("v"))
    out = arrays.super_resolve(low, dem_cells.select("r", "c", "z"), coarse, fine, predictor or predict.BilinearPredictor(scale), tile, overlap, max_depth, percent, blend_depths=blend_depths, group=8, block=128)
    return arrays.cells_of(out, "depth")


_FLAG_LOW = (
    f"u AS (SELECT r, c, {UNIT.replace('d,', 'd,')} AS u FROM (SELECT r, c, {ZERO} AS d FROM lr)), "
    f"pad AS (SELECT a.r, b.c, coalesce(u, 0) AS u FROM range((SELECT ceil((max(r) + 1) / {LOW}) * {LOW} FROM lr)::BIGINT) a(r) CROSS JOIN range(112) b(c) LEFT JOIN u ON u.r = a.r AND u.c = b.c)"
)
_FLAG_WINDOWS = (
    f"psize AS (SELECT (max(r) + 1) * {SCALE} AS h, (max(c) + 1) * {SCALE} AS w FROM pad), ys AS (SELECT s AS y0, row_number() OVER (ORDER BY s) - 1 AS yi, count(*) OVER () AS ny FROM ({starts_sql('(SELECT h FROM psize)')})), "
    f"xs AS (SELECT s AS x0, row_number() OVER (ORDER BY s) - 1 AS xi, count(*) OVER () AS nx FROM ({starts_sql('(SELECT w FROM psize)')})), "
    "windows AS (SELECT y0, x0, yi = 0 AS first_y, yi = ny - 1 AS last_y, xi = 0 AS first_x, xi = nx - 1 AS last_x FROM ys, xs)"
)
_FLAGSHIP = (
    f"pt AS (SELECT y0, x0, first_y, last_y, first_x, last_x, i, j, least(greatest((i + 0.5) / 2 - 0.5, 0), {LOW - 1}) AS y, least(greatest((j + 0.5) / 2 - 0.5, 0), {LOW - 1}) AS x FROM windows, range({TILE}) a(i), range({TILE}) b(j)), "
    f"nb AS (SELECT y0, x0, i, j, first_y, last_y, first_x, last_x, y0 // 2 + least(floor(y)::BIGINT + a, {LOW - 1}) AS r, x0 // 2 + least(floor(x)::BIGINT + b, {LOW - 1}) AS c, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS k FROM pt, range(2) f(a), range(2) g(b)), "
    "tile AS (SELECT y0, x0, i, j, first_y, last_y, first_x, last_x, sum(k * u) AS v FROM nb JOIN pad USING (r, c) GROUP BY ALL), "
    f"w AS (SELECT y0 + i AS r, x0 + j AS c, v, {_ramp('i', 'first_y', 'last_y')} * {_ramp('j', 'first_x', 'last_x')} AS w FROM tile), "
    "b AS (SELECT r, c, sum(v * w) / greatest(sum(w), 1e-6) AS v FROM w GROUP BY r, c), "
    "d AS (SELECT r, c, least(greatest(exp(least(greatest(v, 0), 1) * ln(6)) - 1, 0), 5) AS d FROM b JOIN (SELECT max(r) AS mr, max(c) AS mc FROM hr) ON r <= mr AND c <= mc)"
)


@query(f"WITH {HR}, {_FLAG_LOW}, {_FLAG_WINDOWS}, {_FLAGSHIP} SELECT r // 16 AS br, c // 16 AS bc, count(*) AS n, {S('avg(CASE WHEN d < 1e-3 THEN 0 ELSE d END)')} AS mean_depth, {S('max(CASE WHEN d < 1e-3 THEN 0 ELSE d END)')} AS max_depth FROM d GROUP BY ALL")
def superres_flagship(spark, sf_dir):
    out = super_resolve(lr(spark, sf_dir).select("r", "c", "v"), dem(spark, sf_dir), SCALE, LOW, OVERLAP // SCALE, MAX_DEPTH, NODATA, blend_depths=False)
    return out.groupBy(F.expr("r div 16").alias("br"), F.expr("c div 16").alias("bc")).agg(F.count("*").alias("n"), snap(F.avg("depth")).alias("mean_depth"), snap(F.max("depth")).alias("max_depth"))


def _metrics_sql(est: str, group: str) -> str:
    return (
        f"SELECT {group}, avg(({est}-ref)*({est}-ref)) AS mse, avg(abs({est}-ref)) AS mae, avg({est}-ref) AS bias, sqrt(avg(({est}-ref)*({est}-ref)) FILTER (WHERE ref >= 1e-3)) AS rw, count(*) FILTER (WHERE ref >= 1e-3) AS wet, "
        f"count(*) FILTER (WHERE ref < 1e-3) AS dry, avg(ref) AS mx, avg({est}) AS my, var_pop(ref) AS vx, var_pop({est}) AS vy, covar_pop(ref, {est}) AS xy FROM pairs GROUP BY 1"
    )


_SSIM = "((2 * mx * my + 0.0025) * (2 * xy + 0.0225)) / ((mx * mx + my * my + 0.0025) * (vx + vy + 0.0225))"
_PSNR = "CASE WHEN mse > 0 THEN 20 * log10(5) - 10 * log10(mse) END"
_ALL = f"{S(_PSNR)} AS psnr, {S(_SSIM)} AS ssim, {S('sqrt(mse)')} AS rmse_m, {S('rw')} AS rmse_wet_m, {S('mae')} AS mae_m, {S('mae')} AS mase_m, {S('bias')} AS bias_m, {S('mse')} AS mse_m2, dry AS dry_pixel_count, wet AS wet_pixel_count"


def _snapped(m, *keys):
    counts = ("dry_pixel_count", "wet_pixel_count")
    return m.select(*keys, *(F.col(c) if c in counts else snap(c).alias(c) for c in m.columns if c not in keys))


@query(f"WITH {PAIRS}, s AS ({_metrics_sql('est', 'tile')}) SELECT tile, {_ALL} FROM s")
def error_metrics(spark, sf_dir):
    return _snapped(metrics.error_metrics(pairs(spark, sf_dir), "ref", "est", MAX_DEPTH, ("tile",)), "tile")


def _by_method(spark, sf_dir):
    p = pairs(spark, sf_dir)
    long = p.select("ref", F.expr("stack(2, 'model', est, 'bilinear', alt) as (method, value)"))
    return metrics.error_metrics(long, "ref", "value", MAX_DEPTH, ("method",))


_METHODS = _metrics_sql("est", "'model' AS method").replace("GROUP BY 1", "") + " UNION ALL " + _metrics_sql("alt", "'bilinear' AS method").replace("GROUP BY 1", "")


@query(f"WITH {PAIRS}, s AS ({_METHODS}) SELECT method, {_ALL} FROM s")
def metrics_by_method(spark, sf_dir):
    return _snapped(_by_method(spark, sf_dir), "method")


@query(
    f"WITH {PAIRS}, s AS ({_METHODS}), l AS (SELECT method, unnest(['psnr', 'ssim', 'mase_m', 'rmse_m', 'rmse_wet_m', 'bias_m']) AS metric, unnest([{_PSNR}, {_SSIM}, mae, sqrt(mse), rw, bias]) AS value FROM s) "
    f"SELECT a.metric AS metric, {S('a.value')} AS first_value, {S('b.value')} AS second_value, {S('a.value - b.value')} AS delta, CASE WHEN a.metric IN ('psnr', 'ssim') THEN a.value > b.value WHEN a.metric = 'bias_m' THEN abs(a.value) < abs(b.value) ELSE a.value < b.value END AS better "
    "FROM l a JOIN l b ON a.metric = b.metric AND a.method = 'model' AND b.method = 'bilinear'"
)
def metrics_compare(spark, sf_dir):
    c = metrics.compare(_by_method(spark, sf_dir), "method", "model", "bilinear")
    return c.select("metric", snap("first_value").alias("first_value"), snap("second_value").alias("second_value"), snap("delta").alias("delta"), "better")


@query(f"WITH {PAIRS} SELECT status, count(est) AS n, {S('min(est)')} AS min, {S('avg(est)')} AS mean, {S('max(est)')} AS max, {S('stddev_pop(est)')} AS std FROM pairs GROUP BY status")
def summary_stats(spark, sf_dir):
    s = metrics.summary(pairs(spark, sf_dir), "est", ("status",))
    return s.select("status", "n", *(snap(c).alias(c) for c in ("min", "mean", "max", "std")))


@query(f"WITH {PAIRS}, b AS (SELECT least(floor((est - 0) / (5.0::DOUBLE / 50)), 49)::BIGINT AS bin FROM pairs WHERE est >= 0 AND est <= 5) SELECT bin, count(*) AS n, {S('count(*) / sum(count(*)) OVER () / 0.1')} AS density FROM b GROUP BY bin")
def histogram(spark, sf_dir):
    return metrics.histogram(pairs(spark, sf_dir), "est", 0.0, 5.0, 50).select(F.col("bin").cast("long").alias("bin"), "n", snap("density").alias("density"))


@query(f"WITH {PAIRS}, e AS (SELECT abs(est - ref) AS e FROM pairs UNION ALL SELECT abs(alt - ref) FROM pairs) SELECT {S('greatest(quantile_cont(e, 0.98), 1e-6)')} AS e98 FROM e")
def abs_err_p98(spark, sf_dir):
    return metrics.error_percentile(pairs(spark, sf_dir), "ref", ("est", "alt"), 98).select(snap("limit").alias("e98"))


@query(f"WITH {PAIRS} SELECT {S('(count(*) FILTER (WHERE ref >= 2 AND est >= 2))::DOUBLE / count(*) FILTER (WHERE ref >= 2 OR est >= 2)')} AS csi FROM pairs")
def critical_success_index(spark, sf_dir):
    return metrics.critical_success(pairs(spark, sf_dir), "ref", "est", 2.0).select(snap("csi").alias("csi"))


@query(f"WITH {LR} SELECT r, c, row_number() OVER (ORDER BY r, c) AS zone, {S('raw')} AS v FROM lr WHERE v <> -9999")
def zone_lookup(spark, sf_dir):
    cells = lr(spark, sf_dir).where(F.col("v") != NODATA)
    zones = tiling.numbered(cells.select("r", "c"), "zone")
    return zones.join(cells.select("r", "c", "raw"), ["r", "c"]).select("r", "c", F.col("zone").cast("long").alias("zone"), snap("raw").alias("v"))


__all__ = ["DEM", "WIDTH", "super_resolve"]
