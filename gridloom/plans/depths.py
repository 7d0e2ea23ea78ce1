"""Queries of scans, cell formulas, alignment and normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import align, arrays, normalize, validate
from ..sources import rasters, stac
from ..sources.storage import checkpoint_dir, stash
from .relations import DEM, HR, LR, MAX_DEPTH, NODATA, UNIT, WIDTH, ZERO, S, dem, hr, lr, query, snap, table

WSE = "wse AS (SELECT r, c, " + ZERO + " * 60 AS wse FROM hr)"


@query(f"WITH {LR} SELECT r, c, {S('v::FLOAT')} AS v FROM lr")
def scan_lr_depth(spark, sf_dir):
    return lr(spark, sf_dir).select("r", "c", snap(F.col("v").cast("float").cast("double")).alias("v"))


@query(f"WITH {LR} SELECT r, c, {S('CASE WHEN v <> -9999 THEN v END')} AS v FROM lr")
def scan_nodata_null(spark, sf_dir):
    return lr(spark, sf_dir).select("r", "c", snap(scalar.nodata_to_null(F.col("v"), NODATA)).alias("v"))


@query(
    f"WITH {HR}, two AS (SELECT 'lr' AS raster_id, 2.0::DOUBLE AS res, r, c, v FROM lr UNION ALL SELECT 'hr', 1.0, r, c, v FROM hr) "
    "SELECT raster_id, max(r) + 1 AS height, max(c) + 1 AS width, res, 0.0::DOUBLE AS xmin, -((max(r) + 1) * res) AS ymin, (max(c) + 1) * res AS xmax, 0.0::DOUBLE AS ymax, "
    "count(*) FILTER (WHERE v = -9999)::BIGINT AS nodata_cells FROM two GROUP BY raster_id, res"
)
def raster_catalog(spark, sf_dir):
    both = lr(spark, sf_dir).select(F.lit("lr").alias("raster_id"), F.lit(2.0).alias("res"), "r", "c", "v").union(hr(spark, sf_dir).select(F.lit("hr"), F.lit(1.0), "r", "c", "v"))
    size = both.groupBy("raster_id", "res").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.count_if(F.col("v") == NODATA).alias("nodata_cells"))
    zero = F.lit(0.0)
    return size.select("raster_id", "height", "width", "res", zero.alias("xmin"), (-(F.col("height") * F.col("res"))).alias("ymin"), (F.col("width") * F.col("res")).alias("xmax"), zero.alias("ymax"), "nodata_cells")


@query(f"WITH {HR} SELECT r // 32 AS tile_row, c // 32 AS tile_col, count(*) AS n, {S('sum(raw)')} AS total FROM hr GROUP BY ALL")
def sink_roundtrip(spark, sf_dir):
    cells = hr(spark, sf_dir).select(F.expr("r div 32").alias("tile_row"), F.expr("c div 32").alias("tile_col"), "r", "c", "raw")
    back = stash(cells.repartition("tile_row"), ("tile_row",))
    return back.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), snap(F.sum("raw")).alias("total"))


@query(f"WITH {LR} SELECT r - 3 AS r, c - 10 AS c, {S('v')} AS v FROM lr WHERE r BETWEEN 3 AND 42 AND c BETWEEN 10 AND 69")
def bbox_window_read(spark, sf_dir):
    window = align.window_of_bounds((20.9, -86.4, 141.2, -7.1), 0.0, 0.0, 2.0)
    return align.read_window(lr(spark, sf_dir), *window).select("r", "c", snap("v").alias("v"))


@query(f"WITH {LR} SELECT r - 3 AS r, c - 10 AS c, {S('CASE WHEN v <> -9999 THEN v::FLOAT::DOUBLE END')} AS v FROM lr WHERE r BETWEEN 3 AND 42 AND c BETWEEN 10 AND 69")
def raster_window_read(spark, sf_dir):
    """The grid written as a scene of tiles, and a window read back: only tiles in the window are opened."""
    cells = lr(spark, sf_dir).select("r", "c", F.when(F.col("v") != NODATA, F.col("v")).alias("v"))
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/scene-{uuid.uuid4().hex}"
    rasters.write_scene(arrays.tile_arrays(cells, "v", _height(cells), WIDTH, 32), folder, a=2.0, e=-2.0, nodata=NODATA)
    window = align.window_of_bounds((20.9, -86.4, 141.2, -7.1), 0.0, 0.0, 2.0)
    return rasters.read_scene(spark, folder, *window).select("r", "c", snap("value").alias("v"))


@query("SELECT n_regionkey::BIGINT AS region, greatest(1, ceil((max(n_nationkey) + 1 - min(n_nationkey)) / (1 + min(n_nationkey) % 3 + 0.25)))::BIGINT AS width, min(n_nationkey)::BIGINT AS first FROM nation GROUP BY n_regionkey")
def mosaic_grid(spark, sf_dir):
    key = F.col("n_nationkey")
    assets = table(spark, sf_dir, "nation").select("n_regionkey", key.alias("ord"), (1 + key % 3 + 0.25).alias("res"), key.alias("xmin"), (key + 1).alias("xmax"), F.lit(0).alias("ymin"), F.lit(1).alias("ymax"))
    grid = stac.mosaic_layout(assets, ("n_regionkey",))
    return grid.select(F.col("n_regionkey").cast("long").alias("region"), F.col("width").cast("long").alias("width"), F.col("xmin").cast("long").alias("first"))


@query(
    "WITH f AS (SELECT p_partkey AS item_id, (p_partkey % 100)::DOUBLE AS xmin, (p_partkey // 100)::DOUBLE AS ymin, p_partkey % 100 + 1 + p_size % 3 AS xmax, p_partkey // 100 + 1 + p_size % 2 AS ymax, "
    "CASE WHEN p_size % 7 <> 0 THEN 'dtm' END AS asset FROM part), "
    "q AS (SELECT r_regionkey, r_regionkey * 17 + 0.5 AS x0, r_regionkey * 3 + 0.5 AS y0, r_regionkey * 17 + 6.5 AS x1, r_regionkey * 3 + 4.5 AS y1 FROM region) "
    "SELECT item_id FROM f WHERE asset IS NOT NULL AND EXISTS (SELECT 1 FROM q WHERE xmin < x1 AND xmax > x0 AND ymin < y1 AND ymax > y0)"
)
def stac_bbox_filter(spark, sf_dir):
    from ..sources.stac import overlapping

    k = F.col("p_partkey")
    box = {"xmin": k % 100, "ymin": F.expr("p_partkey div 100"), "xmax": k % 100 + 1 + F.col("p_size") % 3, "ymax": F.expr("p_partkey div 100") + 1 + F.col("p_size") % 2}
    asset = F.when(F.col("p_size") % 7 != 0, F.create_map(F.lit("dtm"), F.concat(F.lit("s3://dem/"), k.cast("string"))))
    items = table(spark, sf_dir, "part").select(k.alias("item_id"), *(v.cast("double").alias(n) for n, v in box.items()), asset.alias("assets"))
    g = F.col("r_regionkey")
    queries = table(spark, sf_dir, "region").select((g * 17 + 0.5).alias("qx0"), (g * 3 + 0.5).alias("qy0"), (g * 17 + 6.5).alias("qx1"), (g * 3 + 4.5).alias("qy1"))
    return overlapping(items, queries, "dtm", cell=8.0).select("item_id")


@query("SELECT p_partkey AS asset, coalesce(CASE WHEN p_size % 3 = 0 THEN -1.0 END, CASE WHEN p_size % 5 = 0 THEN 0.0 END, -9999)::DOUBLE AS nodata FROM part")
def mosaic_nodata_coalesce(spark, sf_dir):
    size = F.col("p_size")
    nodata = stac.chosen_nodata(F.when(size % 3 == 0, F.lit(-1.0)), F.when(size % 5 == 0, F.lit(0.0)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), nodata.alias("nodata"))


@query(f"SELECT user_id // 10 AS r, user_id % 10 AS c, {S('arg_max(value, event_id)')} AS v FROM events WHERE event_type <> 'error' GROUP BY ALL")
def mosaic_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    layers = e.select(F.expr("user_id div 10").alias("r"), (F.col("user_id") % 10).alias("c"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return align.mosaic_last_wins(layers, "v", "event_id").select("r", "c", snap("v").alias("v"))


@query(f"WITH {LR} SELECT r, c, {S(ZERO)} AS v FROM lr")
def nodata_to_zero(spark, sf_dir):
    return lr(spark, sf_dir).select("r", "c", snap(scalar.nodata_to_zero(F.col("v"), NODATA)).alias("v"))


@query(f"WITH {LR}, z AS (SELECT r, c, {ZERO} AS d FROM lr) SELECT r, c, {S(UNIT)} AS u FROM z")
def depth_scale_log1p(spark, sf_dir):
    return lr(spark, sf_dir).select("r", "c", snap(scalar.depth_to_unit(scalar.nodata_to_zero(F.col("v"), NODATA), MAX_DEPTH)).alias("u"))


@query(f"WITH {LR}, z AS (SELECT r, c, {ZERO} AS d FROM lr), u AS (SELECT r, c, {UNIT} AS u FROM z) SELECT r, c, {S('least(greatest(exp(u * ln(6)) - 1, 0), 5)')} AS d FROM u")
def depth_invert(spark, sf_dir):
    unit = scalar.depth_to_unit(scalar.nodata_to_zero(F.col("v"), NODATA), MAX_DEPTH)
    return lr(spark, sf_dir).select("r", "c", snap(scalar.unit_to_depth(unit, MAX_DEPTH)).alias("d"))


@query(f"WITH {LR}, d AS (SELECT r, c, least(greatest(v / 2000, 0), 5) AS d FROM lr) SELECT r, c, {S('CASE WHEN d < 1e-3 THEN 0 ELSE d END')} AS d FROM d")
def post_mask(spark, sf_dir):
    return lr(spark, sf_dir).select("r", "c", snap(scalar.mask_dry(F.col("v") / 2000, MAX_DEPTH)).alias("d"))


def _surface(spark, sf_dir):
    wse = hr(spark, sf_dir).select("r", "c", (scalar.nodata_to_zero(F.col("v"), NODATA) * 60).alias("wse"))
    return wse.join(dem(spark, sf_dir), ["r", "c"])


@query(f"WITH {DEM}, {WSE} SELECT r, c, {S('CASE WHEN wse > z THEN wse END')} AS wse FROM wse JOIN dem USING (r, c)")
def wet_partials(spark, sf_dir):
    return _surface(spark, sf_dir).select("r", "c", snap(scalar.wet_partial(F.col("wse"), F.col("z"))).alias("wse"))


@query(f"WITH {DEM}, {WSE} SELECT r, c, {S('greatest(wse - z, 0)')} AS depth FROM wse JOIN dem USING (r, c)")
def wse_to_depth(spark, sf_dir):
    return _surface(spark, sf_dir).select("r", "c", snap(scalar.depth_of(F.col("wse"), F.col("z"))).alias("depth"))


@query(f"WITH {DEM}, {WSE} SELECT r, c, {S('CASE WHEN wse - z > 0 THEN 1 ELSE 1 + abs(wse - z) * 0.5 END')} AS cost FROM wse JOIN dem USING (r, c)")
def terrain_cost(spark, sf_dir):
    return _surface(spark, sf_dir).select("r", "c", snap(scalar.terrain_cost(F.col("wse"), F.col("z"), 0.5)).alias("cost"))


TILES = "tiled AS (SELECT r // 32 AS ty, c // 32 AS tx, r, c, z FROM dem), stats AS (SELECT ty, tx, quantile_cont(greatest(z, 0), 0.95) AS p, min(greatest(z, 0)) AS lo, max(greatest(z, 0)) AS hi FROM tiled GROUP BY ty, tx)"


def _tiled(spark, sf_dir):
    return dem(spark, sf_dir).withColumns({"ty": F.expr("r div 32"), "tx": F.expr("c div 32")})


@query(f"WITH {DEM}, {TILES} SELECT ty, tx, {S('p')} AS p_clip, {S('least(lo, p)')} AS dem_min, {S('least(hi, p)')} AS dem_max FROM stats")
def dem_tile_stats(spark, sf_dir):
    s = normalize.tile_stats(_tiled(spark, sf_dir), "z", ("ty", "tx"))
    return s.select("ty", "tx", snap("p_clip").alias("p_clip"), snap("dem_min").alias("dem_min"), snap("dem_max").alias("dem_max"))


@query(f"WITH {DEM}, {TILES} SELECT r, c, {S('least(greatest((least(greatest(z, 0), p) - least(lo, p)) / (least(hi, p) - least(lo, p)), 0), 1)')} AS z_unit FROM tiled JOIN stats USING (ty, tx)")
def dem_normalize(spark, sf_dir):
    return normalize.normalize_tiles(_tiled(spark, sf_dir), "z", ("ty", "tx")).select("r", "c", snap("z_unit").alias("z_unit"))


@query(
    f"WITH {DEM}, {TILES}, s AS (SELECT p, least(hi, p) - least(lo, p) AS g FROM stats) SELECT count(*) AS tile_count, {S('min(p)')} AS dem_p_clip_min, {S('avg(p)')} AS dem_p_clip_mean, {S('max(p)')} AS dem_p_clip_max, "
    f"{S('min(g)')} AS dem_range_min, {S('avg(g)')} AS dem_range_mean, {S('max(g)')} AS dem_range_max FROM s"
)
def dem_stats_summary(spark, sf_dir):
    s = normalize.summarize_stats(normalize.tile_stats(_tiled(spark, sf_dir), "z", ("ty", "tx")))
    return s.select("tile_count", *(snap(c).alias(c) for c in s.columns if c != "tile_count"))


@query(f"WITH {DEM} SELECT d.r, d.c, {S('z')} AS z, {S('v')} AS v FROM dem d LEFT JOIN lr ON d.r // 2 = lr.r AND d.c // 2 = lr.c")
def scale_join(spark, sf_dir):
    j = align.scale_join(dem(spark, sf_dir), lr(spark, sf_dir).select("r", "c", "v"), 2)
    return j.select("r", "c", snap("z").alias("z"), snap("v").alias("v"))


@query(f"WITH {HR}, t AS (SELECT r, c FROM range((SELECT (max(r) + 1) * 3 // 4 FROM hr)) a(r), range(150) b(c)) SELECT t.r, t.c, {S('raw')} AS v FROM t LEFT JOIN hr ON hr.r = floor((t.r + 0.5) / 0.75)::BIGINT AND hr.c = floor((t.c + 0.5) / 0.75)::BIGINT")
def resample_nearest(spark, sf_dir):
    source = hr(spark, sf_dir).select("r", "c", "raw")
    rows = source.agg(F.expr("(max(r) + 1) * 3 div 4").alias("h")).where("h > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("r"))
    targets = rows.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(149).cast("long"))).alias("c"))
    return align.resample_nearest(source, targets, 0.75).select("r", "c", snap("raw").alias("v"))


_BILINEAR = (
    "p AS (SELECT r, c, least(greatest((r + 0.5) / 2 - 0.5, 0), (SELECT max(r) FROM lr)) AS y, least(greatest((c + 0.5) / 2 - 0.5, 0), 99) AS x FROM hr), "
    "k AS (SELECT p.r, p.c, floor(y)::BIGINT + a AS sr, floor(x)::BIGINT + b AS sc, (CASE a WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE b WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM p, range(2) i(a), range(2) j(b)), "
    "b AS (SELECT k.r, k.c, sum(w * raw) / sum(w) AS v FROM k JOIN lr ON lr.r = sr AND lr.c = sc WHERE w > 0 GROUP BY k.r, k.c)"
)


def _height(df):
    return (df.agg(F.max("r")).first()[0] or 0) + 1


@query(f"WITH {HR}, {_BILINEAR} SELECT r, c, {S('v')} AS v FROM b")
def resample_bilinear(spark, sf_dir):
    cells = lr(spark, sf_dir)
    return align.resample_bilinear(cells, "raw", 2, _height(cells), 100).select("r", "c", snap("raw").alias("v"))


@query(f"WITH {LR}, g AS (SELECT a.r, b.c FROM range((SELECT ceil((max(r) + 1) / 32) * 32 FROM lr)::BIGINT) a(r), range(128) b(c)) SELECT g.r, g.c, {S('coalesce(raw, 0)')} AS v FROM g LEFT JOIN lr USING (r, c)")
def pad_grid(spark, sf_dir):
    return align.pad_grid(lr(spark, sf_dir), ["raw"], 32).select("r", "c", snap("raw").alias("v"))


@query(f"WITH {HR} SELECT r, c, {S('raw')} AS v FROM hr WHERE r < 75 AND c < 130")
def crop_grid(spark, sf_dir):
    return align.crop(hr(spark, sf_dir), 75, 130).select("r", "c", snap("raw").alias("v"))


@query(f"WITH {DEM} SELECT r // 4 AS r, c // 4 AS c, {S('avg(z)')} AS z FROM dem GROUP BY ALL")
def avg_pool(spark, sf_dir):
    return align.average_pool(dem(spark, sf_dir), "z", 4).select("r", "c", snap("z").alias("z"))


@query(f"WITH {DEM}, z AS (SELECT d.r, d.c, z, {ZERO.replace('v', 'lr.v')} AS d FROM dem d JOIN lr ON d.r // 2 = lr.r AND d.c // 2 = lr.c) SELECT r, c, {S(UNIT)} AS u, {S('greatest(z, 0)')} AS z FROM z")
def prepare_inputs(spark, sf_dir):
    depth = lr(spark, sf_dir).select("r", "c", scalar.depth_to_unit(scalar.nodata_to_zero(F.col("v"), NODATA), MAX_DEPTH).alias("u"))
    return align.scale_join(dem(spark, sf_dir), depth, 2).select("r", "c", snap("u").alias("u"), snap(scalar.clamp(F.col("z"), 0)).alias("z"))


@query(
    f"WITH {DEM}, j AS (SELECT v, z FROM hr JOIN dem USING (r, c)) SELECT count(*) AS n_cells, 0::BIGINT AS bad_depth, 0::BIGINT AS bad_dem, count(*) FILTER (WHERE v < 0) AS negative_depth, count(*) FILTER (WHERE v < 0) = 0 AS sound FROM j"
)
def validate_inputs(spark, sf_dir):
    return validate.violations(hr(spark, sf_dir).join(dem(spark, sf_dir), ["r", "c"]), "v", "z")


@query(f"WITH {DEM}, {TILES}, s AS (SELECT ty, tx, p, least(lo, p) AS a, least(hi, p) AS b FROM stats) SELECT ty, tx, p >= 0 AND b > a AND isfinite(p) AND isfinite(a) AND isfinite(b) AS usable FROM s")
def stats_validate(spark, sf_dir):
    s = normalize.tile_stats(_tiled(spark, sf_dir), "z", ("ty", "tx"))
    return s.select("ty", "tx", normalize.usable_stats(F.col("p_clip"), F.col("dem_min"), F.col("dem_max")).alias("usable"))


_CATALOG = (
    "g AS (SELECT p_partkey AS k, CASE WHEN p_size % 11 = 0 THEN 2 ELSE 1 END AS bands, CASE WHEN p_size % 13 <> 0 THEN 'EPSG:' || (2169 + p_size % 2) END AS crs, p_size % 17 <> 0 AS projected, "
    "p_retailprice AS xmin, p_retailprice + 10 AS xmax, 1 + (p_size % 4) * 1e-7 AS a FROM part)"
)


@query(
    f"WITH {_CATALOG}, j AS (SELECT l.k AS k, l.bands AS bl, h.bands AS bh, l.crs AS cl, h.crs AS ch, h.projected AS pj, abs(l.xmin - h.xmin) > 1e-6 OR abs(l.xmax - h.xmax) > 1e-6 AS clip, abs(h.a - 1) <= 1e-6 AS square FROM g l JOIN g h ON h.k = l.k + 1) "
    "SELECT k, CASE WHEN bl <> 1 OR bh <> 1 THEN 'bands' WHEN ch IS NULL THEN 'no crs' WHEN coalesce(cl, ch) <> ch THEN 'crs' WHEN NOT pj THEN 'geographic' ELSE 'ok' END AS verdict, cl IS NULL AS inherits_crs, clip, square FROM j"
)
def grid_compat(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    bounds = F.struct(price.alias("xmin"), F.lit(0.0).alias("ymin"), (price + 10).alias("xmax"), F.lit(10.0).alias("ymax"))
    catalog = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.when(size % 11 == 0, 2).otherwise(1).alias("bands"), F.when(size % 13 != 0, F.concat(F.lit("EPSG:"), (2169 + size % 2).cast("string"))).alias("crs"),
        (size % 17 != 0).alias("projected"), bounds.alias("bounds"), (1 + (size % 4) * 1e-7).alias("a"), F.lit(-1.0).alias("e"),
    )
    low = catalog.select(*(F.col(c).alias(f"{c}_lr") for c in catalog.columns))
    high = catalog.select(*(F.col(c).alias(f"{c}_hr") for c in catalog.columns))
    joined = low.join(high, F.col("k_hr") == F.col("k_lr") + 1)
    return validate.grid_compatibility(joined).select(F.col("k_lr").alias("k"), "verdict", "inherits_crs", "clip", "square")
