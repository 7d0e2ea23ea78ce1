"""Queries of distances, fills, components and growth over the whole grid, with recursive SQL as oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, growth
from ..sources import geotiff
from .depths import _height
from .relations import DEM, LR, NODATA, WIDTH, S, dem, lr, query, snap

#: Depths from which a coarse cell counts as wet, and as an anchor.
WET, ANCHOR = 0.7, 3.0


def spread_sql(name: str, cells: str, geometric: bool = True) -> str:
    """CTE of the cheapest seed of every cell of ``cells`` (r, c, cost, seed): r, c, d, sr, sc, v. Rounds improve rows by key."""
    step = "CASE WHEN i <> 0 AND j <> 0 THEN sqrt(2) ELSE 1 END" if geometric else "1"
    return (
        f"{name}(r, c, d, sr, sc, v) USING KEY (r, c) AS (SELECT r, c, 0::DOUBLE, r, c, seed FROM {cells} WHERE seed IS NOT NULL AND cost IS NOT NULL UNION "
        "(SELECT r, c, x.d, x.sr, x.sc, x.v FROM (SELECT n.r, n.c, min({'d': s.d + (o.cost + n.cost) / 2 * " + step + ", 'sr': s.sr, 'sc': s.sc, 'v': s.v}) AS x "
        f"FROM {name} s JOIN {cells} o ON o.r = s.r AND o.c = s.c, range(-1, 2) a(i), range(-1, 2) b(j), {cells} n WHERE n.r = s.r + i AND n.c = s.c + j AND n.cost IS NOT NULL GROUP BY n.r, n.c) y "
        f"LEFT JOIN recurring.{name} k USING (r, c) WHERE k.d IS NULL OR (x.d, x.sr, x.sc) < (k.d, k.sr, k.sc)))"
    )


def edged_sql(name: str, cells: str) -> str:
    """``spread_sql`` with the steps between cells as a table of its own, which the second engine copes with on more cells."""
    length = "CASE WHEN i <> 0 AND j <> 0 THEN sqrt(2) ELSE 1 END"
    return (
        f"{name}_steps AS MATERIALIZED (SELECT o.r, o.c, n.r AS tr, n.c AS tc, (o.cost + n.cost) / 2 * {length} AS w FROM {cells} o, range(-1, 2) a(i), range(-1, 2) b(j), {cells} n WHERE n.r = o.r + i AND n.c = o.c + j AND o.cost IS NOT NULL AND n.cost IS NOT NULL), "
        f"{name}(r, c, d, sr, sc, v) USING KEY (r, c) AS (SELECT r, c, 0::DOUBLE, r, c, seed FROM {cells} WHERE seed IS NOT NULL AND cost IS NOT NULL UNION "
        "(SELECT r, c, x.d, x.sr, x.sc, x.v FROM (SELECT e.tr AS r, e.tc AS c, min({'d': s.d + e.w, 'sr': s.sr, 'sc': s.sc, 'v': s.v}) AS x "
        f"FROM {name} s JOIN {name}_steps e ON e.r = s.r AND e.c = s.c GROUP BY e.tr, e.tc) y LEFT JOIN recurring.{name} k USING (r, c) WHERE k.d IS NULL OR (x.d, x.sr, x.sc) < (k.d, k.sr, k.sc)))"
    )


def labels_sql(name: str, cells: str) -> str:
    """CTE of the 4-connected components of ``cells`` (r, c): r, c, label."""
    return (
        f"{name}(r, c, label) USING KEY (r, c) AS (SELECT r, c, r * 4294967296 + c FROM {cells} UNION "
        f"(SELECT r, c, y.label FROM (SELECT n.r, n.c, min(s.label) AS label FROM {name} s, range(-1, 2) a(i), range(-1, 2) b(j), {cells} n "
        f"WHERE abs(i) + abs(j) = 1 AND n.r = s.r + i AND n.c = s.c + j GROUP BY n.r, n.c) y LEFT JOIN recurring.{name} k USING (r, c) WHERE y.label < k.label))"
    )


def _wet(spark, sf_dir):
    return lr(spark, sf_dir).where(F.col("v") >= WET)


_LABELS = f"WITH RECURSIVE {LR}, wet AS (SELECT r, c, v FROM lr WHERE v >= {WET}), {labels_sql('t', 'wet')}"


@query(f"{_LABELS} SELECT r, c, label FROM t")
def components(spark, sf_dir):
    """Label of every wet cell."""
    return graph.label_components(_wet(spark, sf_dir).select("r", "c"))


@query(f"{_LABELS} SELECT r, c, label FROM t WHERE label IN (SELECT label FROM t JOIN wet USING (r, c) WHERE v >= {ANCHOR})")
def keep_anchored(spark, sf_dir):
    wet = _wet(spark, sf_dir)
    return graph.keep_anchored(wet.select("r", "c"), wet.where(F.col("v") >= ANCHOR).select("r", "c"))


@query(f"WITH RECURSIVE {LR}, k AS (SELECT r, c, 1 AS cost, CASE WHEN v >= {ANCHOR} THEN 1 END AS seed FROM lr WHERE v <> {NODATA}), {spread_sql('t', 'k')} SELECT r, c, {S('d')} AS distance FROM t")
def geo_distance(spark, sf_dir):
    cells = lr(spark, sf_dir).where(F.col("v") != NODATA)
    return graph.geodesic_distance(cells.withColumn("seed", F.col("v") >= ANCHOR), "seed").select("r", "c", snap("distance").alias("distance"))


@query(f"WITH RECURSIVE {LR}, k AS (SELECT r, c, 1 AS cost, CASE WHEN v >= {WET} THEN v END AS seed FROM lr), {spread_sql('t', 'k', False)} SELECT r, c, {S('v')} AS v, d AS distance FROM t")
def nearest_fill(spark, sf_dir):
    cells = lr(spark, sf_dir).select("r", "c", F.when(F.col("v") >= WET, F.col("v")).alias("v"))
    return graph.nearest_fill(cells, "v").select("r", "c", snap("v").alias("v"), "distance")


@query(
    f"WITH RECURSIVE {LR}, k AS (SELECT r, c, CASE WHEN v <> {NODATA} THEN 1 + raw / 5 END AS cost, CASE WHEN v >= {ANCHOR} THEN v END AS seed FROM lr), {spread_sql('t', 'k')} "
    f"SELECT r, c, {S('d')} AS distance, sr AS src_r, sc AS src_c, {S('v')} AS value FROM t"
)
def cost_fill(spark, sf_dir):
    cells = lr(spark, sf_dir).select("r", "c", F.when(F.col("v") != NODATA, 1 + F.col("raw") / 5).alias("cost"), F.when(F.col("v") >= ANCHOR, F.col("v")).alias("seed"))
    out = graph.allocate(cells, "cost", "seed")
    return out.select("r", "c", snap("distance").alias("distance"), "src_r", "src_c", snap("value").alias("value"))


def _surfaces(spark, sf_dir):
    coarse = lr(spark, sf_dir).select("r", "c", F.when((F.col("v") != NODATA) & (F.col("v") >= WET), F.col("v") * 40).alias("wse"))
    return coarse, dem(spark, sf_dir)


@query(
    f"WITH {LR}, w AS (SELECT r, c, raw * 40 - 5 * ((r * 31 + c * 17) % 7) AS grown, CASE WHEN raw > 6 THEN raw * 40 END AS anchor, (r * 7 + c * 3) % 25 AS dist, raw * 35 AS z FROM lr WHERE v <> -9999), "
    "m AS (SELECT coalesce(anchor, CASE WHEN dist < 20 AND grown - dist * 0.5 > z THEN grown - dist * 0.5 END) AS wse, anchor FROM w) "
    f"SELECT count(*) AS n, count(*) FILTER (WHERE anchor IS NOT NULL) AS anchors, count(*) FILTER (WHERE anchor IS NULL AND wse IS NOT NULL) AS grown, count(wse) AS wet, {S('sum(wse)')} AS total FROM m"
)
def growth_merge(spark, sf_dir):
    from ..functions.scalar import grown_surface, merge_growth

    r, c, raw = F.col("r"), F.col("c"), F.col("raw")
    cells = lr(spark, sf_dir).where(F.col("v") != NODATA).select((raw * 40 - 5 * ((r * 31 + c * 17) % 7)).alias("filled"), F.when(raw > 6, raw * 40).alias("anchor"), ((r * 7 + c * 3) % 25).alias("dist"), (raw * 35).alias("z"))
    wse = merge_growth(F.col("anchor"), grown_surface(F.col("filled"), F.col("dist"), 0.5), F.col("dist"), F.col("z"), 20)
    a = F.col("anchor").isNotNull()
    merged = cells.select("anchor", wse.alias("wse"))
    return merged.agg(F.count("*").alias("n"), F.count_if(a).alias("anchors"), F.count_if(~a & F.col("wse").isNotNull()).alias("grown"), F.count("wse").alias("wet"), snap(F.sum("wse")).alias("total"))


def _finer_sql(cells: str) -> str:
    """``cells`` (r, c, v) on the grid twice as fine, from the nearest centres that have a value."""
    place = lambda k, n: f"least(greatest(({k} + 0.5) / 2 - 0.5, 0), {n} - 1)"
    return (
        f"SELECT f.r, f.c, sum(w * v) / sum(w) AS v FROM (SELECT r, c, i, j, (1 - abs({place('r', '(SELECT max(r) + 1 FROM lr)')} - i)) * (1 - abs({place('c', WIDTH)} - j)) AS w "
        f"FROM hr, range(-1, 2) a(p), range(-1, 2) b(q), (SELECT 1), LATERAL (SELECT r // 2 + p AS i, c // 2 + q AS j) WHERE abs({place('r', '(SELECT max(r) + 1 FROM lr)')} - i) < 1 AND abs({place('c', WIDTH)} - j) < 1) f "
        f"JOIN {cells} s ON s.r = i AND s.c = j WHERE v IS NOT NULL GROUP BY f.r, f.c"
    )


COSTGROW_SQL = (
    f"WITH RECURSIVE {DEM}, w AS (SELECT r, c, 1 AS cost, CASE WHEN v <> {NODATA} AND v >= {WET} THEN v * 40 END AS seed FROM lr), ws AS (SELECT r, c, seed AS v FROM w), {spread_sql('full_', 'w', False)}, "
    f"up AS ({_finer_sql('ws')}), smooth AS ({_finer_sql('full_')}), cells AS (SELECT r, c, z, CASE WHEN up.v > z THEN up.v END AS anchor, smooth.v AS s FROM dem LEFT JOIN up USING (r, c) LEFT JOIN smooth USING (r, c)), "
    f"flat AS (SELECT r, c, 1 AS cost, anchor AS seed FROM cells), rough AS (SELECT r, c, CASE WHEN s - z > 0 THEN 1 ELSE 1 + abs(s - z) END AS cost, anchor AS seed FROM cells), {spread_sql('near', 'flat', False)}, {edged_sql('reach', 'rough')}, "
    "wet AS (SELECT r, c, z, anchor, coalesce(anchor, CASE WHEN near.d < 20 AND reach.v - near.d * 0.001 > z THEN reach.v - near.d * 0.001 END) AS wse FROM cells LEFT JOIN near USING (r, c) LEFT JOIN reach USING (r, c)), "
    f"kept AS (SELECT * FROM wet WHERE wse IS NOT NULL), {labels_sql('parts', 'kept')} SELECT r, c, {S('wse')} AS wse, {S('wse - z')} AS depth, CASE WHEN anchor IS NULL THEN 'grown' ELSE 'anchor' END AS phase "
    "FROM kept JOIN parts USING (r, c) WHERE label IN (SELECT label FROM parts JOIN kept USING (r, c) WHERE anchor IS NOT NULL)"
)


@query(COSTGROW_SQL)
def costgrow(spark, sf_dir):
    coarse, fine = _surfaces(spark, sf_dir)
    out = growth.grow(coarse, fine, 2, _height(coarse), WIDTH)
    return out.select("r", "c", snap("wse").alias("wse"), snap("depth").alias("depth"), "phase")


@query(f"WITH {LR} SELECT (r // 50)::VARCHAR || '/' || (c // 50)::VARCHAR AS raster_id, r % 50 AS r, c % 50 AS c, {S('CASE WHEN v <> -9999 THEN v::FLOAT::DOUBLE END')} AS v FROM lr")
def geotiff_roundtrip(spark, sf_dir):
    """Tiles of the grid as GeoTIFF files in a column, and back."""
    r, c = F.col("r"), F.col("c")
    tiles = lr(spark, sf_dir).select(F.concat_ws("/", F.expr("r div 50").cast("string"), F.expr("c div 50").cast("string")).alias("raster_id"), (r % 50).alias("r"), (c % 50).alias("c"), F.col("v").cast("float").cast("double").alias("v"))
    return geotiff.decode_cells(geotiff.encode_cells(tiles, "raster_id", "v")).select("raster_id", "r", "c", snap("value").alias("v"))
