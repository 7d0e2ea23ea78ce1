import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import arrays
from gridloom.sources import geotiff, rasters


def seen(folder):
    """Names in a folder but hidden ones, where tasks that are being stopped may still write."""
    return sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.exists(folder) else []


def cells(df):
    return {(r.r, r.c): r.value for r in df.collect()}


def test_windows_leave_out_blocks(spark, tmp_path):
    """Blocks beside a window hold no valid bytes, so that reading one would fail."""
    values = np.random.default_rng(1).random((64, 20)).astype(np.float32)
    data = bytearray(geotiff.encode(values, rows=8, nodata=-9999.0))
    for b in geotiff.layout(bytes(data)):
        if not 16 <= b["y"] < 32:
            data[b["place"] : b["place"] + b["count"]] = b"\1" * b["count"]
    path = tmp_path / "x.tif"
    path.write_bytes(bytes(data))
    for rows, columns in (((16, 31), None), ((17, 30), (3, 3)), ((20, 20), (0, 99)), ((24, 25), (18, 40))):
        got = cells(rasters.read_raster(spark, str(path), rows, columns))
        assert got == {(r, c): values[r, c] for r in range(rows[0], rows[1] + 1) for c in range(*((columns[0], min(20, columns[1] + 1)) if columns else (0, 20)))}
    one, other = rasters.read_raster(spark, str(path), (16, 16)), rasters.read_raster(spark, str(path), (31, 31))
    assert one.union(other).count() == 40 and one.join(other.select("c"), "c").count() == 20 and one.where("c > 4").count() == 15 and one.count() == 20
    assert rasters.read_raster(spark, str(path), (100, 200)).count() == 0
    with pytest.raises(Exception):
        rasters.read_raster(spark, str(path)).count()
    assert sum(len(p.blocks) for p in rasters.Reader({"path": str(path)}).partitions()) == 8
    assert [p.blocks for p in rasters.Reader({"path": str(path), "rows": "17:30"}).partitions()] == [[2, 3]]


def test_scenes_are_whole(spark, tmp_path):
    g = np.random.default_rng(2)
    values = g.random((50, 34))
    values[3, 4] = np.nan
    frame = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(50) for c in range(34) if (r, c) != (3, 4)], "r long, c long, v double")
    tiles = arrays.tile_arrays(frame, "v", 50, 34, 16)
    folder = str(tmp_path / "scene")
    rasters.write_scene(tiles, folder, a=2.0, e=-2.0, c=100.0, f=900.0, nodata=-1.0, crs="EPSG:32633")
    names = sorted(os.listdir(folder))
    assert len(names) == 13 and rasters.INDEX in names and not [n for n in names if n.startswith(".")]
    found = geotiff.catalog(spark, folder).collect()
    assert len(found) == 12 and {(r.c, r.f) for r in found} == {(100.0 + 32 * x, 900.0 - 32 * y) for y in range(4) for x in range(3)} and found[0].crs == "EPSG:32633"
    got = cells(rasters.read_scene(spark, folder, 10, 12, 30, 20))
    assert len(got) == 600 and all(got[r, c] == np.float32(values[10 + r, 12 + c]) for r, c in got)
    assert cells(rasters.read_scene(spark, folder, 0, 0, 5, 5))[3, 4] is None
    assert rasters.read_scene(spark, folder, 500, 0, 5, 5).count() == 0
    # a task that fails leaves the earlier scene as it is, and nothing else
    broken = tiles.withColumn("px", F.when(F.col("y") >= 32, F.slice("px", F.lit(1), F.lit(3))).otherwise(F.col("px"))).repartition(4, "y")
    with pytest.raises(Exception):
        rasters.write_scene(broken, folder)
    assert seen(folder) == names and len(cells(rasters.read_scene(spark, folder, 0, 0, 50, 34))) == 1700
    fresh = str(tmp_path / "fresh")
    with pytest.raises(Exception):
        rasters.write_scene(broken, fresh)
    assert seen(fresh) == []
    # an overwritten scene's files go; without overwriting, it's an error
    rasters.write_scene(tiles.where("y < 16"), folder)
    assert len(seen(folder)) == 4 and len(json.load(open(os.path.join(folder, rasters.INDEX)))["tiles"]) == 3
    with pytest.raises(Exception, match="overwrite"):
        tiles.write.format("raster").mode("append").save(folder)
    rasters.write_scene(tiles.limit(0), folder)
    assert seen(folder) == [rasters.INDEX] and rasters.read_raster(spark, folder).count() == 0
