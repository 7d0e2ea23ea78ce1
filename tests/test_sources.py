import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.sources import geotiff, registry, stac
from gridloom.sources.storage import stash
from gridloom.streaming import tiles


@pytest.mark.parametrize("compress", ["none", "deflate"])
def test_geotiff(compress):
    a = np.random.default_rng(1).random((70, 33)).astype(np.float32)
    data = geotiff.encode(a, 2.0, -2.0, 100.0, 500.0, -9999.0, compress, rows=16)
    back, grid = geotiff.decode(data)
    assert np.array_equal(a, back) and grid == {"a": 2.0, "e": -2.0, "c": 100.0, "f": 500.0, "nodata": -9999.0}
    with pytest.raises(ValueError):
        geotiff.decode(b"nothing of the kind")


def lzw(data):
    """A plain encoder, for the decoder's sake."""
    table, width, out, bits = {bytes([k]): k for k in range(256)}, 9, 0, 0
    size, now = 258, b""

    def put(code):
        nonlocal out, bits
        out, bits = (out << width) | code, bits + width

    put(256)
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer], size, now = size, size + 1, data[k : k + 1]
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
    put(table[now])
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def test_lzw():
    data = bytes(np.random.default_rng(2).integers(0, 5, 4000, dtype=np.uint8)) + b"abc" * 500
    assert geotiff.unlzw(lzw(data)) == data


def test_geotiff_cells(spark, tmp_path):
    a = np.array([[1.0, -9999.0], [3.0, 4.0]])
    (tmp_path / "x.tif").write_bytes(geotiff.encode(a, 2.0, -2.0, nodata=-9999.0))
    got = {(r.r, r.c): r.value for r in geotiff.read_cells(spark, str(tmp_path / "*.tif")).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 4.0}
    row = geotiff.catalog(spark, str(tmp_path)).first()
    assert (row.height, row.width, row.a, row.nodata) == (2, 2, 2.0, -9999.0)


def manifest(folder, sha=None):
    model = folder / "m.onnx"
    model.write_bytes(b"weights")
    sha = sha or registry.sha256_of(model)
    path = folder / "models.json"
    path.write_text(json.dumps({"models": {"b 2": {"file_name": "m.onnx", "url": model.as_uri(), "sha256": sha.upper() + " "}, "a.1": {"file_name": "m.onnx", "url": str(model), "sha256": sha, "description": "d"}}}))
    return path


def test_registry(spark, tmp_path, capsys):
    path = manifest(tmp_path)
    records = registry.read_manifest(path)
    assert [r.version for r in records] == ["b 2", "a.1"]
    to = registry.fetch(records[0], tmp_path / "cache")
    assert to.read_bytes() == b"weights" and registry.fetch(records[0], tmp_path / "cache") == to and not list(to.parent.glob("*.part"))
    frame = registry.manifest_frame(spark, str(path))
    assert [r.line.split("\t")[0] for r in registry.listed(frame).collect()] == ["a.1", "b 2"]
    workers = spark.createDataFrame([("a_1",)], "module string")
    assert [r.version for r in registry.runnable(frame, workers).collect()] == ["a.1"]
    with pytest.raises(KeyError, match="a.1"):
        registry.resolve(records, "c")
    with pytest.raises(KeyError):
        registry.backend_of("ftp://x/y")
    assert registry.dem_resolution("x_002_dem") == 2.0 and registry.dem_resolution("hires010dem") == 2.0 and registry.dem_resolution("a/010_dem") == 10.0
    assert cli.main(["models", "list", "--manifest", str(path)]) == 0 and capsys.readouterr().out.startswith("a.1\tm.onnx")
    assert cli.main(["models", "fetch", "zz", "--manifest", str(path)]) == 1


def test_bad_digest(tmp_path):
    record = registry.read_manifest(manifest(tmp_path, "0" * 64))[1]
    with pytest.raises(ValueError, match="digest"):
        registry.fetch(record, tmp_path / "cache")
    assert not list((tmp_path / "cache").rglob("*.*nx*"))
    (tmp_path / "m.onnx").unlink()
    with pytest.raises(FileNotFoundError):
        registry.fetch(record, tmp_path / "cache")


def test_parameters(tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"tohr": {"in": "a.tif", "dem": "b.tif", "max_depth": 3.0, "force": True}}))
    argv = ["tohr", "--params", str(p), "--max-depth", "4"]
    args = cli.parser(cli.settings_of(argv)).parse_args(argv)
    assert (args.source, args.dem, args.max_depth, args.force) == ("a.tif", "b.tif", 4.0, True)
    p.write_text(json.dumps({"force": 1}))
    with pytest.raises(ValueError):
        cli.parser(cli.settings_of(["tohr", f"--machine-json={p}"]))
    assert cli.level(0, 0) == 20 and cli.level(5, 0) == 10 and cli.level(0, 9) == 40


def test_command_line(spark, tmp_path, capsys):
    low = np.full((32, 32), 1.0)
    high = np.tile(np.linspace(500, 1000, 64), (64, 1))
    (tmp_path / "low.tif").write_bytes(geotiff.encode(low, 2.0, -2.0, crs="EPSG:32633"))
    (tmp_path / "dem.tif").write_bytes(geotiff.encode(high, 1.0, -1.0, crs="EPSG:32633"))
    out = tmp_path / "out" / "sr.tif"
    assert cli.main(["tohr", "--in", str(tmp_path / "low.tif"), "--dem", str(tmp_path / "dem.tif"), "--out", str(out), "--tile-size", "16", "--tile-overlap", "4"]) == 0
    values, _ = geotiff.decode(out.read_bytes())
    assert values.shape == (64, 64) and np.allclose(values, 1.0, atol=1e-5) and capsys.readouterr().out.strip().endswith("sr.tif")
    assert cli.main(["tohr", "--in", str(tmp_path / "none.tif"), "--dem", str(tmp_path / "dem.tif")]) == 1
    (tmp_path / "there.tif").write_bytes(geotiff.encode(low, 2.0, -2.0, 300.0, 4000.0))
    (tmp_path / "ground.tif").write_bytes(geotiff.encode(high, 1.0, -1.0, 300.0, 4000.0, crs="EPSG:32633"))
    assert cli.main(["tohr", "--in", str(tmp_path / "there.tif"), "--dem", str(tmp_path / "dem.tif"), "--out", str(out)]) == 1
    assert cli.main(["tohr", "--in", str(tmp_path / "there.tif"), "--dem", str(tmp_path / "ground.tif"), "--out", str(out), "--tile-size", "16", "--tile-overlap", "4"]) == 0
    assert {k: geotiff.header(out.read_bytes())[k] for k in "aecf"} == {"a": 1.0, "e": -1.0, "c": 300.0, "f": 4000.0}


def test_footprints(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, {"dtm": "x"}), (2, 5.0, 5.0, 9.0, 9.0, {"dtm": "y"}), (3, 0.0, 0.0, 9.0, 9.0, {"dsm": "z"}), (4, 2.0, 2.0, 3.0, 3.0, {"dtm": None}), (5, 0.0, 0.0, 9.0, 9.0, None)], "item_id long, xmin double, ymin double, xmax double, ymax double, assets map<string, string>")
    queries = spark.createDataFrame([(1.0, 1.0, 3.0, 3.0), (2.0, 2.0, 4.0, 4.0)], "qx0 double, qy0 double, qx1 double, qy1 double")
    assert [r.item_id for r in stac.overlapping(items, queries, "dtm", 2.0).collect()] == [1]
    with pytest.raises(Exception, match="out of order"):
        stac.overlapping(items, queries.select("qx1", "qy1", "qx0", "qy0").toDF("qx0", "qy0", "qx1", "qy1"), "dtm", 2.0).collect()
    layout = stac.mosaic_layout(spark.createDataFrame([(2, 1.0, 0.0, 0.0, 5.0, 5.0), (1, 2.0, 4.0, 0.0, 9.0, 1.0)], "ord int, res double, xmin double, ymin double, xmax double, ymax double")).first()
    assert (layout.width, layout.height) == (5, 3)


def test_footprints_of_all_sizes(spark, monkeypatch):
    """Against all pairs; a box round the world has four rows a level at most."""
    g = np.random.default_rng(12)

    def boxes(n):
        size = 2.0 ** g.uniform(-4, 9, (n, 2))
        low = g.uniform(-180, 180, (n, 2))
        return [(k, *map(float, (*low[k], *(low[k] + size[k])))) for k in range(n)]

    made = [*boxes(300), (300, -180.0, -90.0, 180.0, 90.0), (301, 1.0, 1.0, 1.0, 1.0), (302, None, 0.0, 1.0, 1.0)]
    items = spark.createDataFrame([(*b, {"dtm": "x"}) for b in made] + [(*made[0], {"dtm": "x"})], "item_id long, xmin double, ymin double, xmax double, ymax double, assets map<string, string>")
    asked = [b[1:] for b in boxes(6)]
    queries = spark.createDataFrame([*asked, asked[0]], "qx0 double, qy0 double, qx1 double, qy1 double")
    want = sorted({b[0] for b in made if b[1] is not None and any(b[1] < q[2] and b[3] > q[0] and b[2] < q[3] and b[4] > q[1] for q in asked)})
    for cell in (0.01, 1.0, 1000.0):
        assert sorted({r.item_id for r in stac.overlapping(items, queries, "dtm", cell).collect()}) == want
    assert stac.overlapping(items.limit(0), queries, "dtm", 1.0).count() == 0 and stac.overlapping(items, queries.limit(0), "dtm", 1.0).count() == 0


def test_stash_prunes(spark):
    back = stash(spark.range(10).select("id", (F.col("id") % 3).alias("k")), ("k",))
    assert back.where("k = 1").count() == 3 and "PartitionFilters: [isnotnull(k" in back.where("k = 1")._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 120 + 7200).alias("ts"), (F.col("id") % 10 / 10.0).alias("v"), (F.col("id") % 4).alias("r"), F.lit(0).alias("c"))
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    tiles.wet_counts(source(), "ts", "v", 0.5).writeStream.format("memory").queryName("wet").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("wet").collect())) == sorted(map(tuple, tiles.wet_counts(rows, "ts", "v", 0.5).collect()))
    tiles.apply_to_batches(tiles.latest_cells(source(), "ts"), lambda b: b.groupBy("r").count(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == 100
