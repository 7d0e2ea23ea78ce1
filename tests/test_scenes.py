import json
import tracemalloc

import numpy as np
import pytest

from gridloom import cli
from gridloom.operators import arrays
from gridloom.operators.arrays import Axis, Grid
from gridloom.operators.predict import BilinearPredictor, OnnxPredictor
from gridloom.plans import scenes
from gridloom.sources import geotiff, onnx

CRS = "EPSG:32633"
LEFT, TOP = 500000.0, 5000000.0


def toy(path, low=8, scale=4):
    """A network that repeats depths and adds a part of the elevations."""
    high = low * scale
    nodes = [onnx.node("Resize", ["depth", "", "sizes"], ["up"], mode="nearest"), onnx.node("Mul", ["up", "w"], ["a"]), onnx.node("Mul", ["dem", "b"], ["c"]), onnx.node("Add", ["a", "c"], ["out"])]
    weights = [onnx.tensor("sizes", [4], [1.0, float(scale), float(scale), 1.0]), onnx.tensor("w", [1], [0.75]), onnx.tensor("b", [1], [0.25])]
    path.write_bytes(onnx.model(nodes, weights, {"depth": ["n", low, low, 1], "dem": ["n", high, high, 1]}, {"out": ["n", high, high, 1]}))
    return path


def weight(place, k, reach):
    return max(0.0, 1 - abs(k - place) / reach)


def resample(values, source, target):
    """Cell by cell: ``source`` and ``target`` are (origin, step, size) of rows and of columns."""
    out = np.full((target[0][2], target[1][2]), np.nan)
    reach = [max(1.0, abs(t[1] / s[1])) for s, t in zip(source, target, strict=True)]
    for i in range(out.shape[0]):
        y = (target[0][0] + (i + 0.5) * target[0][1] - source[0][0]) / source[0][1] - 0.5
        for j in range(out.shape[1]):
            x = (target[1][0] + (j + 0.5) * target[1][1] - source[1][0]) / source[1][1] - 0.5
            total = norm = 0.0
            for r in range(max(0, int(y - reach[0]) - 1), min(values.shape[0], int(y + reach[0]) + 3)):
                for c in range(max(0, int(x - reach[1]) - 1), min(values.shape[1], int(x + reach[1]) + 3)):
                    w = weight(y, r, reach[0]) * weight(x, c, reach[1])
                    if w > 1e-9 and np.isfinite(values[r, c]):
                        total, norm = total + w * values[r, c], norm + w
            if norm > 1e-12:
                out[i, j] = total / norm
    return out


def whole(depth, dem, run, scale, tile, overlap, percent=95.0, max_depth=5.0):
    """Depths on the model's grid, window by window; ``dem`` lies on it already."""
    side, shared = tile * scale, overlap * scale
    h, w = (-(-n // side) * side for n in dem.shape)
    z, d = np.zeros((h, w)), np.zeros((h // scale, w // scale))
    z[: dem.shape[0], : dem.shape[1]], d[: depth.shape[0], : depth.shape[1]] = dem, depth
    starts = [sorted({*range(0, n - side + 1, side - shared), n - side}) for n in (h, w)]
    sums, weights = np.zeros((h, w)), np.zeros((h, w))
    for y in starts[0]:
        for x in starts[1]:
            u = np.log1p(np.clip(d[y // scale : (y + side) // scale, x // scale : (x + side) // scale], 0, max_depth)) / np.log1p(max_depth)
            part = np.maximum(z[y : y + side, x : x + side], 0)
            p = np.percentile(part, percent)
            low, high = min(part.min(), p), min(part.max(), p)
            unit = np.clip((np.minimum(part, p) - low) / (high - low), 0, 1) if high > low else np.zeros_like(part)
            px = np.expm1(np.clip(run(u[None], unit[None])[0], 0, 1) * np.log1p(max_depth))
            ramps = []
            for at, n in ((y, h), (x, w)):
                r = np.ones(side)
                for k in range(side):
                    if k >= side - shared:
                        r[k] = 1.0 if at == n - side else (side - k) / (shared + 1)
                    elif k < shared:
                        r[k] = 1.0 if at == 0 else (k + 1) / (shared + 1)
                ramps.append(np.clip(r, 1e-3, 1))
            weight_ = np.outer(*ramps)
            sums[y : y + side, x : x + side] += px * weight_
            weights[y : y + side, x : x + side] += weight_
    return np.clip((sums / weights)[: dem.shape[0], : dem.shape[1]], 0, max_depth)


def rasters(folder, ratio=(10, 3), shape=(20, 14), shift=(0, 0), more=0, seed=1):
    """Coarse depths of 30 m and elevations of 30 / ratio m that reach ``more`` cells further on every side."""
    random = np.random.default_rng(seed)
    fine = 30 * ratio[1] / ratio[0]
    size = [n * ratio[0] // ratio[1] + 2 * more for n in shape]
    depth = np.where(random.random(shape) < 0.3, 0.0, random.random(shape) * 4).astype(np.float32)
    dem = (200 + 50 * random.random(size)).astype(np.float32)
    (folder / "depth.tif").write_bytes(geotiff.encode(depth, 30.0, -30.0, LEFT, TOP, -9999.0, crs=CRS))
    (folder / "dem.tif").write_bytes(geotiff.encode(dem, fine, -fine, LEFT - more * fine + shift[1] * fine, TOP + more * fine - shift[0] * fine, -9999.0, crs=CRS, rows=16))
    return depth.astype(float), dem.astype(float), fine


def test_taps_match_brute_force():
    random = np.random.default_rng(4)
    for source, target, n, m in (((0.0, 1.0), (0.0, 2 / 3), 12, 18), ((5.0, -2.0), (5.0, -3.5), 21, 12), ((0.0, 1.0), (-0.25, 1.0), 9, 9), ((0.0, 1.0), (0.0, 1.0), 7, 7), ((0.0, 1.875), (0.0, 3.0), 32, 20)):
        values = random.random((n, n))
        values[random.random((n, n)) < 0.1] = np.nan
        t = arrays.taps(Axis(*source), Axis(*target), 0, m, n)
        got = arrays.resampled(values, t, t, 0, 0)
        assert np.allclose(got, resample(values, [(*source, n)] * 2, [(*target, m)] * 2), equal_nan=True, atol=1e-9)


def test_resampled_arrays_meet_at_borders(spark):
    random = np.random.default_rng(5)
    values = random.random((50, 37))
    cells = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(50) for c in range(37) if (r, c) != (9, 9)], "r long, c long, v double")
    values[9, 9] = np.nan
    source, target = Grid(50, 37, Axis(0, 3.0), Axis(0, 3.0)), Grid(30, 22, Axis(1.0, 5.0), Axis(0.5, 5.0))
    for block in (7, 64):
        out = arrays.cells_of(arrays.resample_arrays(arrays.tile_arrays(cells, "v", 50, 37, 16), source, target, block), "v").collect()
        got = np.full((30, 22), np.nan)
        for r in out:
            got[r.r, r.c] = r.v
        assert np.allclose(got, resample(values, [(0, 3.0, 50), (0, 3.0, 37)], [(1.0, 5.0, 30), (0.5, 5.0, 22)]), equal_nan=True)


def test_cells_are_resampled_without_tiles_between(spark):
    random = np.random.default_rng(6)
    values = random.random((26, 19))
    values[3, 3] = np.nan
    cells = spark.createDataFrame([(r, c, float(values[r, c]) if (r, c) != (3, 3) else None) for r in range(26) for c in range(19)], "r long, c long, v double")
    source, target = Grid(26, 19, Axis(0, 0.5), Axis(0, 0.5)), Grid(39, 28, Axis(0, 1 / 3), Axis(0, 1 / 3))
    got = np.full((39, 28), np.nan)
    for r in arrays.cells_of(arrays.resample_cells(cells, "v", source, target, 8), "v").collect():
        got[r.r, r.c] = r.v
    assert np.allclose(got, resample(values, [(0, 0.5, 26), (0, 0.5, 19)], [(0, 1 / 3, 39), (0, 1 / 3, 28)]), equal_nan=True)


def test_plans_hold_no_taps(spark, monkeypatch):
    """Taps are as many as a grid's rows: tasks make those of their own block, and plans know where blocks begin and end."""
    for source, target, n, m in ((Axis(0.0, 1.0), Axis(0.0, 2 / 3), 12, 18), (Axis(1.0, 3.0), Axis(0.5, 5.0), 50, 30), (Axis(0.0, 1.0), Axis(-0.25, 1.0), 9, 9)):
        low = np.arange(0, m, 4)
        high = np.minimum(low + 4, m)
        each = [arrays.taps(source, target, int(a), int(b), n) for a, b in zip(low, high, strict=True)]
        spans = arrays.tapped(source, target, low, high, n)
        assert spans.low.tolist() == [t.first for t in each] and spans.high.tolist() == [t.last for t in each]

    def refuse(*_):
        raise AssertionError("taps were made by the driver")

    monkeypatch.setattr(arrays, "taps", refuse)
    cells = spark.createDataFrame([(0, 0, 1.0)], "r long, c long, v double")
    tall = [Grid(n * 1000, n, Axis(0.0, 1 / n), Axis(0.0, 1 / n)) for n in (1, 2, 3)]
    arrays.resample_cells(cells, "v", tall[1], tall[2])
    arrays.super_resolve(cells, cells, tall[0], tall[1], BilinearPredictor(3), 8, 2, 5.0)


def test_packing_is_bounded():
    """However large the arrays that come in, cells are packed PACKED at a time, and none is lost."""
    n = (1 << 20) + 5
    whole = arrays.Spans(np.array([0]), np.array([n])), arrays.Spans(np.array([0]), np.array([1]))
    sizes = [len(px) // 8 for batch in arrays.packed(iter([(np.arange(n), np.zeros(n, np.int64), np.ones(n))]), *whole) for px in batch["px"].to_pylist()]
    assert sum(sizes) == n and max(sizes) <= 1 << 18


def test_packing_memory_does_not_grow():
    """A task that packs four times the cells, spread over all blocks as a join leaves them, holds no more at once."""
    peaks = []
    for n in (1 << 19, 1 << 21):
        rows = n // 128
        spans = arrays.Spans(np.arange(0, rows, 128), np.arange(0, rows, 128) + 128), arrays.Spans(np.array([0]), np.array([128]))
        batches = (np.arange(k, n, n // 8192) for k in range(n // 8192))
        tracemalloc.start()
        assert sum(len(px.as_py()) // 8 for batch in arrays.packed(((x // 128, x % 128, x / n) for x in batches), *spans) for px in batch["px"]) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 64e6


@pytest.mark.parametrize(("ratio", "more"), [((10, 1), 0), ((15, 1), 3), ((4, 1), 2)])
def test_files_at_any_scale(spark, tmp_path, ratio, more):
    """30 m to 3 m, 2 m and 7.5 m by a network that makes four cells of one; elevations reach further than depths."""
    depth, dem, fine = rasters(tmp_path, ratio, (19, 11), more=more)
    model = toy(tmp_path / "m.onnx")
    (tmp_path / scenes.SIDECAR).write_text(json.dumps({"max_depth": 4.5, "dem_pct_clip": 90.0, "upscale": 9, "input_shape": [8, 8, 1]}))
    out = tmp_path / "out.tif"
    assert cli.main(["tohr", "--in", str(tmp_path / "depth.tif"), "--dem", str(tmp_path / "dem.tif"), "--out", str(out), "--model-path", str(model), "--dem-pct-clip", "95"]) == 0
    got, grid = geotiff.decode(out.read_bytes())
    assert grid == {"a": fine, "e": -fine, "c": LEFT, "f": TOP, "nodata": -9999.0} and geotiff.header(out.read_bytes())["crs"] == CRS
    cut = dem[more : dem.shape[0] - more, more : dem.shape[1] - more]
    coarse, target = [(0, 30.0, n) for n in depth.shape], [(0, fine, n) for n in cut.shape]
    ours = [(0, 7.5, 4 * n) for n in depth.shape]
    p = OnnxPredictor.of(str(model))
    p.load()
    on_model = resample(cut, target, ours)
    want = whole(depth, on_model, p.run, 4, 8, 2, max_depth=4.5)
    want = np.clip(resample(want, ours, target), 0, 4.5)
    assert coarse and got.shape == cut.shape and np.allclose(got, np.where(want < 1e-3, 0, want), atol=1e-4)


def test_native_scale_and_hard_windows(spark, tmp_path):
    depth, dem, fine = rasters(tmp_path, (4, 1), (17, 9))
    out = tmp_path / "out.tif"
    for method, overlap in (("feather", 2), ("hard", 0)):
        assert cli.main(["tohr", "--in", str(tmp_path / "depth.tif"), "--dem", str(tmp_path / "dem.tif"), "--out", str(out), "--tile-size", "8", "--window-method", method]) == 0
        want = whole(depth, dem, BilinearPredictor(4).run, 4, 8, overlap)
        assert np.allclose(geotiff.decode(out.read_bytes())[0], np.where(want < 1e-3, 0, want), atol=1e-4)


def test_bad_inputs_are_refused(spark, tmp_path, caplog):
    depth, dem, fine = rasters(tmp_path, (2, 1), (8, 8))
    low, high, out = tmp_path / "depth.tif", tmp_path / "dem.tif", tmp_path / "out.tif"
    ask = lambda: cli.main(["tohr", "--in", str(low), "--dem", str(high), "--out", str(out), "--tile-size", "4"])
    encode = lambda a, res, crs=CRS, left=LEFT, nodata=-9999.0: geotiff.encode(a, res, -res, left, TOP, nodata, crs=crs)
    sound_low, sound_high = low.read_bytes(), high.read_bytes()
    assert ask() == 0
    low.write_bytes(encode(depth, 30.0, None))
    assert ask() == 0 and "no coordinate system" in caplog.text
    for name, bad_low, bad_high, said in (
        ("nan", encode(np.where(depth > 3, np.nan, depth), 30.0), sound_high, "finite"),
        ("negative", encode(depth - 1, 30.0), sound_high, "negative"),
        ("nan ground", sound_low, encode(np.where(dem > 240, np.inf, dem), fine), "finite"),
        ("system", encode(depth, 30.0, "EPSG:32632"), sound_high, "differ"),
        ("degrees", encode(depth, 30.0, "EPSG:4326"), encode(dem, fine, "EPSG:4326"), "projected"),
        ("neither", encode(depth, 30.0, None), encode(dem, fine, None), "no coordinate system"),
        ("small", sound_low, encode(dem[:, :-1], fine), "cover"),
        ("between cells", sound_low, encode(np.pad(dem, 1), fine, left=LEFT - fine * 0.8), "edges"),
    ):
        low.write_bytes(bad_low)
        high.write_bytes(bad_high)
        caplog.clear()
        assert ask() == 1 and said in caplog.text, name


def test_nodata_counts_as_zero_and_blocks_are_pruned(spark, tmp_path):
    depth, dem, fine = rasters(tmp_path, (2, 1), (8, 8), more=40)
    hole = depth.copy()
    hole[2, 3] = -9999.0
    (tmp_path / "depth.tif").write_bytes(geotiff.encode(hole, 30.0, -30.0, LEFT, TOP, -9999.0, crs=CRS))
    placed = scenes.place(spark, scenes.header(spark, str(tmp_path / "depth.tif")), scenes.header(spark, str(tmp_path / "dem.tif")))
    assert (placed.row, placed.column, placed.fine.height, placed.fine.width, placed.ratio) == (40, 40, 16, 16, 2.0)
    part = scenes.read(spark, str(tmp_path / "dem.tif"), 40, 40, 16, 16)
    assert {(r.r, r.c): r.value for r in part.collect()} == {(i, j): dem[40 + i, 40 + j] for i in range(16) for j in range(16)}
    data = bytearray((tmp_path / "dem.tif").read_bytes())
    for b in geotiff.layout(bytes(data)):
        if b["y"] >= 56 or b["y"] + b["height"] <= 40:
            data[b["place"] : b["place"] + b["count"]] = b"\0" * b["count"]  # no decoder would take these
    (tmp_path / "dem.tif").write_bytes(bytes(data))
    assert scenes.read(spark, str(tmp_path / "dem.tif"), 40, 40, 16, 16).count() == 256
    hole[2, 3] = 0
    want = whole(hole, dem[40:56, 40:56], BilinearPredictor(2).run, 2, 4, 1)
    scene = scenes.super_resolve(spark, str(tmp_path / "depth.tif"), str(tmp_path / "dem.tif"), placed, BilinearPredictor(2), 4, 1)
    got = {(r.r, r.c): r.depth for r in arrays.cells_of(scene, "depth").collect()}
    assert all(abs(got[i, j] - (want[i, j] if want[i, j] >= 1e-3 else 0)) < 1e-9 for i in range(16) for j in range(16)) and len(got) == 256


def test_odd_scenes(spark):
    """Absent, repeated and null cells, clashing columns, and no cells at all."""
    schema = "r long, c long, v double, z double, y long, px string"
    cells = [(r, c, None if (r, c) == (1, 1) else 1.0, float(r + c), 5, "x") for r in range(4) for c in range(4) if (r, c) != (2, 2)]
    low = spark.createDataFrame([*cells, cells[0]], schema)
    high = spark.createDataFrame([(r, c, 0.0, float(r * c), 1, None) for r in range(8) for c in range(8)], schema)
    grids = Grid(4, 4, Axis(0, 2.0), Axis(0, 2.0)), Grid(8, 8)
    ask = lambda a, b: {(x.r, x.c): x.depth for x in arrays.cells_of(arrays.super_resolve(a.select("r", "c", "v"), b.select("r", "c", "z"), *grids, BilinearPredictor(2), 2, 1, 5.0), "depth").collect()}
    d = np.ones((4, 4))
    d[1, 1] = d[2, 2] = 0
    want = whole(d, np.multiply.outer(np.arange(8.0), np.arange(8.0)), BilinearPredictor(2).run, 2, 2, 1)
    got = ask(low, high)
    assert len(got) == 64 and all(abs(got[k] - (want[k] if want[k] >= 1e-3 else 0)) < 1e-9 for k in got)
    assert set(ask(low.limit(0), high).values()) == {0.0}
    assert ask(low.limit(0), high.limit(0)) == {}
    empty = Grid(0, 0)
    assert arrays.super_resolve(low.select("r", "c", "v"), high.select("r", "c", "z"), empty, empty, BilinearPredictor(2), 2, 1, 5.0).count() == 0
    for bad in ({"max_depth": 0.0}, {"max_depth": 5.0, "percent": 0.0}):
        with pytest.raises(ValueError):
            arrays.super_resolve(low, high, *grids, BilinearPredictor(2), 2, 1, **bad)


def test_options_have_an_order(tmp_path):
    model = tmp_path / "m.onnx"
    assert scenes.options(model) == scenes.Options(5.0, 95.0, None, None, None, 2.0)
    (tmp_path / scenes.SIDECAR).write_text(json.dumps({"max_depth": 3, "dem_stats": {"p_clip": 9, "dem_min": 1, "dem_max": 8}, "input_shape": [32.0, 32, 1], "upscale": 16, "dem_fp": "x/010_dem.tif"}))
    assert scenes.options(model) == scenes.Options(3.0, 95.0, {"p_clip": 9.0, "dem_min": 1.0, "dem_max": 8.0}, 32, 16, 10.0)
    assert scenes.options(model, 2.0, 80.0)[:2] == (2.0, 80.0)
    (tmp_path / scenes.SIDECAR).write_text(json.dumps({"dem_stats": {"p_clip": 9}, "input_shape": [1.5]}))
    assert scenes.options(model)[2:4] == (None, None)


def test_given_statistics():
    z = np.arange(32.0).reshape(2, 4, 4)
    got = arrays.normalised(z, 95.0, {"p_clip": 20.0, "dem_min": 4.0, "dem_max": 20.0})
    assert np.allclose(got, np.clip((np.minimum(z, 20) - 4) / 16, 0, 1))
    with pytest.raises(ValueError):
        arrays.normalised(z + 1, 95.0, {"p_clip": 20.0, "dem_min": 4.0, "dem_max": 4.0})
    with pytest.raises(ValueError, match="flat"):
        arrays.normalised(np.ones((1, 2, 2)), 95.0)
    assert not arrays.normalised(np.zeros((1, 2, 2)), 95.0).any()


def test_networks(spark, tmp_path):
    model = toy(tmp_path / "m.onnx")
    assert onnx.scale_of(str(model)) == (8, 4)
    rows = onnx.read_tensors(spark.read.format("binaryFile").load(str(model))).collect()
    assert sorted((r.role, r.name, r.dims) for r in rows) == [("input", "dem", [-1, 32, 32, 1]), ("input", "depth", [-1, 8, 8, 1]), ("output", "out", [-1, 32, 32, 1]), ("weight", "b", [1]), ("weight", "sizes", [4]), ("weight", "w", [1])]
    for bad in (b"", b"nothing", model.read_bytes()[:-5]):
        with pytest.raises(ValueError):
            onnx.tensors(bad)
    p = OnnxPredictor(str(model), 4, ("NoSuchProvider",))
    with pytest.raises(ValueError, match="NoSuchProvider"):
        p.load()
    with pytest.raises(ValueError, match="scale"):
        OnnxPredictor(str(model), 3).load()
