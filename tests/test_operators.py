import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import align, metrics, normalize, predict, tiling, validate


def cells(spark, grid, name="v"):
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, f"r long, c long, {name} double")


def grid_of(df, name="v"):
    rows = df.collect()
    out = np.full((max(r.r for r in rows) + 1, max(r.c for r in rows) + 1), np.nan)
    for r in rows:
        out[r.r, r.c] = np.nan if r[name] is None else r[name]
    return out


def values(spark, xs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_scalar_formulas(spark):
    xs = [-1.0, 0.0, 0.0005, 0.3, 5.0, 9.0, None]
    unit = values(spark, xs, lambda x: scalar.depth_to_unit(x, 5.0))
    want = np.clip(np.log1p(np.clip(xs[:-1], 0, 5)) / np.log1p(5), 0, 1)
    assert np.allclose(unit[:-1], want) and unit[-1] is None
    back = values(spark, xs, lambda x: scalar.unit_to_depth(scalar.depth_to_unit(x, 5.0), 5.0))
    assert np.allclose(back[:-1], np.clip(xs[:-1], 0, 5))
    assert values(spark, xs, lambda x: scalar.mask_dry(x, 5.0)) == [0, 0, 0, 0.3, 5, 5, None]
    assert values(spark, [-9999.0, -9999.05, -9998.0, 0.0], lambda x: scalar.nodata_to_zero(x, -9999.0)) == [0, 0, -9998.0, 0]
    for bad in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            scalar.depth_to_unit(F.lit(1.0), bad)


def test_flat_dem_tiles(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0)], "r long, c long, z double").withColumn("t", F.lit(1))
    assert {r.z_unit for r in normalize.normalize_tiles(df, "z", ["t"]).collect()} == {0.0}
    with pytest.raises(Exception, match="flat"):
        normalize.normalize_tiles(df.withColumn("z", F.lit(7.0)), "z", ["t"]).collect()


def test_tile_statistics(spark):
    z = np.random.default_rng(1).normal(50, 40, (16, 16))
    df = cells(spark, z, "z").withColumn("t", F.expr("r div 8"))
    stats = {r.t: r for r in normalize.tile_stats(df, "z", ["t"]).collect()}
    for t in (0, 1):
        a = np.clip(z[t * 8 : t * 8 + 8], 0, None)
        p = np.percentile(a, 95)
        assert np.allclose([stats[t].p_clip, stats[t].dem_min, stats[t].dem_max], [p, min(a.min(), p), min(a.max(), p)])
    for bad in (0, 101, float("nan")):
        with pytest.raises(ValueError):
            normalize.tile_stats(df, "z", ["t"], bad)
    with pytest.raises(ValueError):
        normalize.check_stats({"p_clip": 1, "dem_min": 3, "dem_max": 3})
    assert normalize.check_stats({"p_clip": 1, "dem_min": 0, "dem_max": 3}) == (1.0, 0.0, 3.0)


def bilinear(a, s):
    h, w = a.shape
    y, x = (np.clip((np.arange(n * s) + 0.5) / s - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return a[y0][:, x0] * (1 - fy) * (1 - fx) + a[y0][:, x1] * (1 - fy) * fx + a[y1][:, x0] * fy * (1 - fx) + a[y1][:, x1] * fy * fx


@pytest.mark.parametrize("scale", [1, 2, 3])
def test_resampling(spark, scale):
    a = np.random.default_rng(2).random((5, 7))
    got = grid_of(align.resample_bilinear(cells(spark, a), "v", scale, 5, 7))
    assert np.allclose(got, bilinear(a, scale))
    assert np.array_equal(grid_of(align.upsample_nearest(cells(spark, a), scale)), np.kron(a, np.ones((scale, scale))))
    targets = align.upsample_nearest(cells(spark, a), scale).select("r", "c")
    assert np.array_equal(grid_of(align.resample_nearest(cells(spark, a), targets, scale)), np.kron(a, np.ones((scale, scale))))
    assert np.allclose(grid_of(align.average_pool(align.upsample_nearest(cells(spark, a), scale), "v", scale)), a)


def test_bilinear_leaves_gaps_out(spark):
    a = np.array([[1.0, np.nan], [1.0, np.nan]])
    assert np.allclose(grid_of(align.resample_bilinear(cells(spark, a), "v", 2, 2, 2))[:, :3], 1.0)


def test_padding_and_windows(spark):
    a = np.arange(1.0, 36).reshape(5, 7)
    padded = grid_of(align.pad_grid(cells(spark, a), ["v"], 4))
    assert padded.shape == (8, 8) and np.array_equal(padded[:5, :7], a) and padded.sum() == a.sum()
    assert np.array_equal(grid_of(align.read_window(cells(spark, a), 1, 2, 3, 4)), a[1:4, 2:6])
    assert align.window_of_bounds((20.9, -86.4, 141.2, -7.1), 0, 0, 2.0) == (3, 10, 40, 60)
    with pytest.raises(ValueError):
        align.window_of_bounds((1, 0, 0, 1), 0, 0, 1)
    assert align.pad_grid(cells(spark, a).limit(0), ["v"], 4).count() == 0


def test_mosaic_order(spark):
    rows = [(0, 0, 1, 5.0), (0, 0, 2, None), (0, 0, 3, 7.0), (0, 1, 1, 4.0), (0, 1, 9, None)]
    df = spark.createDataFrame(rows, "r long, c long, o long, v double")
    assert {(r.r, r.c): r.v for r in align.mosaic_last_wins(df, "v", "o").collect()} == {(0, 0): 7.0, (0, 1): 4.0}


def starts(total, tile, stride):
    out = list(range(0, max(total - tile + 1, 1), stride))
    return out if out[-1] == total - tile else [*out, total - tile]


def ramp(tile, overlap):
    w = np.ones(tile)
    if overlap:
        w[:overlap] = np.arange(1, overlap + 1) / (overlap + 1)
        w[-overlap:] = np.arange(overlap, 0, -1) / (overlap + 1)
    return np.clip(w, 1e-3, 1)


def test_window_starts(spark):
    df = spark.createDataFrame([(t,) for t in (20, 21, 32, 33, 44, 100)], "total long")
    got = {}
    for r in tiling.tile_starts(df, "total", 20, 12).orderBy("i").collect():
        got.setdefault(r.total, []).append(r.start)
    assert got == {t: sorted(starts(t, 20, 12)) for t in got} and len(got) == 6
    for bad in (-1, 20):
        with pytest.raises(ValueError):
            tiling.stride_of(20, bad)


@pytest.mark.parametrize(("tile", "overlap"), [(8, 0), (8, 3), (8, 6)])
def test_feather(spark, tile, overlap):
    got = [r[0] for r in spark.range(tile).orderBy("id").select(tiling.feather(F.col("id"), tile, overlap)).collect()]
    assert np.allclose(got, ramp(tile, overlap))


@pytest.mark.parametrize("overlap", [2, 5])
def test_feather_blend(spark, overlap):
    tile, a = 8, np.random.default_rng(3).random((19, 14))
    windows = tiling.window_origins(spark, 19, 14, tile, tiling.stride_of(tile, overlap))
    covered = tiling.covering_windows(cells(spark, a), windows, tile).withColumn("v", F.col("v") + F.col("y0") * 0.1)
    got = grid_of(tiling.feather_blend(tiling.weighted(covered, tile, overlap), "v"))
    total, weight, ys, xs = np.zeros(a.shape), np.zeros(a.shape), starts(19, tile, tile - overlap), starts(14, tile, tile - overlap)
    for y in ys:
        for x in xs:
            wy, wx = ramp(tile, overlap), ramp(tile, overlap)
            wy[:overlap] = 1 if y == ys[0] else wy[:overlap]
            wy[-overlap:] = 1 if y == ys[-1] else wy[-overlap:]
            wx[:overlap] = 1 if x == xs[0] else wx[:overlap]
            wx[-overlap:] = 1 if x == xs[-1] else wx[-overlap:]
            w = np.outer(wy, wx)
            total[y : y + tile, x : x + tile] += w * (a[y : y + tile, x : x + tile] + y * 0.1)
            weight[y : y + tile, x : x + tile] += w
    assert np.allclose(got, total / weight)
    constant = tiling.feather_blend(tiling.weighted(covered.withColumn("v", F.lit(3.0)), tile, overlap), "v")
    assert np.allclose(grid_of(constant), 3.0)


def test_no_nested_loops(spark):
    windows = tiling.window_origins(spark, 64, 64, 16, 12)
    plan = tiling.covering_windows(cells(spark, np.zeros((4, 4))), windows, 16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hard_mosaic_and_numbering(spark):
    a = np.arange(48.0).reshape(6, 8)
    tiles = [(y, x, a[y : y + 2, x : x + 4].ravel().tolist()) for y in (0, 2, 4) for x in (0, 4)]
    assert np.array_equal(grid_of(tiling.hard_mosaic(spark.createDataFrame(tiles, "y0 long, x0 long, px array<double>"), "px", 4)), a)
    some = cells(spark, np.where(a % 3 == 0, np.nan, a)).where("v is not null")
    assert [r.k for r in tiling.numbered(some, "k").orderBy("r", "c").collect()] == list(range(1, some.count() + 1))


def test_error_metrics(spark):
    g = np.random.default_rng(4)
    x, y = g.random(500) * 5, g.random(500) * 5
    x[:50] = 0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = metrics.error_metrics(df, "x", "y", 5.0).first()
    d = y - x
    c1, c2 = 0.05**2, 0.15**2
    ssim = (2 * x.mean() * y.mean() + c1) * (2 * np.mean((x - x.mean()) * (y - y.mean())) + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var() + y.var() + c2))
    want = [20 * np.log10(5) - 10 * np.log10(np.mean(d**2)), ssim, np.sqrt(np.mean(d**2)), np.sqrt(np.mean(d[50:] ** 2)), np.abs(d).mean(), np.abs(d).mean(), d.mean(), np.mean(d**2), 50, 450]
    assert np.allclose(list(m), want)
    perfect = metrics.error_metrics(df, "x", "x", 5.0).first()
    assert perfect.psnr is None and perfect.ssim == pytest.approx(1)
    assert metrics.error_metrics(df.where("x = 0"), "x", "y", 5.0).first().rmse_wet_m is None
    with pytest.raises(ValueError):
        metrics.error_metrics(df, "x", "y", 0)


def test_comparison_directions(spark):
    long = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 1.9), ("b", 1.0, 3.0), ("b", 2.0, 2.5)], "method string, x double, y double")
    got = {r.metric: r.better for r in metrics.compare(metrics.error_metrics(long, "x", "y", 5.0, ("method",)), "method", "a", "b").collect()}
    assert len(got) == 6 and all(got.values())


def test_histogram(spark):
    v = np.random.default_rng(5).random(300)
    df = spark.createDataFrame([(float(x),) for x in [*v, 1.0, 2.0]], "v double")
    got = {r.bin: r.n for r in metrics.histogram(df, "v", 0.0, 1.0, 10).collect()}
    assert [got.get(k, 0) for k in range(10)] == np.histogram([*v, 1.0], 10, (0, 1))[0].tolist()


def test_validation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, float("nan")), (float("inf"), 3.0), (None, 1.0)], "d double, z double")
    r = validate.violations(df, "d", "z").first()
    assert tuple(r) == (4, 2, 1, 1, False)
    with pytest.raises(TypeError):
        validate.violations(df.select(F.lit("x").alias("d"), "z"), "d", "z")


def test_predictors(spark):
    g = np.random.default_rng(6)
    tiles = [(k, g.random(16).tolist(), g.random(64).tolist()) for k in range(5)]
    df = spark.createDataFrame(tiles, "k int, depth array<double>, dem array<double>")
    out = {r.k: r.px for r in predict.predict_tiles(df, predict.BilinearPredictor(2), "depth", "dem", 4).collect()}
    for k, depth, _ in tiles:
        assert np.allclose(np.reshape(out[k], (8, 8)), bilinear(np.reshape(depth, (4, 4)), 2))
    with pytest.raises(Exception, match="from 0 to 1"):
        predict.predict_tiles(df.withColumn("depth", F.transform("depth", lambda x: x + 2)), predict.BilinearPredictor(2), "depth", "dem", 4).collect()
    with pytest.raises(Exception, match="pixels"):
        predict.predict_tiles(df, predict.BilinearPredictor(4), "depth", "dem", 4).collect()


def test_gathering_tiles(spark):
    rows = [(0, 0, i, j, float(i * 2 + j)) for i in (1, 0) for j in (1, 0)]
    df = spark.createDataFrame(rows, "y0 int, x0 int, i int, j int, v double")
    assert predict.gather_tiles(df, "v", 2).first().v == [0, 1, 2, 3]
    with pytest.raises(Exception, match="gaps"):
        predict.gather_tiles(df.limit(3), "v", 2).collect()


def test_numbered_over_blocks(spark):
    cells = spark.createDataFrame([(r, c) for r in (0, 1, 4, 5, 9, 20) for c in range(r % 4 + 1)], "r long, c long")
    got = tiling.numbered(cells, "n", block=3).orderBy("r", "c").collect()
    assert [row.n for row in got] == list(range(1, len(got) + 1)) and tiling.numbered(cells.limit(0), "n").count() == 0


def test_percentiles_narrow_down(spark, monkeypatch):
    """Against numpy: spread, skewed, repeated and few values, with hardly any sorted at once."""
    from gridloom.operators import metrics

    g = np.random.default_rng(11)
    cases = {"spread": g.random(5000), "skewed": 10.0 ** g.uniform(-300, 300, 3000), "few": g.integers(0, 3, 4000).astype(float), "mixed": np.concatenate([np.zeros(3000), g.random(1000)]), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "signs": g.normal(size=3001)}
    monkeypatch.setattr(metrics, "ACCURACY", 50)
    for name, values in cases.items():
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "e double").repartition(5)
        for most, percent in ((3, 98), (200, 37.5)) if name != "mixed" else ((3, 0), (3, 100), (200, 75)):
            monkeypatch.setattr(metrics, "SORTED", most)
            assert metrics.exact_percentile(df, "e", percent) == pytest.approx(np.percentile(values, percent), rel=1e-12), (name, most, percent)
    assert metrics.exact_percentile(df.where("e is null"), "e", 50) is None
    with pytest.raises(ValueError):
        metrics.exact_percentile(df, "e", 101)
