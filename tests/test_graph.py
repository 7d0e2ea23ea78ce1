import heapq
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chessboard, graph, growth

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def dijkstra(cost, seeds, geometric=True):
    best, heap = {}, [(0.0, s, s) for s in seeds if not math.isnan(cost[s])]
    heapq.heapify(heap)
    while heap:
        d, s, k = heapq.heappop(heap)
        if k in best:
            continue
        best[k] = (d, s)
        for a, b in AROUND:
            n = (k[0] + a, k[1] + b)
            if 0 <= n[0] < cost.shape[0] and 0 <= n[1] < cost.shape[1] and not math.isnan(cost[n]):
                heapq.heappush(heap, (d + (cost[k] + cost[n]) / 2 * (math.sqrt(2) if geometric and a and b else 1), s, n))
    return best


def frame(spark, cost, seeds):
    rows = [(r, c, None if math.isnan(cost[r, c]) else float(cost[r, c]), float(r * 100 + c) if (r, c) in seeds else None) for r in range(cost.shape[0]) for c in range(cost.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, cost double, seed double")


@pytest.mark.parametrize("tile", [7, 128])
def test_allocation(spark, tile):
    g = np.random.default_rng(1)
    cost = 1 + g.random((30, 26)) * 3
    cost[g.random(cost.shape) < 0.2] = math.nan
    seeds = {(int(r), int(c)) for r, c in zip(g.integers(0, 30, 9), g.integers(0, 26, 9), strict=True)}
    got = {(r.r, r.c): r for r in graph.allocate(frame(spark, cost, seeds), "cost", "seed", 9.0, tile=tile).collect()}
    want = {k: v for k, v in dijkstra(cost, seeds).items() if v[0] <= 9.0}
    assert set(got) == set(want)
    for k, (d, s) in want.items():
        assert got[k].distance == pytest.approx(d) and (got[k].src_r, got[k].src_c) == s and got[k].value == s[0] * 100 + s[1]


def test_distances_and_nearest(spark):
    g = np.random.default_rng(2)
    open_ = g.random((20, 20)) > 0.25
    seeds = {(3, 3), (15, 12)}
    rows = [(r, c, (r, c) in seeds) for r in range(20) for c in range(20) if open_[r, c] or (r, c) in seeds]
    df = spark.createDataFrame(rows, "r long, c long, s boolean")
    cost = np.where(open_, 1.0, math.nan)
    for s in seeds:
        cost[s] = 1.0
    want = {k: d for k, (d, _) in dijkstra(cost, seeds).items() if d <= 12}
    got = {(r.r, r.c): r.distance for r in graph.geodesic_distance(df, "s", 12.0, tile=6).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    full = spark.createDataFrame([(r, c, float(r + c) if (r, c) in seeds else None) for r in range(20) for c in range(20)], "r long, c long, v double")
    for r in graph.nearest_fill(full, "v", 5, tile=6).collect():
        near = min(max(abs(r.r - a), abs(r.c - b)) for a, b in seeds)
        assert r.distance == near <= 5 and r.v in {float(a + b) for a, b in seeds if max(abs(r.r - a), abs(r.c - b)) == near}


def nearest_by_hand(values, limit=None):
    held = [(r, c) for r, c in np.argwhere(~np.isnan(values)).tolist()]
    out = {}
    for r in range(values.shape[0]):
        for c in range(values.shape[1]):
            if held:
                d, s = min((max(abs(r - a), abs(c - b)), (a, b)) for a, b in held)
                if limit is None or d <= limit:
                    out[r, c] = (d, s, values[s])
    return out


@pytest.mark.parametrize("band", [1, 40, 1 << 20])
def test_nearest_without_rounds(spark, monkeypatch, band):
    monkeypatch.setattr(chessboard, "BAND", band)
    g = np.random.default_rng(7)
    for share, shape, limit in ((0.02, (31, 17), None), (0.3, (9, 40), 2), (0.004, (40, 23), 6), (1.0, (3, 3), None), (0.1, (1, 30), None), (0.1, (30, 1), None), (0.0, (4, 4), None)):
        values = np.where(g.random(shape) < share, g.integers(0, 9, shape).astype(float), math.nan)
        rows = [(r, c, None if math.isnan(values[r, c]) else float(values[r, c]), "x") for r in range(shape[0]) for c in range(shape[1])]
        df = spark.createDataFrame(rows, "r long, c long, v double, value string")
        got = {(r.r, r.c): (r.distance, (r.src_r, r.src_c), r.v) for r in chessboard.nearest(df, "v", *shape, limit).collect()}
        assert got == nearest_by_hand(values, limit)


def test_nearest_over_gaps_and_rectangles(spark):
    """The plan of a rectangle has no rounds; a gap, which ways must go around, brings them back. Results agree."""
    g = np.random.default_rng(8)
    values = np.where(g.random((12, 15)) < 0.05, 1.0 + g.integers(0, 5, (12, 15)), math.nan)
    cells = [(r - 3, c + 5, None if math.isnan(values[r, c]) else float(values[r, c])) for r in range(12) for c in range(15)]
    df = spark.createDataFrame([*cells, (None, 1, 2.0)], "r int, c int, v double")
    want = {(r - 3, c + 5): (d, v) for (r, c), (d, _, v) in nearest_by_hand(values).items()}
    assert {(r.r, r.c): (r.distance, r.v) for r in graph.nearest_fill(df, "v").collect()} == want
    again = spark.createDataFrame([*cells, cells[-1]], "r int, c int, v double")
    assert {(r.r, r.c): (r.distance, r.v) for r in graph.nearest_fill(again, "v", tile=6).collect()} == want


def flood(wet):
    labels, seen = {}, set()
    for start in sorted(wet):
        if start in seen:
            continue
        part, open_ = [], [start]
        seen.add(start)
        while open_:
            k = open_.pop()
            part.append(k)
            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                n = (k[0] + a, k[1] + b)
                if n in wet and n not in seen:
                    seen.add(n)
                    open_.append(n)
        labels |= dict.fromkeys(part, min(part))
    return labels


@pytest.mark.parametrize("tile", [5, 128])
def test_components(spark, tile):
    g = np.random.default_rng(3)
    wet = {(int(r), int(c)) for r, c in np.argwhere(g.random((24, 24)) < 0.58)}
    df = spark.createDataFrame(sorted(wet), "r long, c long")
    want = flood(wet)
    got = {(r.r, r.c): r.label for r in graph.label_components(df, tile).collect()}
    assert got == {k: a * (1 << 32) + b for k, (a, b) in want.items()}
    anchors = sorted(wet)[::40]
    kept = {(r.r, r.c) for r in graph.keep_anchored(df, spark.createDataFrame(anchors, "r long, c long"), tile).collect()}
    assert kept == {k for k in wet if want[k] in {want[a] for a in anchors}}
    assert graph.label_components(df.limit(0), tile).count() == 0


def test_growth(spark):
    coarse = spark.createDataFrame([(r, c, 10.0 if c < 3 else None) for r in range(6) for c in range(8)], "r long, c long, wse double")
    z = lambda r, c: 20.0 if c == 12 else 5.0  # noqa: E731  a wall with wet ground before it and dry ground behind
    dem = spark.createDataFrame([(r, c, z(r, c)) for r in range(12) for c in range(16)], "r long, c long, z double")
    out = {(r.r, r.c): r for r in growth.grow(coarse, dem, 2, 6, 8, decay=0.01).collect()}
    assert out[5, 0].phase == "anchor" and out[5, 0].depth == pytest.approx(5)
    assert out[5, 10].phase == "grown" and 4 < out[5, 10].depth < 5
    assert (5, 12) not in out and not any(c > 12 for _, c in out)
    assert growth.anchors_by_scale(dem, coarse, 2).where(F.col("anchor").isNotNull()).count() == 12 * 6


@pytest.mark.parametrize("tile", [16])
def test_paths_of_any_length_over_many_tiles(spark, tile):
    """A winding corridor, walls, uneven costs and ties: no bound, and borders are exchanged until nothing changes."""
    g = np.random.default_rng(5)
    cost = np.round(1 + g.random((40, 22)) * 2, 1)
    cost[g.random(cost.shape) < 0.25] = math.nan
    for c in range(1, 22, 2):
        cost[:, c] = math.nan
        cost[0 if c % 4 == 1 else 39, c] = 1.0
    seeds = {(20, 0), (3, 0)}
    for s in seeds:
        cost[s] = 1.0
    cost[:, ::2] = np.where(np.isnan(cost[:, ::2]), 9.0, cost[:, ::2])
    got = {(r.r, r.c): (r.distance, (r.src_r, r.src_c)) for r in graph.allocate(frame(spark, cost, seeds), "cost", "seed", tile=tile).collect()}
    want = dijkstra(cost, seeds)
    assert got == want and max(d for d, _ in got.values()) > 300


def test_odd_cells(spark):
    rows = [(0, 0, 1.0, 5.0, "x"), (0, 1, 1.0, None, "x"), (0, 1, 4.0, None, "y"), (0, 2, -1.0, None, "x"), (0, 3, math.nan, 2.0, "x"), (None, 1, 1.0, 1.0, None), (1, None, 1.0, 1.0, None), (-1, -1, 1.0, None, "z"), (0, 0, 2.0, 7.0, "again")]
    df = spark.createDataFrame(rows, "r long, c long, cost double, seed double, distance string")
    got = sorted((r.r, r.c, r.distance, r.value) for r in graph.allocate(df, "cost", "seed").collect())
    assert got == [(-1, -1, pytest.approx(math.sqrt(2)), 5.0), (0, 0, 0.0, 5.0), (0, 1, 1.0, 5.0)]
    assert graph.allocate(df.limit(0), "cost", "seed").count() == 0 and graph.label_components(df).count() == 5
    assert graph.nearest_fill(df.where("seed is null"), "seed").count() == 0


def test_a_batch_of_tiles_is_handled_tile_by_tile():
    """A batch has as many tiles as its bytes allow; what is copied of it at once is one tile."""
    tile = np.zeros((graph.TILE, graph.TILE)).tobytes()
    batch = pa.RecordBatch.from_pydict({"ty": list(range(40)), "cost": [tile] * 40})
    tracemalloc.start()
    try:
        assert [row["ty"] for row in graph._each(batch) if row["cost"] == tile] == list(range(40))
        assert tracemalloc.get_traced_memory()[1] < 4 * len(tile)
    finally:
        tracemalloc.stop()


def test_bands_of_nearest_cells():
    """A task of a band holds a quarter of a million cells, or one row or column."""
    for size, across in ((720_000, 200), (200, 720_000), (5, 3)):
        band, spans = chessboard._bands(size, across)
        assert band * across <= max(1 << 18, across) and int((spans.high - spans.low).sum()) == size


def test_flat_ground_floods_to_the_chessboard_limit(spark):
    """Ten coarse cells at scale 8: only the distance limits the growth, as dear as the way may be."""
    coarse = spark.createDataFrame([(r, c, 5.0 if c == 0 else None) for r in range(4) for c in range(14)], "r long, c long, wse double")
    dem = spark.createDataFrame([(r, c, 4.0) for r in range(32) for c in range(112)], "r long, c long, z double")
    out = growth.grow(coarse, dem, 8, 4, 14, decay=0.0)
    anchors = out.where("phase = 'anchor'").agg(F.max("c")).first()[0]
    assert out.agg(F.max("c")).first()[0] == anchors + 79 and out.count() == 32 * (anchors + 80)
    assert growth.grow(coarse, dem, 8, 4, 14, coarse_limit=None, decay=0.0).count() == 32 * 112
