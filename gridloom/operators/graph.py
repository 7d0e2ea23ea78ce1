"""Distances, fills and components over grids, as arrays of tiles that exchange their borders.

A tile is one row with its costs and seeds as arrays; numpy relaxes it whole. What a tile's outermost cells come to is
handed to the eight tiles around it, and tiles that learn something new are relaxed again, until nothing changes: so
paths may be of any length, and a round moves borders, not cells. Components are labelled inside tiles and only the
labels that touch across tile borders are merged in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stash, unstash
from . import chessboard
from .components import components

#: Cells along a tile's side.
TILE = 256
#: Sources are numbered by row and column, so that the first in that order is the least; none is more than all.
_ROW, _COLUMN, _NONE = 1 << 32, 1 << 31, (1 << 63) - 1
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_STRIP = "ty long, tx long, dy int, dx int, cost binary, distance binary, source binary, value binary"
_ARRAYS = (("cost", np.float64), ("distance", np.float64), ("source", np.int64), ("value", np.float64))


def _tile_of(column: str, tile: int):
    return F.floor(F.col(column) / tile)


def _tiles(cells: DataFrame, tile: int) -> DataFrame:
    """ty, tx, cost and seed: each tile's cells (r, c, cost, seed) as arrays, NaN where there is nothing."""

    def build(rows: pa.Table) -> pa.Table:
        ty, tx = rows["ty"][0].as_py(), rows["tx"][0].as_py()
        at = (rows["r"].to_numpy() - ty * tile) * tile + rows["c"].to_numpy() - tx * tile
        out = []
        for name in ("cost", "seed"):
            array, values = np.full(tile * tile, math.nan), rows[name].to_numpy()
            if name == "cost":
                values = np.where(values >= 0, values, math.nan)
            np.fmin.at(array, at, values)
            out.append(array.tobytes())
        return pa.table({"ty": [ty], "tx": [tx], "cost": [out[0]], "seed": [out[1]]})

    shaped = cells.select(_tile_of("r", tile).alias("ty"), _tile_of("c", tile).alias("tx"), "r", "c", *(F.coalesce(k, F.lit(math.nan)).alias(k) for k in ("cost", "seed")))
    return shaped.groupBy("ty", "tx").applyInArrow(build, "ty long, tx long, cost binary, seed binary")


def _ring(dy: int, dx: int, tile: int) -> tuple:
    """Where a tile's array with a ring around it holds the strip from a neighbour at (-dy, -dx)."""
    side = lambda k: slice(1, tile + 1) if not k else 0 if k > 0 else tile + 1
    return side(dy), side(dx)


def _border(dy: int, dx: int, tile: int) -> tuple:
    """The strip of a tile's array with a ring that its neighbour at (dy, dx) needs."""
    side = lambda k: slice(1, tile + 1) if not k else tile if k > 0 else 1
    return side(dy), side(dx)


def _relaxed(cost: bytes, seed: bytes, strips: list[dict], ty: int, tx: int, tile: int, geometric: bool, limit: float) -> dict[str, np.ndarray]:
    """A tile with a ring of its neighbours' cells: for each cell the least distance, and the least source at it.

    A step costs the mean of its ends times its length. Sources follow once the distances stand: rounding makes sums
    equal that weren't, so that sources taken along the way would depend on the order of the steps.
    """
    side = tile + 2
    costs, values = np.full((side, side), math.nan), np.full((side, side), math.nan)
    distance, source = np.full((side, side), math.inf), np.full((side, side), _NONE)
    inner = (slice(1, -1), slice(1, -1))
    costs[inner] = np.frombuffer(cost, np.float64).reshape(tile, tile)
    seeds = np.frombuffer(seed, np.float64).reshape(tile, tile)
    seeds = np.where(np.isnan(costs[inner]), math.nan, seeds)
    held = ~np.isnan(seeds)
    number = (ty * tile + np.arange(tile))[:, None] * _ROW + (tx * tile + np.arange(tile))[None, :] + _COLUMN
    distance[inner][held], source[inner][held], values[inner][held] = 0.0, number[held], seeds[held]
    arrays = {"cost": costs, "distance": distance, "source": source, "value": values}
    for x in strips:
        where = _ring(x["dy"], x["dx"], tile)
        for name, kind in _ARRAYS:
            arrays[name][where] = np.frombuffer(x[name], kind) if isinstance(where[0], slice) or isinstance(where[1], slice) else np.frombuffer(x[name], kind)[0]
    weights = {}
    for a, b in _AROUND:
        w = (costs[inner] + costs[1 + a : side - 1 + a, 1 + b : side - 1 + b]) / 2 * (math.sqrt(2) if geometric and a and b else 1.0)
        weights[a, b] = np.where(np.isnan(w), math.inf, w)

    def settle(known: np.ndarray, improve) -> None:
        """Goes on around the cells that changed until none does."""
        while known.any():
            rows, columns = np.flatnonzero(known.any(1)), np.flatnonzero(known.any(0))
            top, bottom, left, right = max(rows[0] - 1, 1), min(rows[-1] + 2, side - 1), max(columns[0] - 1, 1), min(columns[-1] + 2, side - 1)
            here, known = (slice(top, bottom), slice(left, right)), np.zeros((side, side), bool)
            for (a, b), w in weights.items():
                there = (slice(top + a, bottom + a), slice(left + b, right + b))
                known[here] |= improve(here, there, distance[there] + w[top - 1 : bottom - 1, left - 1 : right - 1])

    def nearer(here, there, far):
        better = (far < distance[here]) & (far <= limit)
        np.copyto(distance[here], far, where=better)
        return better

    def earlier(here, there, far):
        better = (far == distance[here]) & (far < math.inf) & (source[there] < source[here])
        np.copyto(source[here], source[there], where=better)
        np.copyto(values[here], values[there], where=better)
        return better

    settle(np.isfinite(distance), nearer)
    settle(np.isfinite(distance), earlier)
    return arrays


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: tiles' arrays are large, and a batch has dozens."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def allocate(cells: DataFrame, cost: str, seed: str, limit: float | None = None, geometric: bool = True, tile: int = TILE) -> DataFrame:
    """r, c, distance, src_r, src_c and value: the cheapest seed of every cell, by default however dear, else up to ``limit``.

    Cells whose ``cost`` is null, NaN or below 0 can't be crossed; those with a value in ``seed`` are seeds, if they
    can be crossed. A step costs the mean of its ends, times the root of 2 on the diagonal if ``geometric``. Of equally
    cheap seeds the first in (row, column) order counts. Cells out of reach have no row; an empty table gives none.
    Rows that repeat a cell count as one, with the least cost and seed; rows with a null ``r`` or ``c`` and other
    columns are left aside. Each round is written to the shared checkpoint folder.
    """
    bound = math.inf if limit is None else float(limit)
    shaped = cells.where("r is not null and c is not null").select(F.col("r").cast("long"), F.col("c").cast("long"), F.col(cost).cast("double").alias("cost"), F.col(seed).cast("double").alias("seed"))
    tiles = stash(_tiles(shaped, tile))
    wire = pa.schema([("ty", pa.int64()), ("tx", pa.int64()), ("dy", pa.int32()), ("dx", pa.int32()), *((n, pa.binary()) for n, _ in _ARRAYS)])

    def borders(batches):
        for batch in batches:
            for row in _each(batch):
                out = []
                arrays = _relaxed(row["cost"], row["seed"], row["strips"] or [], row["ty"], row["tx"], tile, geometric, bound)
                for a, b in _AROUND:
                    where = _border(a, b, tile)
                    if np.isfinite(arrays["distance"][where]).any():
                        out.append((row["ty"] + a, row["tx"] + b, a, b, *(np.ascontiguousarray(arrays[n][where]).tobytes() for n, _ in _ARRAYS)))
                yield _table(out, wire)

    def relaxed(batches):
        types = pa.schema([("r", pa.int64()), ("c", pa.int64()), ("distance", pa.float64()), ("src_r", pa.int64()), ("src_c", pa.int64()), ("value", pa.float64())])
        for batch in batches:
            for row in _each(batch):
                arrays = _relaxed(row["cost"], row["seed"], row["strips"] or [], row["ty"], row["tx"], tile, geometric, bound)
                i, j = np.nonzero(np.isfinite(arrays["distance"][1:-1, 1:-1]))
                source = arrays["source"][i + 1, j + 1]
                columns = (i + row["ty"] * tile, j + row["tx"] * tile, arrays["distance"][i + 1, j + 1], source // _ROW, source % _ROW - _COLUMN, arrays["value"][i + 1, j + 1])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=types)

    names = [n for n, _ in _ARRAYS]
    there = tiles.select("ty", "tx")

    def asked(strips: DataFrame) -> DataFrame:
        beside = strips.groupBy("ty", "tx").agg(F.collect_list(F.struct("dy", "dx", *names)).alias("strips"))  # eight at most
        return tiles.join(beside, ["ty", "tx"])

    alone = F.lit(None).cast("array<struct<dy: int, dx: int, cost: binary, distance: binary, source: binary, value: binary>>")
    told = tiles.withColumn("strips", alone).mapInArrow(borders, _STRIP).join(there, ["ty", "tx"], "left_semi")
    latest, n = stash(told.withColumns({"round": F.lit(0), "fresh": F.lit(True)})), 0
    while latest.where("fresh").take(1):
        n += 1
        news = latest.where("fresh").select("ty", "tx").distinct()
        told = asked(latest.join(news, ["ty", "tx"], "left_semi")).mapInArrow(borders, _STRIP).join(there, ["ty", "tx"], "left_semi")
        both = latest.drop("fresh").union(told.withColumn("round", F.lit(n)))
        last = both.groupBy("ty", "tx", "dy", "dx").agg(F.max_by(F.struct(*names, "round"), "round").alias("x"), F.min_by(F.struct("distance", "source"), "round").alias("y"), F.count("*").alias("n"))
        fresh = (F.col("x.round") == n) & ((F.col("n") == 1) | (F.col("x.distance") != F.col("y.distance")) | (F.col("x.source") != F.col("y.source")))
        before, latest = latest, stash(last.select("ty", "tx", "dy", "dx", *(f"x.{k}" for k in names), F.lit(n).alias("round"), fresh.alias("fresh")))
        unstash(before)
    everywhere = latest.groupBy("ty", "tx").agg(F.collect_list(F.struct("dy", "dx", *names)).alias("strips"))
    return tiles.join(everywhere, ["ty", "tx"], "left").mapInArrow(relaxed, "r long, c long, distance double, src_r long, src_c long, value double")


def geodesic_distance(cells: DataFrame, seed: str, limit: float | None = None, tile: int = TILE) -> DataFrame:
    """r, c, distance: the way from the nearest seed over the given cells, diagonal steps counting the root of 2.

    Without ``limit`` however far; odd rows count as in ``allocate``.
    """
    marked = cells.select("r", "c", F.lit(1.0).alias("cost"), F.when(F.col(seed), F.lit(1.0)).alias("seed"))
    return allocate(marked, "cost", "seed", limit, tile=tile).select("r", "c", "distance")


def nearest_fill(cells: DataFrame, value: str, limit: int | None = None, tile: int = TILE, distinct: bool = False) -> DataFrame:
    """r, c, value and distance: the value of the nearest cell that has one, by chessboard distance over the given cells.

    Of equally near ones the first in (row, column) order; without ``limit`` however far. Odd rows count as in
    ``allocate``. Where the cells fill a rectangle, ways around gaps can't occur, and ``chessboard.nearest`` has no rounds.
    ``distinct`` says that no row repeats a cell, which is looked at otherwise.
    """
    number = lambda k: F.col(k).cast("long")
    extent = cells.where("r is not null and c is not null").agg(F.min(number("r")), F.max(number("r")), F.min(number("c")), F.max(number("c")), F.count("*")).first()
    top, bottom, left, right, count = extent
    if not count:
        return cells.select("r", "c", F.col(value).cast("double").alias(value), F.lit(0.0).alias("distance")).limit(0)
    height, width = bottom - top + 1, right - left + 1
    if count == height * width and (distinct or cells.where("r is not null and c is not null").select(number("r"), number("c")).distinct().count() == count):
        moved = cells.where("r is not null and c is not null").select((number("r") - top).alias("r"), (number("c") - left).alias("c"), F.col(value).cast("double").alias(value))
        found = chessboard.nearest(moved, value, height, width, limit)
        return found.select((F.col("r") + top).alias("r"), (F.col("c") + left).alias("c"), value, "distance")
    marked = cells.select("r", "c", F.lit(1.0).alias("cost"), F.col(value).alias("seed"))
    return allocate(marked, "cost", "seed", limit, geometric=False, tile=tile).select("r", "c", F.col("value").alias(value), "distance")


def _local_labels(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each cell the place of the first cell of its 4-connected component; cells are distinct and sorted by row and column."""
    starts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)]))
    run = np.cumsum(np.bincount(starts, minlength=len(r))) - 1
    width = int(c.max() - c.min()) + 2
    key = (r - r.min()) * width + (c - c.min())
    below = np.searchsorted(key, key + width)
    meets = (below < len(key)) & (key[np.minimum(below, len(key) - 1)] == key + width)
    pairs = np.unique(np.stack([run[meets], run[below[meets]]], 1), axis=0)
    root = np.arange(len(starts))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return starts[np.array([find(x) for x in range(len(root))])][run]


def label_components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """r, c, label of 4-connected components of the given cells; the label is the number of the component's first cell.

    Rows that repeat a cell count as one; rows with a null ``r`` or ``c`` and other columns are left aside. An empty
    table gives an empty result.
    """

    def local(rows: pa.Table) -> pa.Table:
        cells_ = np.unique(np.stack([rows["r"].to_numpy(), rows["c"].to_numpy()], 1), axis=0)
        first = cells_[_local_labels(cells_[:, 0], cells_[:, 1])]
        return pa.table({"r": cells_[:, 0], "c": cells_[:, 1], "label": first[:, 0] * _ROW + first[:, 1]})

    shaped = cells.where("r is not null and c is not null").select(F.col("r").cast("long"), F.col("c").cast("long"))
    labelled = shaped.groupBy(_tile_of("r", tile).alias("ty"), _tile_of("c", tile).alias("tx")).applyInArrow(local, "r long, c long, label long")
    labelled = stash(labelled)
    edge = lambda k, side: F.pmod(F.col(k), F.lit(tile)) == (0 if side else tile - 1)
    touching = None
    for k, other in (("r", "c"), ("c", "r")):
        after = labelled.where(edge(k, 1)).select((F.col(k) - 1).alias("_k"), F.col(other).alias("_o"), F.col("label").alias("b"))
        before = labelled.where(edge(k, 0)).select(F.col(k).alias("_k"), F.col(other).alias("_o"), F.col("label").alias("a"))
        pairs = before.join(after, ["_k", "_o"]).select("a", "b")
        touching = pairs if touching is None else touching.union(pairs)
    roots = components(touching)
    return labelled.join(roots, labelled["label"] == roots["node"], "left").select("r", "c", F.coalesce("root", "label").alias("label"))


def keep_anchored(cells: DataFrame, anchors: DataFrame, tile: int = TILE) -> DataFrame:
    """r, c, label of the cells whose component holds one of ``anchors`` (r, c)."""
    labelled = label_components(cells, tile)
    held = labelled.join(anchors.select(F.col("r").cast("long"), F.col("c").cast("long")), ["r", "c"], "left_semi").select("label").distinct()
    return labelled.join(held, "label", "left_semi").select("r", "c", "label")
