"""Scenes as tile arrays: windows cut from arrays, models run on them, predictions blended and resampled as arrays.

A raster's cells move as packed pieces, not as rows: each task that reads cells packs those that a cluster of windows
needs into one row. A cluster is ``group`` x ``group`` neighbouring windows with their halo, so that overlapping windows
share what they have in common. It cuts its windows, runs the model on all of them at once and sums up weighted
predictions; only the sums move again, to be blended by blocks. So there are two shuffles, of arrays both times, a third
where depths go onto another grid than the model's, and a task holds one cluster or one block at a time, whatever the
scene's size.

A tile array is a row ``y, x, height, width, px``: the first cell, the extent, and the values row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ABSOLUTE, DRY_DEPTH
from .normalize import check_stats
from .predict import Predictor
from .tiling import LEAST_SUM, LEAST_WEIGHT, stride_of

ARRAYS = "y long, x long, height long, width long, px array<double>"
#: Cells that a task packs at once.
PACKED = 1 << 18
#: Side of the blocks in which predictions are blended and resampled.
BLOCK = 512


class Axis(NamedTuple):
    """Cell edges along an axis: the first one's place and the signed size of a cell."""

    origin: float
    step: float

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return self.origin + (cells + 0.5) * self.step

    def cells(self, places: np.ndarray) -> np.ndarray:
        """Places as numbers of cell centres, whole at a centre."""
        return (places - self.origin) / self.step - 0.5


class Taps(NamedTuple):
    """For each target cell the source cells around its centre and their weights, which fall off linearly."""

    at: np.ndarray
    weights: np.ndarray

    @property
    def first(self) -> int:
        return int(self.at.min())

    @property
    def last(self) -> int:
        return int(self.at.max()) + 1


def taps(source: Axis, target: Axis, first: int, last: int, size: int) -> Taps:
    """Taps of target cells ``first`` to ``last``. Where the target is coarser than the source the weights reach as far as a target cell."""
    return _taps(source, target, np.arange(first, last), size)


def _taps(source: Axis, target: Axis, cells: np.ndarray, size: int) -> Taps:
    reach = max(1.0, abs(target.step / source.step))
    place = source.cells(target.centres(cells))
    place = np.where(np.abs(place - np.rint(place)) < 1e-9, np.rint(place), place)  # a centre on a centre has one tap
    near = np.floor(place - reach).astype(np.int64)[:, None] + np.arange(1, 2 * math.ceil(reach) + 1)
    weights = np.maximum(0.0, 1 - np.abs(near - place[:, None]) / reach)
    weights[(near < 0) | (near >= size)] = 0
    return Taps(np.clip(near, 0, size - 1), weights)


def resampled(values: np.ndarray, rows: Taps, columns: Taps, first_row: int, first_column: int) -> np.ndarray:
    """``values``, whose corner is (first_row, first_column), on the target cells of the taps; NaN has no weight, and where nothing has any the result is NaN."""
    known = np.isfinite(values)
    sums, norms = np.where(known, values, 0.0), known.astype(float)

    def along(x: np.ndarray, t: Taps, first: int, axis: int) -> np.ndarray:
        shape = (-1, 1) if axis == 0 else (1, -1)
        return sum(np.take(x, np.clip(t.at[:, k] - first, 0, x.shape[axis] - 1), axis) * t.weights[:, k].reshape(shape) for k in range(t.at.shape[1]))

    for t, first, axis in ((rows, first_row, 0), (columns, first_column, 1)):
        sums, norms = along(sums, t, first, axis), along(norms, t, first, axis)
    return np.divide(sums, norms, out=np.full(sums.shape, np.nan), where=norms > 1e-12)


class Spans(NamedTuple):
    """Along an axis, the source cells [low, high) that each of several targets needs; both grow from target to target."""

    low: np.ndarray
    high: np.ndarray

    def of(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``cells`` and targets that need these cells."""
        first, last = np.searchsorted(self.high, cells, "right"), np.searchsorted(self.low, cells, "right") - 1
        for d in range(int((last - first).max(initial=-1)) + 1):
            at = np.flatnonzero(first + d <= last)
            yield at, first[at] + d


def tapped(source: Axis, target: Axis, low: np.ndarray, high: np.ndarray, size: int) -> Spans:
    """The source cells that the taps of target cells [low, high) need, for each range. Taps move along with their cells, so that a range's two ends tell."""
    ends = [_taps(source, target, cells, size).at for cells in (low, high - 1)]
    return Spans(np.minimum(*(at.min(1) for at in ends)), np.maximum(*(at.max(1) for at in ends)) + 1)


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal rows of sorted columns of numbers from 0 up."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new |= np.diff(c, prepend=-1) != 0
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], len(new)], strict=True)) if at else []


def packed(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: Spans, columns: Spans) -> Iterator[pa.RecordBatch]:
    """Cells (r, c, value) as pieces of the targets that need them: ty, tx, places within the target, values."""
    names, held, size = ["ty", "tx", "at", "px"], [], 0

    def pieces() -> pa.RecordBatch:
        r, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
        found = []
        for at, ty in rows.of(r):
            for again, tx in columns.of(c[at]):
                own = at[again]
                y, x = ty[again], tx
                found.append((y, x, (r[own] - rows.low[y]) * (columns.high[x] - columns.low[x]) + c[own] - columns.low[x], v[own]))
        y, x, place, px = (np.concatenate(a) for a in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((x, y))
        y, x, place, px = y[order], x[order], place[order].astype(np.int32), px[order].astype(np.float64)
        parts = runs(y, x)
        cuts = [a for a, _ in parts]
        return pa.RecordBatch.from_arrays([pa.array(y[cuts], pa.int32()), pa.array(x[cuts], pa.int32()), pa.array([place[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([px[a:b].tobytes() for a, b in parts], pa.binary())], names)

    for r, c, v in batches:
        for at in range(0, len(r), PACKED):
            cut = np.s_[at : at + PACKED]
            held.append((r[cut], c[cut], v[cut]))
            size += len(held[-1][0])
            if size >= PACKED:
                yield pieces()
                held, size = [], 0
    if size:
        yield pieces()


PIECES = "ty int, tx int, at binary, px binary"


def pack_cells(cells: DataFrame, value: str, rows: Spans, columns: Spans, sound: str | None = None) -> DataFrame:
    """Pieces of cells (r, c, value). Null is 0; with ``sound``, a name for messages, values must be finite, and ``depth`` not negative."""

    def run(batches):
        def read():
            for batch in batches:
                v = batch.column(2).fill_null(0.0).to_numpy()
                if sound and not np.isfinite(v).all():
                    raise ValueError(f"{sound} has values that aren't finite")
                if sound == "depth" and len(v) and v.min() < 0:
                    raise ValueError(f"depth has negative values: {v.min()}")
                yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), v

        yield from packed(read(), rows, columns)

    return cells.select(F.col("r").cast("long"), F.col("c").cast("long"), F.col(value).cast("double")).mapInArrow(run, PIECES)


def pack_arrays(arrays: DataFrame, rows: Spans, columns: Spans) -> DataFrame:
    def run(batches):
        def read():
            for batch in batches:
                for y, x, h, w, px in zip(*(batch[k].to_pylist() for k in ("y", "x", "height", "width")), batch["px"], strict=True):
                    yield np.repeat(np.arange(y, y + h), w), np.tile(np.arange(x, x + w), h), px.values.to_numpy(zero_copy_only=False)

        yield from packed(read(), rows, columns)

    return arrays.select("y", "x", "height", "width", "px").mapInArrow(run, PIECES)


def unpacked(pieces: pa.Table, height: int, width: int, fill: float = np.nan) -> np.ndarray:
    out = np.full(height * width, fill)
    for at, px in zip(pieces["at"].to_pylist(), pieces["px"].to_pylist(), strict=True):
        out[np.frombuffer(at, np.int32)] = np.frombuffer(px, np.float64)
    return out.reshape(height, width)


def cells_of(arrays: DataFrame, value: str) -> DataFrame:
    """r, c and value of every cell of tile arrays."""
    each = arrays.select("y", "x", "width", F.posexplode("px").alias("_k", value))
    return each.select((F.col("y") + F.expr("_k div width")).alias("r"), (F.col("x") + F.col("_k") % F.col("width")).alias("c"), value)


def ramp(tile: int, overlap: int, first: bool, last: bool) -> np.ndarray:
    """Weights along a window: ramps over the overlaps, flat at the scene's outer edges."""
    i = np.arange(tile)
    out = np.ones(tile)
    if overlap:
        if not last:
            out[-overlap:] = (tile - i[-overlap:]) / (overlap + 1.0)
        if not first:
            out[:overlap] = np.minimum(out[:overlap], (i[:overlap] + 1) / (overlap + 1.0)) if 2 * overlap > tile else (i[:overlap] + 1) / (overlap + 1.0)
    return np.clip(out, LEAST_WEIGHT, 1.0)


def normalised(z: np.ndarray, percent: float, stats: dict | None = None) -> np.ndarray:
    """Elevations of windows (n, rows, columns) from 0 to 1, by each window's own percentile and range or by given ones."""
    bounded = np.maximum(z, 0.0)
    flat = bounded.reshape(len(z), -1)
    if stats:
        p, low, high = (np.full(len(z), x) for x in check_stats(stats))
    else:
        p = np.percentile(flat, percent, axis=1)
        low, high = np.minimum(flat.min(1), p), np.minimum(flat.max(1), p)
    span = high - low
    if ((span <= 0) & (np.abs(low) > ABSOLUTE)).any():
        raise ValueError("a flat DEM tile above 0 has no range")
    shape = (-1, *[1] * (z.ndim - 1))
    out = (np.minimum(bounded, p.reshape(shape)) - low.reshape(shape)) / np.where(span > 0, span, 1.0).reshape(shape)
    return np.where((span > 0).reshape(shape), np.clip(out, 0.0, 1.0), 0.0)


class Windows(NamedTuple):
    """Window starts along an axis, dealt to clusters of ``group``, with the cells of each cluster."""

    starts: np.ndarray
    tile: int
    overlap: int
    group: int

    @classmethod
    def over(cls, total: int, tile: int, overlap: int, group: int) -> Windows:
        return cls(np.unique([*range(0, total - tile + 1, stride_of(tile, overlap)), total - tile]), tile, overlap, group)

    def spans(self) -> Spans:
        first = np.arange(0, len(self.starts), self.group)
        return Spans(self.starts[first], self.starts[np.minimum(first + self.group, len(self.starts)) - 1] + self.tile)

    def of(self, cluster: int) -> list[tuple[int, np.ndarray]]:
        """Starts and weights of a cluster's windows."""
        n = len(self.starts)
        return [(int(self.starts[k]), ramp(self.tile, self.overlap, k == 0, k == n - 1)) for k in range(cluster * self.group, min((cluster + 1) * self.group, n))]


class Grid(NamedTuple):
    """A raster's extent, and its axes where it is placed on the earth."""

    height: int
    width: int
    rows: Axis = Axis(0.0, 1.0)
    columns: Axis = Axis(0.0, 1.0)


def super_resolve(
    depth: DataFrame, dem: DataFrame, coarse: Grid, fine: Grid, predictor: Predictor, tile: int, overlap: int, max_depth: float, percent: float = 95.0, stats: dict | None = None, blend_depths: bool = True, group: int = 4, block: int = BLOCK, sound: bool = False
) -> DataFrame:
    """Tile arrays of depths on the grid ``fine`` from coarse depths (r, c, v) and elevations (r, c, z).

    The model's grid has ``predictor.scale`` cells for each coarse one and the coarse grid's bounds. Where ``fine`` is
    another one, the elevations are resampled onto the model's grid within each cluster, and the depths back onto
    ``fine`` afterwards. Both sides are filled up with zeros to whole windows of ``tile`` coarse cells; windows overlap
    by ``overlap``. With ``blend_depths`` depths are blended, else the model's logarithmic units. Absent cells and nulls
    count as 0, a repeated cell has one of its values; ``sound`` makes other bad values an error. Depths below DRY_DEPTH
    are 0. An empty scene gives an empty result; other columns are left aside.
    """
    if not (math.isfinite(max_depth) and max_depth > 0):
        raise ValueError(f"max_depth must be finite and above 0, not {max_depth}")
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    scale, side = predictor.scale, tile * predictor.scale
    if not (coarse.height and coarse.width and fine.height and fine.width):
        return depth.sparkSession.createDataFrame([], ARRAYS)
    model = Grid(coarse.height * scale, coarse.width * scale, *(Axis(a.origin, a.step / scale) for a in (coarse.rows, coarse.columns)))
    native = all(abs(a.step - b.step) <= 1e-9 * abs(b.step) and abs(a.origin - b.origin) <= 1e-6 * abs(b.step) for a, b in ((model.rows, fine.rows), (model.columns, fine.columns)))
    # on its own grid, the scene ends where the elevations do
    kept = Grid(fine.height, fine.width, *model[2:]) if native else model
    wy, wx = (Windows.over(-(-n // side) * side, side, overlap * scale, group) for n in (kept.height, kept.width))
    ys, xs = wy.spans(), wx.spans()
    low_spans = [Spans(s.low // scale, s.high // scale) for s in (ys, xs)]
    if native:
        high_spans = [ys, xs]
    else:
        high_spans = [tapped(f, m, s.low, np.minimum(s.high, n), size) for s, f, m, n, size in zip((ys, xs), fine[2:], model[2:], model[:2], fine[:2], strict=True)]
    denominator, loaded = math.log1p(max_depth), _Loaded(predictor)

    def run(key: tuple[pa.Scalar, ...], low: pa.Table, high: pa.Table) -> pa.Table:
        loaded.ready()
        cy, cx = (k.as_py() for k in key)
        extent = lambda spans: [int(s.high[k] - s.low[k]) for s, k in zip(spans, (cy, cx), strict=True)]
        u = np.clip(np.log1p(np.clip(unpacked(low, *extent(low_spans), 0.0), 0, max_depth)) / denominator, 0, 1)
        z = np.zeros(extent((ys, xs)))
        if native:
            z[:] = unpacked(high, *z.shape, 0.0)
        else:
            rows, columns = (taps(f, m, int(s.low[k]), min(int(s.high[k]), n), size) for s, k, f, m, n, size in zip((ys, xs), (cy, cx), fine[2:], model[2:], model[:2], fine[:2], strict=True))
            part = resampled(unpacked(high, *extent(high_spans)), rows, columns, rows.first, columns.first)
            z[: part.shape[0], : part.shape[1]] = np.nan_to_num(part, nan=0.0)
        top, left = int(ys.low[cy]), int(xs.low[cx])
        windows = [(y - top, x - left, np.outer(a, b)) for y, a in wy.of(cy) for x, b in wx.of(cx)]
        lows = np.stack([u[y // scale : y // scale + tile, x // scale : x // scale + tile] for y, x, _ in windows])
        highs = normalised(np.stack([z[y : y + side, x : x + side] for y, x, _ in windows]), percent, stats)
        out = np.asarray(predictor.run(lows, highs), float).reshape(len(windows), side, side)
        if not np.isfinite(out).all():
            raise ValueError("the model's output isn't finite")
        out = np.clip(np.expm1(np.clip(out, 0, 1) * denominator), 0, max_depth) if blend_depths else out
        sums, weights = np.zeros(z.shape), np.zeros(z.shape)
        for (y, x, w), px in zip(windows, out, strict=True):
            sums[y : y + side, x : x + side] += px * w
            weights[y : y + side, x : x + side] += w
        found = []
        bottom, right = min(top + z.shape[0], kept.height), min(left + z.shape[1], kept.width)
        for by in range(top // block, -(-bottom // block)):
            for bx in range(left // block, -(-right // block)):
                y0, y1, x0, x1 = max(top, by * block), min(bottom, (by + 1) * block), max(left, bx * block), min(right, (bx + 1) * block)
                if y0 < y1 and x0 < x1:
                    cut = np.s_[y0 - top : y1 - top, x0 - left : x1 - left]
                    found.append((by, bx, y0, x0, y1 - y0, x1 - x0, sums[cut].tobytes(), weights[cut].tobytes()))
        return _rows(found, _SUMS)

    low = pack_cells(depth, depth.columns[2], *low_spans, "depth" if sound else None)
    high = pack_cells(dem, dem.columns[2], *high_spans, "the DEM" if sound else None)
    sums = low.groupBy("ty", "tx").cogroup(high.groupBy("ty", "tx")).applyInArrow(run, _spark(_SUMS))

    def blend(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        y, x = (k.as_py() * block for k in key)
        height, width = min(block, kept.height - y), min(block, kept.width - x)
        total, weights = np.zeros((height, width)), np.zeros((height, width))
        for y0, x0, h, w, s, k in zip(*(rows[c].to_pylist() for c in ("y", "x", "height", "width", "sums", "weights")), strict=True):
            cut = np.s_[y0 - y : y0 - y + h, x0 - x : x0 - x + w]
            total[cut] += np.frombuffer(s).reshape(h, w)
            weights[cut] += np.frombuffer(k).reshape(h, w)
        v = np.where(weights > 0, total / np.maximum(weights, LEAST_SUM), 0.0)
        v = v if blend_depths else np.expm1(np.clip(v, 0, 1) * denominator)
        v = np.clip(v, 0, max_depth)
        if native:
            return _rows([(y, x, height, width, dry(v, max_depth).ravel())], _ARRAYS)
        r, c = np.repeat(np.arange(y, y + height), width), np.tile(np.arange(x, x + width), height)
        return pa.Table.from_batches(packed(iter([(r, c, v.ravel())]), *back))

    if native:
        return sums.groupBy("by", "bx").applyInArrow(blend, ARRAYS)
    back = _needed(model, fine, block)
    return _resample(sums.groupBy("by", "bx").applyInArrow(blend, PIECES), model, fine, back, block, lambda v: dry(v, max_depth))


def dry(depth: np.ndarray, max_depth: float) -> np.ndarray:
    bounded = np.clip(np.nan_to_num(depth, nan=0.0), 0.0, max_depth)
    return np.where(bounded < DRY_DEPTH, 0.0, bounded)


class _Loaded:
    """A predictor that is loaded once in each worker, at its first group."""

    def __init__(self, predictor: Predictor) -> None:
        self.predictor, self.done = predictor, False

    def ready(self) -> None:
        if not self.done:
            self.predictor.load()
            self.done = True


def resample_arrays(arrays: DataFrame, source: Grid, target: Grid, block: int = BLOCK, after=None) -> DataFrame:
    """Tile arrays on the grid ``target`` from such on ``source``, in any ratio: bilinear, or the linear filter of a target cell's reach where it is coarser.

    NaN and absent cells have no weight; a target cell near no value is NaN. ``after`` is applied to each block.
    """
    spans = _needed(source, target, block)
    return _resample(pack_arrays(arrays, *spans), source, target, spans, block, after)


def resample_cells(cells: DataFrame, value: str, source: Grid, target: Grid, block: int = BLOCK) -> DataFrame:
    """``resample_arrays`` from cells (r, c, value), which go to the blocks that need them at once; a null is an absent cell, a block near no cell has no row."""
    spans = _needed(source, target, block)
    return _resample(pack_cells(cells.where(F.col(value).isNotNull()), value, *spans), source, target, spans, block)


def _needed(source: Grid, target: Grid, block: int) -> list[Spans]:
    """The source cells that each block of the target needs, along both axes."""
    starts = [np.arange(0, n, block) for n in target[:2]]
    return [tapped(s, t, a, np.minimum(a + block, n), size) for a, s, t, n, size in zip(starts, source[2:], target[2:], target[:2], source[:2], strict=True)]


def _resample(pieces: DataFrame, source: Grid, target: Grid, spans: list[Spans], block: int, after=None) -> DataFrame:
    """Blocks of the target from the pieces that they need; each block's taps are made in its task, as those of all blocks are as long as the grid."""

    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        values = unpacked(pieces, *(int(s.high[k] - s.low[k]) for s, k in zip(spans, at, strict=True)))
        rows, columns = (taps(s, t, k * block, min((k + 1) * block, n), size) for k, s, t, n, size in zip(at, source[2:], target[2:], target[:2], source[:2], strict=True))
        out = resampled(values, rows, columns, rows.first, columns.first)
        out = out if after is None else after(out)
        return _rows([(at[0] * block, at[1] * block, *out.shape, out.ravel())], _ARRAYS)

    return pieces.groupBy("ty", "tx").applyInArrow(run, ARRAYS)


def tile_arrays(cells: DataFrame, value: str, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """Cells (r, c, value) as tile arrays of blocks; absent cells and nulls are NaN."""
    spans = [Spans(np.arange(0, n, block), np.minimum(np.arange(0, n, block) + block, n)) for n in (height, width)]

    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        y, x = (k.as_py() * block for k in key)
        out = unpacked(pieces, min(block, height - y), min(block, width - x))
        return _rows([(y, x, *out.shape, out.ravel())], _ARRAYS)

    return pack_cells(cells.where(F.col(value).isNotNull()), value, *spans).groupBy("ty", "tx").applyInArrow(run, ARRAYS)


_SUMS = {"by": pa.int64(), "bx": pa.int64(), "y": pa.int64(), "x": pa.int64(), "height": pa.int64(), "width": pa.int64(), "sums": pa.binary(), "weights": pa.binary()}
_ARRAYS = {"y": pa.int64(), "x": pa.int64(), "height": pa.int64(), "width": pa.int64(), "px": pa.list_(pa.float64())}


def _spark(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'binary' if pa.types.is_binary(t) else 'long'}" for k, t in kinds.items())


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
