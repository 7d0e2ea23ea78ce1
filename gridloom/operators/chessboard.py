"""Nearest cells by chessboard distance over whole rectangles: three shuffles of packed cells, no rounds.

1. Along each row: how far the nearest cell with a value lies.
2. Along each column: the least ``d`` for which some row within ``d`` has such a cell within ``d``; and the first of these
   rows. Both by halving, on minima over ranges of a column.
3. Back at that row: the first cell within ``d``, and its value.

Rows and columns go to tasks in bands of BAND cells, or of one row or column where that has more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PIECES, Spans, pack_cells, packed, runs, unpacked

#: Cells of a band, about.
BAND = 1 << 18
#: Farther than any cell.
FAR = 1 << 30


def along_rows(held: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest one of its row that is held."""
    rows, columns = held.shape
    at = np.arange(columns)
    left = np.maximum.accumulate(np.where(held, at, -FAR), axis=1)
    right = np.minimum.accumulate(np.where(held, at, 2 * FAR)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(np.minimum(at - left, right - at), FAR).astype(np.int32)


class Minima:
    """Least entries of ranges of rows, for each column."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, self.size = [values], len(values)
        while (step := 1 << (len(self.levels) - 1)) * 2 <= self.size:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of the rows [low, high), clipped to what there is; every range has a row."""
        low, high = np.maximum(low, 0), np.minimum(high, self.size)
        level = np.frexp(high - low)[1] - 1
        columns = np.broadcast_to(np.arange(low.shape[1]), low.shape)
        out = np.empty(low.shape, self.levels[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            table = self.levels[k]
            out[own] = np.minimum(table[low[own], columns[own]], table[high[own] - (1 << k), columns[own]])
        return out


def along_columns(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each cell, FAR without any, and the first row that has a cell at it."""
    rows = gaps.shape[0]
    minima, at = Minima(gaps), np.broadcast_to(np.arange(rows)[:, None], gaps.shape)
    none = gaps.min(0) >= FAR
    most = int(max(rows, gaps[:, ~none].max(initial=0)))
    low, high = np.zeros(gaps.shape, np.int64), np.full(gaps.shape, most, np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        near = minima.over(at - middle, at + middle + 1) <= middle
        low, high = np.where(near, low, middle + 1), np.where(near, middle, high)
    distance = low
    first, last = np.maximum(at - distance, 0), at + np.minimum(distance, rows)
    start = first.copy()
    while (first < last).any():
        middle = (first + last) // 2
        near = minima.over(start, middle + 1) <= distance
        first, last = np.where(near, first, middle + 1), np.where(near, middle, last)
    return np.where(none[None, :], FAR, distance), first


def first_in_row(values: np.ndarray, rows: np.ndarray, columns: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and value of the first held cell of a row from ``columns - distance`` on."""
    held = ~np.isnan(values)
    width = values.shape[1]
    following = np.minimum.accumulate(np.where(held, np.arange(width), width)[:, ::-1], axis=1)[:, ::-1]
    found = following[rows, np.maximum(columns - distance, 0)]
    return found, values[rows, found]


def _bands(size: int, across: int) -> tuple[int, Spans]:
    band = max(1, BAND // max(1, across))
    low = np.arange(0, size, band)
    return band, Spans(low, np.minimum(low + band, size))


def nearest(cells: DataFrame, value: str, height: int, width: int, limit: int | None = None) -> DataFrame:
    """r, c, ``value``, distance, src_r and src_c of every cell of a rectangle that has a value within ``limit``.

    Of equally near cells the first in (row, column) order counts. Absent cells, nulls and NaN have no value; where a
    cell is repeated one of its values counts. Other columns are left aside; without any value the result is empty.
    """
    held = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    all_rows, all_columns = (Spans(np.zeros(1, np.int64), np.array([n])) for n in (height, width))
    row_band, row_spans = _bands(height, width)
    column_band, column_spans = _bands(width, height)
    by_row = pack_cells(held, value, row_spans, all_columns)

    def rows(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        low = key[0].as_py() * row_band
        gaps = along_rows(~np.isnan(unpacked(pieces, min(row_band, height - low), width)))
        r = np.repeat(np.arange(low, low + len(gaps)), width)
        c = np.tile(np.arange(width), len(gaps))
        near = gaps.ravel() < FAR
        return pa.Table.from_batches(packed(iter([(r[near], c[near], gaps.ravel()[near].astype(float))]), all_rows, column_spans))

    def columns(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        low = key[0].as_py() * column_band
        gaps = np.nan_to_num(unpacked(pieces, height, min(column_band, width - low)), nan=FAR).astype(np.int32)
        distance, source = along_columns(gaps)
        r, c = np.nonzero((distance < FAR) & (distance <= (FAR if limit is None else limit)))
        row, far = source[r, c], distance[r, c]
        band = row // row_band
        order = np.argsort(band, kind="stable")
        parts = [order[a:b] for a, b in runs(band[order])]
        return pa.table({
            "band": pa.array([int(band[p[0]]) for p in parts], pa.int64()),
            **{k: pa.array([v[p].astype(np.int64).tobytes() for p in parts], pa.binary()) for k, v in (("r", r), ("c", c + low), ("row", row), ("far", far))},
        })

    def sources(key: tuple[pa.Scalar, ...], pieces: pa.Table, asked: pa.Table) -> pa.Table:
        out = {k: np.zeros(0, np.int64) for k in ("r", "c", "distance", "src_r", "src_c")} | {"value": np.zeros(0)}
        if asked.num_rows:
            low = key[0].as_py() * row_band
            values = unpacked(pieces, min(row_band, height - low), width)
            r, c, row, far = (np.frombuffer(b"".join(asked[k].to_pylist()), np.int64) for k in ("r", "c", "row", "far"))
            column, found = first_in_row(values, row - low, c, far)
            out = {"r": r, "c": c, "distance": far, "src_r": row, "src_c": column, "value": found}
        return pa.table(out)

    gaps = by_row.groupBy("ty").applyInArrow(rows, PIECES)
    asked = gaps.groupBy("tx").applyInArrow(columns, "band long, r binary, c binary, row binary, far binary")
    found = by_row.groupBy(F.col("ty").cast("long").alias("band")).cogroup(asked.groupBy("band")).applyInArrow(sources, "r long, c long, distance long, src_r long, src_c long, value double")
    return found.select("r", "c", F.col("value").alias(value), F.col("distance").cast("double").alias("distance"), "src_r", "src_c")
