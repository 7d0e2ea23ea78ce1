"""Rasters as a data source: a window leaves out blocks before their bytes are read, and tiles are published together or not at all.

``spark.read.format("raster").load(path)`` gives cells (raster_id, r, c, value); the options ``rows`` and ``columns``, as
"first:last", name a window, and a partition is a run of blocks of one file. Filters aren't pushed down by themselves:
in Spark 4.1.2 the scans of one DataFrame share what was pushed last, so that a union of two windows, or a count after
a filter, comes out wrong. ``tiles.write.format("raster")``
takes tile arrays (y, x, height, width, px): tasks write files into a hidden folder, which the commit moves into
place; what a failed job or a repeated task wrote is never seen.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import shutil
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import geotiff

#: Cells of a partition, about; one block at least.
PARTITION_CELLS = 1 << 22
#: Lists a written scene's files; a scene without it isn't whole.
INDEX = "index.json"


def files_of(path: str) -> list[str]:
    """A file, an HTTP address, what a pattern names, or the tiles that a scene's index lists."""
    if path.startswith(("http://", "https://")):
        return [path]
    place = urllib.request.url2pathname(path.removeprefix("file:"))
    if not os.path.isdir(place):
        return sorted(glob.glob(place)) or [place]
    index = os.path.join(place, INDEX)
    if os.path.exists(index):
        with open(index) as f:
            return [os.path.join(place, t["file"]) for t in json.load(f)["tiles"]]
    return sorted(glob.glob(os.path.join(place, "*.tif")))


@dataclass
class Run(InputPartition):
    """Blocks of a file, by number."""

    path: str
    blocks: list[int]


def _bounds(said: str | None) -> tuple[int, int]:
    """First and last of "first:last", either of which may be missing."""
    first, _, last = (said or ":").partition(":")
    return int(first or 0), int(last or (1 << 62))


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.rows, self.columns = _bounds(options.get("rows")), _bounds(options.get("columns"))

    def partitions(self) -> list[Run]:
        """From the files' headers alone: which blocks meet the window follows from their size."""
        out = []
        for path in files_of(self.path):
            g = geotiff.grid_of_blocks(geotiff.Ranged(path))
            rows, columns = (range(max(0, low // side), min(n, high // side + 1)) for (low, high), side, n in ((self.rows, g["th"], g["down"]), (self.columns, g["tw"], g["across"])))
            wanted = [y * g["across"] + x for y in rows for x in columns]
            step = max(1, PARTITION_CELLS // (g["th"] * g["tw"]))
            out += [Run(path, wanted[k : k + step]) for k in range(0, len(wanted), step)]
        return out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block is asked for
            return
        data = geotiff.Ranged(partition.path)
        nodata = geotiff.header(data)["nodata"]
        for b in geotiff.layout(data, partition.blocks):
            if b["count"]:
                values = geotiff.unpack(data[b["place"] : b["place"] + b["count"]], b)
                top, left = max(0, self.rows[0] - b["y"]), max(0, self.columns[0] - b["x"])
                bottom, right = min(b["height"], self.rows[1] - b["y"] + 1), min(b["width"], self.columns[1] - b["x"] + 1)
                yield geotiff._batch(partition.path, b["y"] + top, b["x"] + left, values[top:bottom, left:right], nodata)


@dataclass
class Written(WriterCommitMessage):
    tiles: list[dict]


class Writer(DataSourceArrowWriter):
    """Tiles as files of a scene. Each writing job has a hidden folder of its own, so that tasks that are run again do no harm."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = urllib.request.url2pathname(options["path"].removeprefix("file:"))
        if "://" in self.folder:
            raise ValueError("scenes are written into a folder that the driver and all tasks share")
        self.place = {k: float(options.get(k, d)) for k, d in (("a", 1.0), ("e", -1.0), ("c", 0.0), ("f", 0.0), ("nodata", -9999.0))}
        self.crs = options.get("crs")
        self.overwrite = overwrite
        if os.path.exists(os.path.join(self.folder, INDEX)) and not overwrite:
            raise FileExistsError(f"{self.folder} holds a scene; mode overwrite replaces it")
        self.job = uuid.uuid4().hex
        self.hidden = os.path.join(self.folder, f".{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        tiles = []
        for batch in iterator:
            for y, x, height, width, px in zip(*(batch[k].to_pylist() for k in ("y", "x", "height", "width", "px")), strict=True):
                values = np.array(px, np.float64).reshape(height, width)
                values = np.where(np.isfinite(values), values, self.place["nodata"])
                name = f"tile_{y}_{x}_{uuid.uuid4().hex}.tif"
                with open(os.path.join(self.hidden, name), "wb") as f:
                    f.write(geotiff.encode(values, self.place["a"], self.place["e"], self.place["c"] + x * self.place["a"], self.place["f"] + y * self.place["e"], self.place["nodata"], crs=self.crs))
                tiles.append({"file": name, "y": y, "x": x, "height": height, "width": width})
        return Written(tiles)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files that successful tasks wrote, then writes the index, which makes them a scene; files of an earlier scene go."""
        tiles = sorted((t for m in messages if m for t in m.tiles), key=lambda t: (t["y"], t["x"]))
        os.makedirs(self.folder, exist_ok=True)
        index = os.path.join(self.folder, INDEX)
        before = files_of(self.folder) if os.path.exists(index) else []
        for t in tiles:
            os.replace(os.path.join(self.hidden, t["file"]), os.path.join(self.folder, t["file"]))
        part = f"{index}.{self.job}"
        with open(part, "w") as f:
            json.dump({"tiles": tiles, **self.place, "crs": self.crs}, f)
        os.replace(part, index)
        for path in before:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """A task that is still being stopped may write on: what it leaves stays hidden."""
        shutil.rmtree(self.hidden, ignore_errors=True)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return geotiff.CELLS

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(RasterSource)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """raster_id, r, c and value of a file's cells, or of those from a first to a last row and column; nodata is null."""
    register(spark)
    window = {k: f"{w[0]}:{w[1]}" for k, w in (("rows", rows), ("columns", columns)) if w}
    return spark.read.format("raster").options(**window).load(path)


def read_scene(spark: SparkSession, folder: str, row: int, column: int, height: int, width: int) -> DataFrame:
    """r, c and value, numbered from the window's corner, of a written scene; only tiles that the index places in the window are opened."""
    with open(os.path.join(folder, INDEX)) as f:
        tiles = [t for t in json.load(f)["tiles"] if t["y"] < row + height and t["y"] + t["height"] > row and t["x"] < column + width and t["x"] + t["width"] > column]
    if not tiles:
        return spark.createDataFrame([], "r long, c long, value double")
    from pyspark.sql import functions as F

    paths = spark.createDataFrame([(os.path.join(folder, t["file"]), t["y"] - row, t["x"] - column) for t in tiles], "raster_id string, dy long, dx long")
    cells = geotiff.ranged_cells(paths, max(1, min(len(tiles), 10_000)))
    placed = cells.join(F.broadcast(paths), "raster_id") if len(tiles) <= 100_000 else cells.join(paths, "raster_id")
    moved = placed.select((F.col("r") + F.col("dy")).alias("r"), (F.col("c") + F.col("dx")).alias("c"), "value")
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))


def write_scene(tiles: DataFrame, folder: str, **place: float | str) -> str:
    """Writes tile arrays as a scene, in place of an earlier one; ``place`` has a, e, c, f, nodata and crs."""
    register(tiles.sparkSession)
    tiles.select("y", "x", "height", "width", "px").write.format("raster").mode("overwrite").options(**{k: str(v) for k, v in place.items() if v is not None}).save(folder)
    return folder
