"""Rasters as text: a header of names and values, then rows of numbers. Read by lines spread over tasks, written by strips.

A file is one sequence of numbers, however its lines are cut. Lines come in splits of the file; the numbers of each
split are counted, the counts summed up over the file's splits, and each split's numbers placed from there: no file is
read by one task, and only counts meet.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import geotiff
from .storage import stash, unstash

# Fixed names of the format's header; corners or centres place the lower left cell.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")
#: Cells of a strip of lines that is written.
STRIP_CELLS = 1 << 18
#: What a line of the header looks like.
_NAMED = r"^\s*[A-Za-z_]+\s+\S+\s*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, split (its start in the file), line and at (in order within a split) of text files."""
    text = spark.read.text(path)
    where = text.select("value", F.col("_metadata.file_path").alias("raster_id"), F.col("_metadata.file_block_start").alias("split"))
    return where.select("raster_id", "split", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, height, width, a, e, c, f, nodata and crs (null) of the text rasters at ``path``."""
    named = _lines(spark, path).where(F.col("line").rlike(_NAMED) & F.lower(F.split(F.trim("line"), r"\s+")[0]).isin(*HEADER))
    pairs = named.select("raster_id", F.lower(F.split(F.trim("line"), r"\s+")[0]).alias("name"), F.split(F.trim("line"), r"\s+")[1].cast("double").alias("value"))
    wide = pairs.groupBy("raster_id").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in HEADER))
    size, rows = F.col("cellsize"), F.col("nrows")
    left = F.coalesce("xllcorner", F.col("xllcenter") - size / 2)
    bottom = F.coalesce("yllcorner", F.col("yllcenter") - size / 2)
    return wide.select("raster_id", rows.cast("long").alias("height"), F.col("ncols").cast("long").alias("width"), size.alias("a"), (-size).alias("e"), left.alias("c"), (bottom + rows * size).alias("f"), F.col("nodata_value").alias("nodata"), F.lit(None).cast("string").alias("crs"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, r, c and value of the text rasters at ``path``; nodata and NaN are null.

    A file with fewer or more numbers than its header says raises; so does one without a whole header.
    """
    lines = _lines(spark, path).where(~(F.col("line").rlike(_NAMED) & F.lower(F.split(F.trim("line"), r"\s+")[0]).isin(*HEADER)) & (F.trim("line") != ""))
    # one row for each line, with the numbers before it in its split
    numbers = F.size(F.split(F.trim("line"), r"\s+"))
    counted = lines.withColumn("n", numbers).withColumn("before", F.sum("n").over(Window.partitionBy("raster_id", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    splits = lines.groupBy("raster_id", "split").agg(F.sum(numbers).alias("n"))
    own = Window.partitionBy("raster_id").orderBy("split")  # a row for each split of a file
    offsets = splits.select("raster_id", "split", (F.sum("n").over(own) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("raster_id")).alias("total"))
    placed = counted.select("raster_id", "split", "line", F.coalesce("before", F.lit(0)).alias("before")).join(offsets, ["raster_id", "split"])
    head = headers(spark, path).select("raster_id", "height", "width", "nodata")
    rows = placed.join(head, "raster_id")
    whole = F.assert_true(F.col("height").isNotNull() & F.col("width").isNotNull() & (F.col("total") == F.col("height") * F.col("width")), F.lit("a text raster must have as many numbers as its header says")).isNull()

    def run(batches):
        for batch in batches:
            for name, line, first, width, nodata in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = np.array(line.split(), np.float64)
                at = first + np.arange(len(flat))
                gone = np.isnan(flat) | ((flat == nodata) if nodata is not None else False)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat), pa.string()), pa.array(at // width), pa.array(at % width), pa.array(flat, mask=gone)], ["raster_id", "r", "c", "value"])

    return rows.where(whole).select("raster_id", "line", (F.col("offset") + F.col("before")).alias("first"), "width", "nodata").mapInArrow(run, geotiff.CELLS)


def write_raster(cells: DataFrame, value: str, path: str, height: int, width: int, nodata: float = -9999.0, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0) -> str:
    """Cells (r, c, value) as one text file on the driver's side; cells must be square.

    Executors write strips of lines; the driver appends them in order, a partition's at a time. Absent cells, nulls
    and NaN are ``nodata``. The file appears once it is whole. Numbers are written so that they read back as they were.
    """
    if abs(a + e) > 1e-9 * abs(a):
        raise ValueError(f"a text raster has square cells, not {a} x {-e}")
    rows = max(1, STRIP_CELLS // width)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = key[0].as_py() * rows
        grid = geotiff._gridded(table, nodata, first, 0, min(rows, height - first), width)
        text = "\n".join(" ".join(map(repr, row)) for row in grid.tolist())
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([text], pa.string())})

    inside = geotiff._cells(cells, value).where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    strips = stash(inside.groupBy(F.expr(f"r div {rows}").alias("strip")).applyInArrow(run, "strip long, content string"))

    def in_order() -> Iterator[str]:
        empty = lambda k: "\n".join([" ".join([repr(nodata)] * width)] * min(rows, height - k * rows))
        at = 0
        for row in strips.orderBy("strip").toLocalIterator():
            yield from (empty(k) for k in range(at, row["strip"]))
            yield row["content"]
            at = row["strip"] + 1
        yield from (empty(k) for k in range(at, -(-height // rows)))

    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
    named = dict(zip(("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "NODATA_value"), (width, height, c, f + height * e, a, nodata), strict=True))
    try:
        with open(part, "w") as file:
            file.writelines(f"{k} {v!r}\n" for k, v in named.items())
            file.writelines(f"{s}\n" for s in in_order())
        os.replace(part, to)
    finally:
        part.unlink(missing_ok=True)
    unstash(strips)
    return path
