"""Single-band float GeoTIFF rasters as cells, without a raster library.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do, and decoded block by block in
Arrow batches. Strips and tiles; no compression, Deflate or LZW, with or without a predictor; float32, float64 and
integers; either byte order; 32- and 64-bit offsets; coordinate systems by their EPSG code.
"""

from __future__ import annotations

import io
import os
import struct
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stash, unstash

#: Options that raster writers commonly use for elevations and depths.
DEFAULTS = {"driver": "GTiff", "dtype": "float32", "compress": "deflate", "nodata": -9999.0}

_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _BANDS, _ROWS, _COUNTS, _TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 322, 323, 324, 325, 339
_PREDICTOR, _SCALE, _TIEPOINT, _MATRIX, _KEYS, _NODATA = 317, 33550, 33922, 34264, 34735, 42113
#: Geographic and projected coordinate systems among the keys of a file; a code of 32767 means one without a number.
_GEOGRAPHIC, _PROJECTED, _NAMELESS = 2048, 3072, 32767
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Cells of a strip that is written: a strip is held whole by a task.
STRIP_CELLS = 1 << 20
#: Size from which a file gets 64-bit offsets.
LARGE = 4_000_000_000

_GRID = ("a", "e", "c", "f", "nodata")
CELLS = "raster_id string, r long, c long, value double"
HEADERS = "raster_id string, height long, width long, a double, e double, c double, f double, nodata double, crs string"


class Ranged:
    """Bytes of a file in a folder that the tasks share, or of an HTTP resource, read as they are sliced.

    Small reads go through pages of ``PAGE`` bytes that are kept; larger ones are read as they are.
    """

    PAGE = 1 << 16

    def __init__(self, path: str):
        self.path = path
        self.remote = path.startswith(("http://", "https://"))
        self.pages: dict[int, bytes] = {}

    def _read(self, start: int, size: int) -> bytes:
        if self.remote:
            asked = urllib.request.Request(self.path, headers={"Range": f"bytes={start}-{start + size - 1}"})
            try:
                with urllib.request.urlopen(asked) as r:
                    # a server that knows no ranges sends the whole resource
                    return r.read() if r.status == 206 else r.read()[start : start + size]
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    return b""
                raise
        with open(urllib.request.url2pathname(self.path.removeprefix("file:")), "rb") as f:
            f.seek(start)
            return f.read(size)

    def __getitem__(self, part: slice) -> bytes:
        start, size = part.start or 0, part.stop - (part.start or 0)
        if size >= self.PAGE:
            return self._read(start, size)
        out = b""
        for k in range(start // self.PAGE, (start + max(size, 1) - 1) // self.PAGE + 1):
            if k not in self.pages:
                self.pages[k] = self._read(k * self.PAGE, self.PAGE)
            out += self.pages[k]
        skipped = start % self.PAGE
        return out[skipped : skipped + size]


def _tags(data: bytes | Ranged) -> tuple[str, dict]:
    """Byte order and tags of a file's first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[0:2])
    take = lambda form, at: struct.unpack(order + form, data[at : at + struct.calcsize(order + form)])
    version = take("H", 2)[0] if order and len(data[0:8]) == 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, entry_size, count_size = ("I", 12, "H") if version == 42 else ("Q", 20, "Q")
    inline, first = struct.calcsize(word), 4 if version == 42 else 8
    at = take(word, first)[0]
    (entries,), at = take(count_size, at), at + struct.calcsize(count_size)
    tags = {}
    for entry in range(at, at + entries * entry_size, entry_size):
        tag, kind, count = take("HH" + word, entry)
        if kind not in _TYPES:
            continue
        size = struct.calcsize(order + _TYPES[kind]) * count
        held = entry + entry_size - inline
        place = held if size <= inline else take(word, held)[0]
        raw = data[place : place + size]
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count}{_TYPES[kind]}", raw)
    return order, tags


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, previous = bytearray(), [], b""
    bits = nbits = 0
    width, at = 9, 0
    while True:
        while nbits < width:
            if at >= len(data):
                return bytes(out)
            bits, nbits, at = (bits << 8) | data[at], nbits + 8, at + 1
        nbits -= width
        code = (bits >> nbits) & ((1 << width) - 1)
        bits &= (1 << nbits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, previous = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _unpredicted(block: np.ndarray, predictor: int) -> np.ndarray:
    """Rows of a block without their predictor: 2 sums the differences along a row, 3 does so over split float bytes."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, size = *block.shape, block.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, size, columns).transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns)
    raise ValueError(f"predictor {predictor} of {block.dtype} isn't supported")


def layout(data: bytes | Ranged, only: Iterable[int] | None = None) -> Iterator[dict]:
    """Each strip or tile of a file, or those of some numbers: its place (y, x) and extent in cells, where its bytes lie, and how to decode them."""
    order, t = _tags(data)
    width, height = t[_WIDTH][0], t[_HEIGHT][0]
    if t.get(_BANDS, (1,))[0] != 1:
        raise ValueError("exactly one band is supported")
    kind = {1: "u", 2: "i", 3: "f"}[t.get(_FORMAT, (1,))[0]]
    how = {"dtype": f"{order}{kind}{t[_BITS][0] // 8}", "compression": t.get(_COMPRESSION, (1,))[0], "predictor": t.get(_PREDICTOR, (1,))[0]}
    if _TILE_OFFSETS in t:
        tw, th = t[_TILE_W][0], t[_TILE_H][0]
        across = -(-width // tw)
        places, counts = t[_TILE_OFFSETS], t[_TILE_COUNTS]
    else:
        tw, th, across = width, min(height, t.get(_ROWS, (height,))[0]), 1
        places, counts = t[_OFFSETS], t[_COUNTS]
    for k in range(len(places)) if only is None else only:
        place, count = places[k], counts[k]
        y, x = k // across * th, k % across * tw
        yield {"y": y, "x": x, "height": min(th, height - y), "width": min(tw, width - x), "stride": tw, "place": place, "count": count, **how}


def grid_of_blocks(data: bytes | Ranged) -> dict[str, int]:
    """Rows (th) and columns (tw) of a file's blocks, and how many lie below and beside each other."""
    t = _tags(data)[1]
    width, height = t[_WIDTH][0], t[_HEIGHT][0]
    tw, th = (t[_TILE_W][0], t[_TILE_H][0]) if _TILE_OFFSETS in t else (width, min(height, t.get(_ROWS, (height,))[0]))
    return {"tw": tw, "th": th, "across": -(-width // tw), "down": -(-height // th)}


def unpack(raw: bytes, block: dict) -> np.ndarray:
    """Values of a strip or tile from its bytes."""
    decompress = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: unlzw}.get(block["compression"])
    if decompress is None:
        raise ValueError(f"compression {block['compression']} isn't supported")
    dtype, stride = np.dtype(block["dtype"]), block["stride"]
    values = np.frombuffer(decompress(raw), dtype)
    values = _unpredicted(values[: len(values) // stride * stride].reshape(-1, stride), block["predictor"])
    return values[: block["height"], : block["width"]].astype(dtype.newbyteorder("="))


def blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and values of each strip or tile of a file; blocks without bytes are left out."""
    for b in layout(data):
        if b["count"]:
            yield b["y"], b["x"], unpack(data[b["place"] : b["place"] + b["count"]], b)


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """Values (rows x columns) and the grid: a, e, c, f of its affine transform and nodata. ``header`` has the rest."""
    grid = header(data)
    out = np.full((grid["height"], grid["width"]), grid["nodata"] or 0, np.dtype(next(layout(data))["dtype"]).newbyteorder("="))
    for y, x, block in blocks(data):
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out, {k: grid[k] for k in _GRID}


def _placed(t: dict) -> dict[str, float | str | None]:
    if _MATRIX in t:
        m = t[_MATRIX]
        if m[1] or m[4]:
            raise ValueError("rotated grids aren't supported")
        place = {"a": m[0], "e": m[5], "c": m[3], "f": m[7]}
    else:
        scale, tie = t.get(_SCALE, (1.0, 1.0, 0.0)), t.get(_TIEPOINT, (0.0,) * 6)
        place = {"a": scale[0], "e": -scale[1], "c": tie[3] - tie[0] * scale[0], "f": tie[4] + tie[1] * scale[1]}
    keys = t.get(_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(_PROJECTED) or codes.get(_GEOGRAPHIC)
    return {**place, "nodata": float(t[_NODATA]) if _NODATA in t else None, "crs": f"EPSG:{code}" if code and code != _NAMELESS else None}


def header(data: bytes) -> dict[str, float | str | None]:
    """height, width, a, e, c, f, nodata and crs of a file, from its tags alone."""
    t = _tags(data)[1]
    return {"height": t[_HEIGHT][0], "width": t[_WIDTH][0], **_placed(t)}


def strip(values: np.ndarray, compress: str = "deflate") -> bytes:
    """Rows as a strip of a float32 file."""
    return {"none": bytes, "deflate": zlib.compress}[compress](np.ascontiguousarray(values, "<f4").tobytes())


def write_strips(
    to: BinaryIO, strips: Iterable[bytes], height: int, width: int, rows: int, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, nodata: float | None = None, compress: str = "deflate", crs: str | None = None
) -> None:
    """Writes a single-band float32 file from its strips of ``rows`` rows, one at a time; 64-bit offsets where its cells need them."""
    large = 4 * height * width >= LARGE
    word, wide = ("Q", 16) if large else ("I", 4)
    to.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if large else struct.pack("<HI", 42, 0)))
    places, counts = [], []
    for s in strips:
        places.append(to.tell())
        counts.append(len(s))
        to.write(s + b"\0" * (len(s) % 2))
    entries = [
        (_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [32]), (_COMPRESSION, 3, [{"none": 1, "deflate": 8}[compress]]), (262, 3, [1]), (_OFFSETS, wide, places), (_BANDS, 3, [1]), (_ROWS, 4, [rows]),
        (_COUNTS, wide, counts), (_FORMAT, 3, [3]), (_SCALE, 12, [a, -e, 0.0]), (_TIEPOINT, 12, [0.0, 0.0, 0.0, c, f, 0.0]),
    ]
    if crs is not None:
        code = int(crs.upper().removeprefix("EPSG:"))
        geographic = 4000 <= code < 5000
        entries.append((_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1 + geographic, 1025, 0, 1, 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, code]))
    if nodata is not None:
        entries.append((_NODATA, 2, f"{nodata:.17g}\0".encode()))
    directory = struct.pack("<Q" if large else "<H", len(entries))
    inline, at = struct.calcsize(word), to.tell()
    extra, start = bytearray(), at + len(directory) + (4 + 2 * inline) * len(entries) + inline
    for tag, kind, items in entries:
        raw = items if kind == 2 else struct.pack(f"<{len(items)}{_TYPES[kind]}", *items)
        held = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + word, start + len(extra))
        directory += struct.pack("<HH" + word, tag, kind, len(items)) + held
        if len(raw) > inline:
            extra += raw + b"\0" * (len(raw) % 2)
    to.write(directory + bytes(inline) + extra)
    to.seek(8 if large else 4)
    to.write(struct.pack("<" + word, at))


def encode(values: np.ndarray, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, nodata: float | None = None, compress: str = "deflate", rows: int = 256, crs: str | None = None) -> bytes:
    """A single-band float32 file in strips."""
    height, width = values.shape
    out = io.BytesIO()
    write_strips(out, (strip(values[y : y + rows], compress) for y in range(0, height, rows)), height, width, rows, a, e, c, f, nodata, compress, crs)
    return out.getvalue()


def is_ranged(path: str) -> bool:
    """Whether a path can be read by ranges of bytes: a shared folder's, or an HTTP address."""
    return "://" not in path or path.startswith(("file://", "http://", "https://"))


def read_cells(spark: SparkSession, path: str, keep_nan: bool = False) -> DataFrame:
    """raster_id (path), r, c, value of every cell of the files at ``path``; nodata is null, and so is NaN unless it is kept."""
    return decode_cells(spark.read.format("binaryFile").load(path).select(F.col("path").alias("raster_id"), "content"), keep_nan)


def _batch(name: str, y: int, x: int, block: np.ndarray, nodata: float | None, keep_nan: bool = False) -> pa.RecordBatch:
    height, width = block.shape
    flat = block.ravel().astype(np.float64)
    gone = np.isnan(flat) & (not keep_nan or (nodata is not None and np.isnan(nodata)))
    if nodata is not None:
        gone |= (flat == nodata) | (flat == np.float32(nodata))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(flat), pa.string()), pa.array(np.repeat(np.arange(y, y + height), width)), pa.array(np.tile(np.arange(x, x + width), height)), pa.array(flat, mask=gone)], ["raster_id", "r", "c", "value"]
    )


def decode_cells(files: DataFrame, keep_nan: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodata = header(content)["nodata"]
                for y, x, block in blocks(content):
                    yield _batch(name, y, x, block, nodata, keep_nan)

    return files.select("raster_id", "content").mapInArrow(run, CELLS)


def ranged_headers(paths: DataFrame) -> DataFrame:
    """``paths`` (raster_id, a shared or HTTP path) with height, width, a, e, c, f, nodata and crs, of which only the tags are read."""

    def run(batches):
        for batch in batches:
            rows = [{"raster_id": path, **header(Ranged(path))} for path in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _header_kinds())

    return paths.select("raster_id").mapInArrow(run, HEADERS)


def ranged_cells(paths: DataFrame, parallel: int, within: Column | None = None, keep_nan: bool = False) -> DataFrame:
    """Cells of files (raster_id: a path that all tasks share, or an HTTP address) of any size, read by ranges of bytes.

    A file's strips or tiles are spread over ``parallel`` tasks. ``within``, over y, x, height and width of a block,
    leaves out blocks before their bytes are read. Cells are as ``read_cells`` gives them.
    """

    def listed(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                data = Ranged(path)
                nodata = header(data)["nodata"]
                rows = [{"raster_id": path, "nodata": nodata, **b} for b in layout(data) if b["count"]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                raw = Ranged(b["raster_id"])[b["place"] : b["place"] + b["count"]]
                yield _batch(b["raster_id"], b["y"], b["x"], unpack(raw, b), b["nodata"], keep_nan)

    numbers = ("y", "x", "height", "width", "stride", "place", "count", "compression", "predictor")
    kinds = pa.schema([("raster_id", pa.string()), ("nodata", pa.float64()), *((k, pa.int64()) for k in numbers), ("dtype", pa.string())])
    found = paths.select("raster_id").mapInArrow(listed, "raster_id string, nodata double, " + ", ".join(f"`{k}` long" for k in numbers) + ", dtype string")
    return (found if within is None else found.where(within)).repartition(parallel, "raster_id", "place").mapInArrow(run, CELLS)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, height, width, a, e, c, f, nodata and crs of the files at ``path``; where it can be read by ranges, from their tags alone."""
    if is_ranged(path):
        from .rasters import files_of

        found = files_of(path)
        return ranged_headers(spark.createDataFrame([(f,) for f in found], "raster_id string").repartition(max(1, min(len(found), 1000)), "raster_id"))
    return headers(spark.read.format("binaryFile").load(path).select(F.col("path").alias("raster_id"), "content"))


def headers(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [{"raster_id": name, **header(content)} for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _header_kinds())

    return files.select("raster_id", "content").mapInArrow(run, HEADERS)


def _header_kinds() -> pa.Schema:
    return pa.schema([("raster_id", pa.string()), ("height", pa.int64()), ("width", pa.int64()), *((k, pa.float64()) for k in _GRID), ("crs", pa.string())])


def _gridded(table: pa.Table, nodata: float, r0: int, c0: int, height: int, width: int) -> np.ndarray:
    grid = np.full((height, width), nodata)
    v = table["value"].to_numpy().astype(float)
    grid[table["r"].to_numpy() - r0, table["c"].to_numpy() - c0] = np.where(np.isnan(v), nodata, v)
    return grid


def _cells(cells: DataFrame, value: str, *more: str) -> DataFrame:
    return cells.select(*more, F.col("r").cast("long"), F.col("c").cast("long"), F.col(value).cast("double").alias("value"))


def encode_cells(cells: DataFrame, by: str, value: str, nodata: float = -9999.0, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, crs: str | None = None) -> DataFrame:
    """One file (``by``, content) for each raster of cells (by, r, c, value); a raster is held whole by one task.

    ``write_raster`` and ``write_tiles`` take scenes of any size. Nulls and absent cells are ``nodata``. A cell is
    ``a`` wide and -``e`` high, and the upper left corner of all rasters lies at (``c``, ``f``).
    """
    kind = cells.schema[by].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        height, width = (int(table[k].to_numpy().max()) + 1 for k in ("r", "c"))
        grid = _gridded(table, nodata, 0, 0, height, width)
        return pa.table({by: table[by].slice(0, 1), "content": pa.array([encode(grid, a, e, c, f, nodata, crs=crs)], pa.binary())})

    return _cells(cells, value, by).groupBy(by).applyInArrow(run, f"`{by}` {kind}, content binary")


def write_raster(cells: DataFrame, value: str, path: str, height: int, width: int, nodata: float = -9999.0, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, crs: str | None = None) -> str:
    """Cells (r, c, value) as one file on the driver's side.

    Executors encode strips of at most ``STRIP_CELLS`` cells (one row at least); the driver appends them in order, a
    partition's strips at a time. Absent cells and nulls are ``nodata``. The file appears once it is whole.
    """
    rows = max(1, min(256, height, STRIP_CELLS // width))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = key[0].as_py() * rows
        grid = _gridded(table, nodata, first, 0, min(rows, height - first), width)
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([strip(grid)], pa.binary())})

    inside = _cells(cells, value).where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    strips = stash(inside.groupBy(F.expr(f"r div {rows}").alias("strip")).applyInArrow(run, "strip long, content binary"))

    def in_order() -> Iterator[bytes]:
        empty = lambda k: strip(np.full((min(rows, height - k * rows), width), nodata))
        at = 0
        for row in strips.orderBy("strip").toLocalIterator():
            yield from (empty(k) for k in range(at, row["strip"]))
            yield bytes(row["content"])
            at = row["strip"] + 1
        yield from (empty(k) for k in range(at, -(-height // rows)))

    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f"{to.name}.{uuid.uuid4().hex}.part")
    try:
        with open(part, "wb") as file:
            write_strips(file, in_order(), height, width, rows, a, e, c, f, nodata, crs=crs)
        os.replace(part, to)
    finally:
        part.unlink(missing_ok=True)
    unstash(strips)
    return path


def write_tiles(cells: DataFrame, value: str, folder: str, side: int = 1024, nodata: float = -9999.0, a: float = 1.0, e: float = -1.0, c: float = 0.0, f: float = 0.0, crs: str | None = None) -> DataFrame:
    """Cells (r, c, value) as files of at most side x side cells, written by the executors into a folder they share.

    Returns path, tile_row, tile_col, height and width of each file. A file has its own corner and appears once it is
    whole, so repeated tasks do no harm. Tiles without cells have no file; a tile reaches as far as its last cell. Files
    that the driver doesn't see afterwards, as the folder isn't shared, are an error.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        y, x = (k.as_py() for k in key)
        height, width = (int(table[k].to_numpy().max()) + 1 - at * side for k, at in (("r", y), ("c", x)))
        grid = _gridded(table, nodata, y * side, x * side, height, width)
        to = os.path.join(folder, f"tile_{y}_{x}.tif")
        part = f"{to}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as file:
            file.write(encode(grid, a, e, c + x * side * a, f + y * side * e, nodata, crs=crs))
        os.replace(part, to)
        return pa.table({"path": [to], **{k: pa.array([v], pa.int64()) for k, v in (("tile_row", y), ("tile_col", x), ("height", height), ("width", width))}})

    keys = (F.expr(f"r div {side}").alias("tile_row"), F.expr(f"c div {side}").alias("tile_col"))
    written = stash(_cells(cells, value).groupBy(*keys).applyInArrow(run, "path string, tile_row long, tile_col long, height long, width long"))
    for row in written.select("path").toLocalIterator():
        if not os.path.exists(row["path"]):
            raise RuntimeError(f"executors wrote {row['path']}, which the driver doesn't see: the folder must be shared")
    return written
