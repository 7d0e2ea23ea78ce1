"""Shared helpers: tables, checkpoints and vectorised word tables over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stash as stash
from ..sources.storage import unstash as unstash

#: White space of the word contracts: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at once inside a task; a longer document is a chunk of its own.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
#: Base of hashes that are independent of the usual ones.
OTHER_BASE = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frequent_bound(counts: DataFrame, column: str, most: int) -> int:
    """The least power of two that at most ``most`` rows reach in ``column``, which holds positive whole numbers."""
    power = F.length(F.bin(column)) - 1
    rows = dict(counts.groupBy(power.alias("power")).count().collect())
    reach = 0
    for k in sorted(rows, reverse=True):
        reach += rows[k]
        if reach > most:
            return 2 ** (k + 1)
    return 1


#: Keys with more than one in so many rows are joined by broadcast.
HOT_KEYS = 1000


def join_skewed(rows: DataFrame, told: DataFrame, key: str, size: str, how: str = "inner", hot: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined with ``told``, which has one row for each key and, in ``size``, the key's number of rows at least.

    Keys with over 1 / ``hot`` of all the sizes, of which there are fewer than ``hot``, are broadcast; no other key has more
    rows than that, so the others join by a shuffle. ``told`` is read three times: let it be a written table or cheap.
    """
    total = told.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    often = F.col(size) * hot > F.lit(total)
    rest = rows.join(F.broadcast(told.where(often).select(key)), key, "left_anti")
    return rows.join(F.broadcast(told.where(often)), key).unionByName(rest.join(told.where(~often), key, how))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        steps = np.full(max(n, CHUNK + 1), np.uint64(base))
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(base, -1, 1 << 64))
        _powers[base] = up, np.multiply.accumulate(steps)
    up, down = _powers[base]
    return up[:n], down[:n]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``limit`` bytes: first, end, UTF-8 bytes, offsets into them. Null is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word_bytes`` in each document, and each document's first word number."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed."""
    up, down = powers(len(data) + 1, base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def run_hashes(words: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash of every ``length`` consecutive entries, in order."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out *= np.uint64(base)
        out += words[k : k + n]
    return mix64(out)
