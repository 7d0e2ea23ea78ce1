"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are dealt to buckets, each a range of keys with some megabytes of text, so that of two buckets one holds
only earlier documents. A bucket settles its own repeats and speaks for its documents as one: a window that a third of
all documents share is posted once by each bucket, however many of its documents have it.

1. Every bucket posts the hashes of its distinct windows, 5 bytes each, to groups that hold a range of hashes; the
   group's number is more of the hash. A group marks the hashes that several buckets have.
2. The buckets post the marked windows again, 10 bytes each: a second, independent hash and part of the first. A group
   tells each bucket which of them an earlier bucket has.
3. The buckets add the repeats within, merge the windows into maximal removal intervals and drop the covered words.

Step 2 decides, on 80 bits and the group's number. Of the windows of 30 GB of text an expected 3e-9 are mistaken for
repeats, of those of 100 TB 8e-5; within a bucket 128 bits decide. The words themselves aren't compared. The three
steps read one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, OTHER_BASE, chunks, run_hashes, table, word_bounds, word_hashes

#: Words of a window.
WINDOW = 20
#: Least and most bytes of text in a bucket of documents, about. A word takes some 6 bytes.
BUCKET_BYTES = 4 << 20, 32 << 20
#: Least and most bytes of text whose windows share a group, about.
GROUP_BYTES = 4 << 20, 64 << 20
#: Text whose buckets, or whose windows' groups, share a partition, about, and most partitions. A partition's buckets and
#: groups are its sort keys, and a task handles them one after the other: only the largest one is in memory.
PARTITION_BYTES, PARTITIONS = 8 << 20, 10_000
#: Documents looked at to bound a bucket, about.
SAMPLES = 8
#: Bytes from which a word's second hash isn't polynomial, so that no word has both hashes of another by its pattern.
LONG_WORD = 64
#: Bytes of a window in the two postings.
FIRST, SECOND = 5, 10

_POSTING = "grp int, bucket int, hashes binary, marks binary"
_REPLY = "bucket int, grp int, bits binary, marks binary"


class Bucket(NamedTuple):
    """A bucket's rows by key, those without one last, and the windows of their texts."""

    keys: list
    known: int  # rows with a key
    texts: list[np.ndarray]  # UTF-8
    words: list[tuple[np.ndarray, np.ndarray]]  # starts and ends
    sizes: np.ndarray  # windows of each row
    first: np.ndarray  # hashes of all windows
    second: np.ndarray


def _first_hashes(words: np.ndarray, window: int) -> np.ndarray:
    return run_hashes(words, window)


def _second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    words = word_hashes(data, starts, ends, OTHER_BASE)
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        words[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return run_hashes(words, window, OTHER_BASE)


def _bucket(rows: pa.Table, window: int, both: bool = True) -> Bucket:
    rows = rows.sort_by([("key", "ascending")])  # nulls come last
    keys, texts, words, sizes, first, second = rows["key"].to_pylist(), [], [], [], [], []
    for column in rows["text"].chunks:
        for i, j, data, offsets in chunks(column):
            starts, ends, at = word_bounds(data, offsets, NOT_SPACE)
            one = _first_hashes(word_hashes(data, starts, ends), window)
            two = _second_hashes(data, starts, ends, window) if both else one
            for k in range(j - i):
                a, b, base = int(at[k]), int(at[k + 1]), int(offsets[k])
                own = slice(a, max(a, b - window + 1))
                texts.append(data[base : offsets[k + 1]])
                words.append((starts[a:b] - base, ends[a:b] - base))
                sizes.append(own.stop - a)
                first.append(one[own])
                second.append(two[own])
    nothing = [np.zeros(0, np.uint64)]
    return Bucket(keys, len(keys) - rows["key"].null_count, texts, words, np.array(sizes, np.int64), np.concatenate(first + nothing), np.concatenate(second + nothing))


def _groups_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The groups of hashes, which are equal ranges."""
    return np.minimum(hashes // np.uint64(((1 << 64) - 1) // groups), np.uint64(groups - 1)).astype(np.int64)


def _cuts(groups: np.ndarray) -> list[tuple[int, int, int]]:
    """Each group in a sorted array with its start and end."""
    at = np.flatnonzero(np.diff(groups, prepend=-1))
    return list(zip(groups[at].tolist(), at.tolist(), np.append(at[1:], len(groups)).tolist(), strict=True)) if len(at) else []


def _packed(values: list[np.ndarray], widths: list[int]) -> np.ndarray:
    """The low bytes of whole numbers, side by side."""
    return np.concatenate([np.ascontiguousarray(v, np.uint64).view(np.uint8).reshape(-1, 8)[:, :w] for v, w in zip(values, widths, strict=True)], axis=1)


def _table(rows: list[tuple], names: tuple[str, ...], *types: pa.DataType) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], list(names))


def _posting(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("grp", "bucket", "hashes", "marks"), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _poster(window: int, groups: int):
    """Step 1 of a bucket."""

    def post(rows: pa.Table) -> pa.Table:
        own = _bucket(rows, window, False)
        hashes = np.sort(own.first[: int(own.sizes[: own.known].sum())])
        distinct = hashes[_changes(hashes)]
        bucket, packed = rows["bucket"][0].as_py(), _packed([distinct], [FIRST])
        return _posting([(g, bucket, packed[a:b].tobytes(), None) for g, a, b in _cuts(_groups_of(distinct, groups))])

    return post


def _by_group(rows: pa.Table, column: str) -> dict[int, bytes]:
    return {g: b for g, b in zip(rows["grp"].to_pylist(), rows[column].to_pylist(), strict=True) if b is not None}


def _marked(bits: dict[int, bytes], cuts: list[tuple[int, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for g, a, b in cuts:
        if g in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[g], np.uint8), count=b - a)
    return out


class _Distinct(NamedTuple):
    """Distinct windows of the rows with a key."""

    order: np.ndarray  # of those windows, by hashes and then by place
    runs: np.ndarray  # starts of equal windows in this order
    hashes: np.ndarray  # distinct first hashes
    of: np.ndarray  # of each distinct window, the place of its first hash


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    """Which entries differ from the one before."""
    out = np.zeros(len(sorted_[0]), bool)
    out[:1] = True
    for x in sorted_:
        out[1:] |= x[1:] != x[:-1]
    return out


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by both hashes, equal ones in order, and which begin a run of equal ones."""
    order = np.argsort(first, kind="stable")
    new, either = _changes(first[order]), _changes(first[order], second[order])
    if (new != either).any():  # windows of other words with one first hash
        order = np.lexsort((second, first))
        either = _changes(first[order], second[order])
    return order, either


def _distinct(own: Bucket) -> _Distinct:
    n = int(own.sizes[: own.known].sum())
    order, new = _ordered(own.first[:n], own.second[:n])
    runs = np.flatnonzero(new)
    hashes = own.first[order[runs]]
    other = _changes(hashes)
    return _Distinct(order, runs, hashes[other], np.cumsum(other) - 1)


def _candidates(d: _Distinct, marks: dict[int, bytes], groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of the distinct windows that step 1 marked, and where each group's are among them."""
    numbers = _groups_of(d.hashes, groups)
    chosen = np.flatnonzero(_marked(marks, _cuts(numbers), len(d.hashes))[d.of])
    return chosen, _cuts(numbers[d.of[chosen]])


def _reposter(window: int, groups: int):
    """Step 2 of a bucket."""

    def post(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return _posting([])
        own = _bucket(rows, window)
        d = _distinct(own)
        marks = _by_group(replies, "bits")
        chosen, cuts = _candidates(d, marks, groups)
        at, bucket = d.order[d.runs[chosen]], rows["bucket"][0].as_py()
        packed = _packed([own.second[at], own.first[at]], [8, SECOND - 8])
        return _posting([(g, bucket, packed[a:b].tobytes(), marks[g]) for g, a, b in cuts])

    return post


def _counter(step: int):
    """Of one group: for each bucket, which of its windows others have (step 1) or an earlier one has (step 2, with the marks of step 1)."""
    width = (FIRST, SECOND)[step - 1]

    def count(rows: pa.Table) -> pa.Table:
        buckets, data = np.array(rows["bucket"].to_pylist(), np.int64), [np.frombuffer(x, np.uint8).reshape(-1, width) for x in rows["hashes"].to_pylist()]
        grp, marks, by_bucket = rows["grp"][0].as_py(), rows["marks"].to_pylist(), np.argsort(buckets, kind="stable").tolist()
        sizes = np.array([len(data[k]) for k in by_bucket])
        total = int(sizes.sum())
        wide = np.zeros((total, 16), np.uint8)
        np.concatenate([data[k] for k in by_bucket], out=wide[:, :width])
        low, high = (np.ascontiguousarray(wide[:, k : k + 8]).view(np.uint64).ravel() for k in (0, 8))
        order, new = _ordered(low, high)
        hit = np.zeros(total, bool)
        if step == 1:
            hit[order] = ~(new & np.append(new[1:], True))
        else:
            hit[order] = ~new
        out, at = [], 0
        for k, n in zip(by_bucket, sizes.tolist(), strict=True):
            if hit[at : at + n].any():
                out.append((int(buckets[k]), grp, np.packbits(hit[at : at + n]).tobytes(), marks[k]))
            at += n
        return _table(out, ("bucket", "grp", "bits", "marks"), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    return count


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _later(own: Bucket, replies: pa.Table, groups: int) -> np.ndarray:
    """Which windows also start earlier: in an earlier bucket, a row with a smaller key, or the same row."""
    total, row = int(own.sizes.sum()), np.repeat(np.arange(len(own.keys)), own.sizes)
    out = np.zeros(total, bool)
    d = _distinct(own)
    n, runs = len(d.order), np.diff(d.runs, append=len(d.order))
    if n:
        keys = np.unique(np.array(own.keys[: own.known], np.int64), return_inverse=True)[1][row[:n]][d.order]
        out[d.order] = keys > np.repeat(keys[d.runs], runs)
        chosen, cuts = _candidates(d, _by_group(replies, "marks"), groups)
        earlier = np.zeros(len(d.runs), bool)
        earlier[chosen] = _marked(_by_group(replies, "bits"), cuts, len(chosen))
        out[d.order] |= np.repeat(earlier, runs)
        of = row[:n][d.order]
        again = np.concatenate([[False], of[1:] == of[:-1]])
        again[d.runs] = False
        out[d.order[again]] = True
    ends = np.cumsum(own.sizes).tolist()
    for k in range(own.known, len(own.keys)):
        part = slice(ends[k] - int(own.sizes[k]), ends[k])
        order, new = _ordered(own.first[part], own.second[part])
        out[part][order[~new]] = True
    return out


def _bounds(rows: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Smallest keys of the buckets but the first. A sample, larger texts likelier, finds them; they don't alter results."""
    unit = max(1, total // (SAMPLES * buckets))
    size = F.octet_length("text")
    drawn = rows.where(f"key is not null and (cast(crc32(cast(key as string)) as double) / 4294967296) * {unit} < octet_length(text)")
    seen = drawn.select("key", F.greatest(size.cast("long"), F.lit(unit)).alias("size")).toArrow().sort_by("key")
    keys, ends = seen["key"].to_numpy(), np.cumsum(seen["size"].to_numpy())
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.unique(keys[np.searchsorted(ends, ends[-1] * np.arange(1, buckets) / buckets)])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, buckets: int | None = None, groups: int | None = None, keep_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and removed (the maximal intervals in words) of every row; ``kept`` too if asked for.

    A word goes if it lies in a window of ``window`` words whose sequence also starts earlier: in a document with a
    smaller key, or earlier in the same one. Keys are whole numbers. Rows that repeat a key are never earlier than
    each other; rows with a null key only lose their own later repeats and make nobody else lose any. Null and empty
    texts have no words. Texts of any length count whole. An empty table gives an empty result. Rows that repeat one
    key share a bucket, however many; other columns are left aside.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    alike = 8 * math.isqrt(total)  # then a bucket has about ten windows for each group
    buckets, groups = (given or max(1, -(-total // min(max(least, alike), most))) for given, (least, most) in ((buckets, BUCKET_BYTES), (groups, GROUP_BYTES)))
    partitions = min(PARTITIONS, -(-total // PARTITION_BYTES)) or 1
    bucket_parts, group_parts = min(partitions, buckets), min(partitions, groups)
    bounds = _bounds(rows, total, buckets) if buckets > 1 else np.zeros(0, np.int64)

    def deal(batches):
        for batch in batches:
            known = batch["key"].is_valid().to_numpy(zero_copy_only=False)
            keys = batch["key"].fill_null(0).to_numpy()
            place = np.where(known, np.searchsorted(bounds, keys, "right"), np.arange(len(keys)) % buckets)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *batch.columns], ["bucket", "key", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, key long, text string").repartition(bucket_parts, "bucket")

    def posted(step: int, df: DataFrame) -> DataFrame:
        return df.repartition(group_parts, "grp").groupBy("grp").applyInArrow(_counter(step), _REPLY)

    def meet(replies: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("bucket").cogroup(replies.repartition(bucket_parts, "bucket").groupBy("bucket")).applyInArrow(run, schema)

    shared = posted(1, dealt.groupBy("bucket").applyInArrow(_poster(window, groups), _POSTING))
    earlier = posted(2, meet(shared, _reposter(window, groups), _POSTING))

    def apply(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return empty.empty_table()
        own, out, at = _bucket(texts, window), [], 0
        later = _later(own, replies, groups)
        for k, n in enumerate(own.sizes.tolist()):
            starts, ends = own.words[k]
            gone = covered(len(starts), np.flatnonzero(later[at : at + n]), window)
            at += n
            raw = own.texts[k].tobytes()
            kept = b" ".join(raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
            spans = [{"start": a, "end": b} for a, b in intervals(gone)]
            out.append((own.keys[k], len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode()] if keep_text else [])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), empty.types, strict=True)], schema=empty)

    fields = [("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    empty = pa.schema([*fields, *([("kept", pa.string())] if keep_text else [])])
    schema = "key long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>" + ", kept string" * keep_text
    return meet(earlier, apply, schema).withColumnRenamed("key", key)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
