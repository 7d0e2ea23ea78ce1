"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: words in lower case, with numbers, names and units replaced by typed
placeholders, so that a question keeps its template when its figures or people are exchanged. Windows of WINDOW
tokens are hashed; windows of documents that equal a benchmark window align document and item. Along an alignment the
slots must be consistent: within a run of windows one value of the item always became the same value in the document
(two values may become one). Windows over the plain words, without placeholders, are joined in the same way and need no slots: they find
verbatim copies that are dense in figures and names, or whose first word is taken for a name in its new place. An item
leaks into a document if enough of its tokens are covered by either.

The benchmark's windows are broadcast only if they were counted and are at most BROADCAST_WINDOWS; beyond that the
windows are joined by a shuffle.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, chunks, mix64, run_hashes, stash, table, word_bounds, word_hashes

#: Tokens of a window; an item of fewer tokens is one window of its own length.
WINDOW = 8
#: Tokens of a template window that are no placeholders, at least; windows over plain words have no such bound.
LITERALS = 4
#: Items of fewer tokens (plain words, where these are looked for) say too little to be looked for.
LEAST_TOKENS = 4
#: An item leaks if so many of its tokens are covered, or this share of them.
COVERED_TOKENS = 13
COVERED_SHARE = 0.5
#: Benchmark windows that are broadcast at most (8 bytes each, and their items' tokens).
BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = 1, 2, 3
_PLACEHOLDERS = mix64(np.arange(4, dtype=np.uint64) + np.uint64(0x51AB))

_NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
_UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons meter meters metre metres centimeter centimeters kilometer kilometers second seconds minute minutes min hour hours h day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit mph kmh watt watts kw volt volts amp amps joule joules newton newtons hz khz mhz ghz kb mb gb tb"
_NAMES = "alice anna ben bob carl carol charlie chris clara daniel david diana emily emma eric eva frank george grace hannah henry jack james jane janet jason jenny jim joe john julia karen kate kevin laura leo lily linda lisa lucy maria mark martin mary max mia michael mike nina noah olivia oscar paul peter rachel robert ryan sam sara sarah sophia steve susan thomas tim tom victor william zoe"


def _hashes_of(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return np.sort(word_hashes(data, starts, ends))


@functools.cache
def _lists() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _hashes_of(_NUMBER_WORDS), _hashes_of(_UNITS), _hashes_of(_NAMES)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _counts(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, ord("."), ord("?"), ord("!"), ord(":")]] = True
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = True


class Tokens(NamedTuple):
    first: np.ndarray  # each document's first token
    literal: np.ndarray  # hash of the word in lower case
    kind: np.ndarray  # 0 or a placeholder's number
    template: np.ndarray  # hash of the word or of its placeholder
    opening: np.ndarray  # each document's first word
    words: np.ndarray  # hash of each word in lower case, before words are joined to slots
    token: np.ndarray  # the token each word belongs to

    def one(self, k: int) -> "Tokens":
        """The tokens of one document."""
        (a, b), (c, d) = self.first[k : k + 2], self.opening[k : k + 2]
        return Tokens(np.array([0, b - a]), self.literal[a:b], self.kind[a:b], self.template[a:b], np.array([0, d - c]), self.words[c:d], self.token[c:d] - a)


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return Tokens(first, none, np.zeros(0, np.int8), none, first, none, np.zeros(0, np.int64))
    words = literal = word_hashes(LOWER[data], starts, ends)
    numbers, units, names = _lists()
    digits, stops, small = _counts(_DIGIT[data]), _counts(_STOP[data]), _counts(_SMALL[data])
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    previous = np.concatenate([[0], ends[:-1]])
    gap = np.where(opens, 0, starts - previous)
    kind = np.zeros(len(starts), np.int8)
    upper = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    begins = opens | (stops[starts] > stops[np.minimum(previous, starts)])
    kind[upper & ~begins & (small[ends] > small[starts])] = NAME
    kind[_among(literal, names) & upper] = NAME
    kind[_DIGIT[data[starts]] | _among(literal, numbers)] = NUMBER
    before = np.concatenate([[0], kind[:-1]])
    kind[_among(literal, units) & (before == NUMBER) & ~opens & (kind != NUMBER)] = UNIT
    # one slot for a number of several parts (1,000.5) and for a name of several words
    joined = ~opens & (kind == before) & (gap == 1) & ((kind == NAME) | ((kind == NUMBER) & (data[np.maximum(starts - 1, 0)] != 0x20)))
    head = np.flatnonzero(~joined)
    if joined.any():
        merged = literal * np.uint64(3) + np.uint64(1)
        literal = np.where(np.concatenate([joined[1:], [False]]) | joined, merged, literal)
        literal = np.add.reduceat(literal, head)
    else:
        literal = literal[head]
    kind = kind[head]
    return Tokens(np.searchsorted(head, first), literal, kind, np.where(kind == 0, literal, _PLACEHOLDERS[kind]), first, words, np.cumsum(~joined) - 1)


def _windows(tokens: Tokens, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` tokens, 0 where one has too few literals; of -``length`` plain words if negative."""
    if length < 0:
        return run_hashes(tokens.words, -length)
    out = run_hashes(tokens.template, length)
    literals = _counts(tokens.kind == 0)
    out[literals[length:] - literals[: len(out)] < min(LITERALS, length)] = 0
    return out


class Index(NamedTuple):
    """A benchmark: for each window length its sorted distinct hashes, and each item's tokens."""

    hashes: dict[int, np.ndarray]
    where: dict[tuple[int, int], list[tuple[int, int]]]
    items: dict[int, Tokens]


def item_lengths(item: Tokens) -> list[int]:
    """The lengths of an item's windows: over tokens, and negative over plain words."""
    return [min(WINDOW, len(item.kind))] * (len(item.kind) >= LEAST_TOKENS) + [-min(WINDOW, len(item.words))] * (len(item.words) >= LEAST_TOKENS)


def build_index(items: dict[int, Tokens]) -> Index:
    where, hashes = defaultdict(list), defaultdict(set)
    for item, tokens in items.items():
        for length in item_lengths(tokens):
            for place, h in enumerate(_windows(tokens, length).tolist()):
                if h:
                    where[length, h].append((item, place))
                    hashes[length].add(h)
    return Index({k: np.sort(np.array(list(v), np.uint64)) for k, v in hashes.items()}, dict(where), items)


def aligned(own: Tokens, item: Tokens, hits: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which tokens of an item are covered by windows (document place, item place) with consistent slots.

    Windows that overlap or touch on one diagonal are a run; a run in which a value became two is no evidence, except
    for its tokens that ``verbatim`` covers.
    """
    out = np.zeros(len(item.kind), bool)
    diagonals = defaultdict(set)
    for d, p in hits:
        diagonals[d - p].add(p)
    for shift, places in diagonals.items():
        runs: list[list[int]] = []
        for p in sorted(places):
            if runs and p <= runs[-1][1]:
                runs[-1][1] = p + length
            else:
                runs.append([p, p + length])
        for start, end in runs:
            there = {}
            slots = (start + np.flatnonzero(item.kind[start:end])).tolist()
            if all(there.setdefault((int(item.kind[p]), int(item.literal[p])), int(own.literal[p + shift])) == int(own.literal[p + shift]) for p in slots):
                out[start:end] = True
    return out


def verbatim(item: Tokens, places: list[int], length: int) -> np.ndarray:
    """Which tokens of an item lie, with all their words, in windows of ``length`` plain words at ``places``."""
    words = np.zeros(len(item.words), bool)
    for p in places:
        words[p : p + length] = True
    out = np.ones(len(item.kind), bool)
    out[item.token[~words]] = False
    return out


def leaks(own: Tokens, index: Index) -> list[tuple[int, int, int]]:
    """(item, covered tokens, tokens) of every item that leaks into one document."""
    hits = defaultdict(lambda: defaultdict(list))
    for length, known in index.hashes.items():
        windows = _windows(own, length)
        if len(windows) and len(known):
            for d in np.flatnonzero(_among(windows, known)).tolist():
                for item, place in index.where[length, int(windows[d])]:
                    hits[item][length].append((d, place))
    out = []
    for item, by_length in sorted(hits.items()):
        tokens = index.items[item]
        cover = np.zeros(len(tokens.kind), bool)
        for length, places in by_length.items():
            cover |= aligned(own, tokens, places, length) if length > 0 else verbatim(tokens, [p for _, p in places], -length)
        n = int(cover.sum())
        if n >= min(COVERED_TOKENS, len(cover)) or n >= COVERED_SHARE * len(cover):
            out.append((item, n, len(cover)))
    return out


def _result(rows: list, keys: pa.Array) -> pa.RecordBatch:
    item = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("tokens", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([",".join(str(x[0]) for x in r[1]) for r in rows], pa.string()),
            pa.array([bool(r[1]) for r in rows]),
            pa.array([[{"item_id": a, "covered": b, "tokens": c} for a, b, c in r[1]] for r in rows], item),
        ],
        ["key", "n_tokens", "n_items", "item_ids", "contaminated", "leaks"],
    )


_SCHEMA = "n_tokens long, n_items long, item_ids string, contaminated boolean, leaks array<struct<item_id: long, covered: long, tokens: long>>"


def _tokens_of(items: list[tuple[int, str]]) -> dict[int, Tokens]:
    out = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        t = tokenize(data, np.array([0, len(data)]))
        if len(t.words) >= LEAST_TOKENS:
            out[item] = t
    return out


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, n_tokens, n_items, item_ids (comma-joined, ascending), contaminated and leaks of every row of ``docs``.

    Whole texts are read. Null and empty texts, an empty benchmark and items with a null text or id or of fewer than
    LEAST_TOKENS words give no leaks; an item without a template window of LITERALS plain words is found where its
    words are copied. Item ids are whole numbers; a repeated id is one item, its last text in code point order.
    Repeated rows of ``docs`` give equal rows; other columns are left aside.
    """
    kind = docs.schema[key].dataType.simpleString()
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null")
    items = items.groupBy("item").agg(F.max("item_text").alias("item_text"))
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if size // 2 <= most:  # a token takes two characters at least
        index = build_index(_tokens_of([(r[0], r[1]) for r in items.collect()]))
        return _find_broadcast(rows, index, kind).withColumnRenamed("key", key)
    return _find_shuffled(rows, items, kind).withColumnRenamed("key", key)


def _find_broadcast(rows: DataFrame, index: Index, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        sieves = {}
        for length, known in index.hashes.items():
            sieves[length] = np.zeros(1 << 20, bool)
            sieves[length][(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                tokens = tokenize(data, offsets)
                suspects = set()
                for length, sieve in sieves.items():
                    own = _windows(tokens, length)
                    at = np.flatnonzero(sieve[(own >> np.uint64(44)).astype(np.int64)])
                    if len(at):
                        at = at[_among(own[at], index.hashes[length])]
                        suspects |= set((np.searchsorted(tokens.first if length > 0 else tokens.opening, at, "right") - 1).tolist())
                rows = []
                for k in range(j - i):
                    rows.append((int(tokens.first[k + 1] - tokens.first[k]), leaks(tokens.one(k), index) if k in suspects else []))
                yield _result(rows, batch.column(0).slice(i, j - i))

    return rows.mapInArrow(run, f"key {kind}, {_SCHEMA}")


def _find_shuffled(rows: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """The same for a benchmark of any size: windows meet in a shuffle, then each suspect's items are checked."""

    def emit(lengths: list[int] | None):
        def run(batches):
            for batch in batches:
                for i, j, data, offsets in chunks(batch.column(1)):
                    tokens = tokenize(data, offsets)
                    hashes, places, sizes = [], [], []
                    for k in range(j - i):
                        one = tokens.one(k)
                        for length in item_lengths(one) if lengths is None else lengths:
                            own = np.unique(_windows(one, length))
                            own = own[own > 0]
                            hashes.append(own)
                            places += [k] * len(own)
                            sizes += [length] * len(own)
                    if hashes:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(places, pa.int64())), pa.array(sizes, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))], ["key", "len", "hash"])

        return run

    known = stash(items.mapInArrow(emit(None), "key long, len int, hash long").select(F.col("key").alias("item"), "len", "hash"))
    lengths = sorted(r[0] for r in known.select("len").distinct().collect())  # LEAST_TOKENS to WINDOW, and negative
    if not lengths:
        return _find_broadcast(rows, build_index({}), kind)
    windows = rows.mapInArrow(emit(lengths), f"key {kind}, len int, hash long")
    pairs = windows.join(known, ["len", "hash"]).select("key", "item").distinct().join(items, "item")
    suspects = pairs.groupBy("key").agg(F.collect_list(F.struct("item", "item_text")).alias("items")).withColumnRenamed("key", "suspect")
    joined = rows.join(suspects, rows["key"].eqNullSafe(suspects["suspect"]), "left").select("key", "text", "items")

    def check(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                tokens, out = tokenize(data, offsets), []
                for k, own in enumerate(batch.column(2).slice(i, j - i).to_pylist()):
                    found = leaks(tokens.one(k), build_index(_tokens_of([(x["item"], x["item_text"]) for x in own]))) if own else []
                    out.append((int(tokens.first[k + 1] - tokens.first[k]), found))
                yield _result(out, batch.column(0).slice(i, j - i))

    return joined.mapInArrow(check, f"key {kind}, {_SCHEMA}")


def op10_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
