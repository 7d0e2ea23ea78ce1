"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

1. Words are counted by language. Frequent ones get codes, a number for each pair of language and word: of the commonest
   ones (DICTIONARY at most) their place in a broadcast dictionary, of others, where there are more, their hash. Words
   whose hashes collide are in the dictionary as well, so that no two words share a code.
2. Every occurrence of a frequent word points at what follows it in its piece, up to the phrase's greatest length or
   the first infrequent word. Equal pointers of a task are one, with their number.
3. The pointers are range-partitioned and sorted, so that each prefix's projection lies together. A task takes its
   prefixes one after the other and extends them to the right, depth first: a prefix's pointers fall into runs by their
   next word, and every frequent run is a longer prefix. A prefix with very many pointers spans ranges; phrases that
   touch a range's border are never cut off for being rare there, and their parts are added up.
4. Only the frequent phrases are joined with the frequencies of their parts and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, OTHER_BASE, chunks, frequent_bound, mix64, stash, table, unstash, word_bounds, word_hashes

#: Least occurrences of a phrase, its greatest length in words, and the phrases reported of each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
INSIDE = 80
#: Most words in the broadcast dictionary, at 16 bytes each.
DICTIONARY = 1 << 20
#: Pointers combined at once, and pointers of a range that a task grows at once.
POINTERS = 1 << 20
#: Pointers of a range partition, about, and most partitions; a task grows them POINTERS at a time, however many they are.
PARTITION_POINTERS, PARTITIONS = 1 << 19, 10_000
#: Bytes from which a word's hashes aren't polynomial, as patterns of such words may collide.
LONG_WORD = 64
#: Language of documents without one.
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
#: Codes that are hashes have this bit.
_HASHED = np.int64(1 << 62)


class Words(NamedTuple):
    """Words of a run of documents: bytes, bounds, both hashes (the language is part of them), row, and whether the next word follows in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rows: np.ndarray
    follows: np.ndarray


def split_words(texts: pa.Array, langs: list[str]) -> Iterator[Words]:
    seeds: dict[str, tuple[int, int]] = {}
    for i, j, data, offsets in chunks(texts):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, offsets, _WORD)
        rows = np.repeat(np.arange(i, j), np.diff(at))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (breaks[1:] == breaks[:-1]) & (rows[1:] == rows[:-1])
        hashes = word_hashes(data, starts, ends), word_hashes(data, starts, ends, OTHER_BASE)
        for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
            both = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]].tobytes())
            hashes[0][k], hashes[1][k] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        for lang in langs[i:j]:
            if lang not in seeds:
                both = xxhash.xxh3_128_intdigest(lang.encode())
                seeds[lang] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        by_row = np.array([seeds[lang] for lang in langs[i:j]], np.uint64)
        of = rows - i
        yield Words(data, starts, ends, mix64(hashes[0] ^ by_row[of, 0]), mix64(hashes[1] ^ by_row[of, 1]), rows, follows)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, the first one first, and where runs of equal rows start in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h1, h2 and n of every word of ``docs`` (text, lang)."""

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for w in split_words(batch.column(0), langs):
                order, at = runs(w.first, w.second)
                one, n, raw = order[at], np.diff(at, append=len(order)), w.data.tobytes()
                names = [raw[a:b].decode() for a, b in zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True)]
                own = [langs[k] for k in w.rows[one].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(names, pa.string()), pa.array(w.first[one].view(np.int64)), pa.array(w.second[one].view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "h1", "h2", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "lang string, word string, h1 long, h2 long, n long")
    return found.groupBy("lang", "word", "h1", "h2").agg(F.sum("n").alias("n"))


class Dictionary(NamedTuple):
    """Both hashes of the words it holds, in order of both, and whether it holds all frequent ones."""

    first: np.ndarray
    second: np.ndarray
    whole: bool

    def codes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of each word its code; -1 if it's infrequent."""
        if self.whole:
            out = np.full(len(first), -1, np.int64)
        else:
            out = (first >> np.uint64(2)).astype(np.int64) | _HASHED
        at = np.searchsorted(self.first, first)
        left = np.flatnonzero(at < len(self.first))
        while len(left):  # once, unless first hashes repeat
            left = left[self.first[at[left]] == first[left]]
            hit = self.second[at[left]] == second[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < len(self.first)]
        return out


def dictionary(words: DataFrame, least: int, most: int) -> Dictionary:
    bound = max(least, frequent_bound(words.where(F.col("n") >= least), "n", most))
    held = words.where(F.col("n") >= bound).select("h1", "h2")
    if bound > least:
        others = words.where(F.col("n") < bound).withColumn("code", F.shiftrightunsigned("h1", 2))
        clashes = others.groupBy("code").agg(F.count("*").alias("sharing")).where("sharing > 1")
        held = held.union(others.join(clashes, "code").select("h1", "h2"))
    rows = held.toArrow()
    first, second = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    order = np.lexsort((second, first))
    return Dictionary(first[order], second[order], bound == least)


def _names(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def _batch(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in words), pa.array(n, pa.int64())], [*_names(len(words)), "n"])


def _schema(longest: int) -> str:
    return ", ".join(f"{c} long" for c in [*_names(longest), "n"])


def pointers(docs: DataFrame, shared, longest: int) -> DataFrame:
    """w1, w2 ... (codes, -1 past the end) and n: what follows the occurrences of frequent words."""

    def combined(parts: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(parts, axis=1)
        order, at = runs(*words)
        return _batch(words[:, order[at]], np.diff(at, append=len(order)))

    def run(batches):
        held = shared.value
        parts, size = [], 0
        for batch in batches:
            for w in split_words(batch.column(0), batch.column(1).to_pylist()):
                codes = held.codes(w.first, w.second)
                joined = w.follows.copy()
                joined[:-1] &= (codes[:-1] >= 0) & (codes[1:] >= 0)
                at = np.flatnonzero(joined)
                words = np.full((longest, len(at)), -1, np.int64)
                words[0], go = codes[at], np.ones(len(at), bool)
                for k in range(1, longest):
                    go[go] = joined[at[go] + k - 1]
                    words[k, go] = codes[at[go] + k]
                parts.append(words)
                size += len(at)
                if size >= POINTERS:
                    yield combined(parts)
                    parts, size = [], 0
        if size:
            yield combined(parts)

    return docs.select("text", "lang").mapInArrow(run, _schema(longest))


def grow(words: np.ndarray, n: np.ndarray, least: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Phrases of two words and more, with their occurrences, in a sorted range of pointers (one column each).

    A phrase that begins with the range's first or ends with its last pointer may go on beside the range: it is told
    however rare.
    """
    longest, size = words.shape
    sums = np.concatenate([[0], np.cumsum(n)])
    phrases, numbers = [], []

    def extend(prefix: tuple[int, ...], low: int, high: int) -> None:
        depth = len(prefix)
        following = words[depth, low:high]
        edges = np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1, [high - low]]) + low
        support = np.diff(sums[edges])
        keep = support >= least
        keep[0] |= low == 0
        keep[-1] |= high == size
        for k in np.flatnonzero(keep).tolist():
            a, b = int(edges[k]), int(edges[k + 1])
            word = int(words[depth, a])
            if word < 0:
                continue
            if depth:
                phrases.append((*prefix, word))
                numbers.append(int(support[k]))
            if depth + 1 < longest:
                extend((*prefix, word), a, b)

    if size:
        extend((), 0, size)
    return phrases, numbers


def frequent_phrases(pointed: DataFrame, least: int, longest: int) -> DataFrame:
    """p (codes) and f of the phrases of two words and more with at least ``least`` occurrences."""
    names = _names(longest)

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        phrases, numbers = grow(rows[:longest], rows[longest], least)
        return pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.int64())), pa.array(numbers, pa.int64())], ["p", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size >= POINTERS:
                yield told(parts)
                parts, size = [], 0
        if size:
            yield told(parts)

    parts = max(int(pointed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pointed.count() // PARTITION_POINTERS))
    placed = pointed.repartitionByRange(min(PARTITIONS, parts), *names).sortWithinPartitions(*names)
    return placed.mapInArrow(run, "p array<long>, n long").groupBy("p").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def coded(words: DataFrame, shared, least: int) -> DataFrame:
    """code, lang, word and n of the frequent words."""

    def run(batches):
        held = shared.value
        for batch in batches:
            codes = held.codes(*(batch.column(k).to_numpy().view(np.uint64) for k in (2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(0), batch.column(1), batch.column(4)], ["code", "lang", "word", "n"])

    return words.where(F.col("n") >= least).select("lang", "word", "h1", "h2", "n").mapInArrow(run, "code long, lang string, word string, n long")


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """p, a, lang, and score, l and r of the lowest-scoring cut, the first of equal ones."""
    parts = phrases.select("p", "f", F.lit(None).cast("string").alias("lang")).union(known.select(F.array("code"), "n", "lang"))
    cuts = phrases.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("p", F.lit(1), F.col("k"))).withColumn("right", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("p").alias("left"), F.col("f").alias("l"), "lang"), "left").join(parts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("(2000000bd * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.groupBy("p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("lang").alias("lang"))
    return best.select("p", "a", "lang", "cut.score", "cut.l", "cut.r")


def outermost(phrases: DataFrame, found: DataFrame, inside: int) -> DataFrame:
    """``found`` (p, a ...) without phrases that mostly stand within a longer one.

    Phrases one word longer suffice: whatever stands in a still longer one stands in one of them, at least as frequent.
    """
    longer = phrases.where(F.size("p") > 2)
    within = longer.select("f", F.explode(F.array(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1))).alias("p"))
    most = within.groupBy("p").agg(F.max("f").alias("most"))
    return found.join(most, "p", "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")


def spelled(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with its phrases as words joined by spaces."""
    each = found.select("p", F.posexplode("p").alias("place", "code")).join(known.select("code", "word"), "code")
    text = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).select("p", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    return found.join(text, "p").drop("p")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, most: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r are the occurrences of the phrase and of its parts at the cut with the lowest score, n those of all words
    of the language. A null language is ``und``, null and empty texts have no words. Rows that repeat count as often
    as they stand there. Equal scores rank by a, then by the phrase's bytes. Whole texts of any length count; other
    columns are left aside. An empty table, or one without frequent phrases, gives an empty result.
    """
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    words = stash(word_counts(rows))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(words, least, most))
    pointed = stash(pointers(rows, shared, longest))
    phrases = stash(frequent_phrases(pointed, least, longest))
    unstash(pointed)
    known = stash(coded(words, shared, least))
    found = spelled(outermost(phrases, scored(phrases, known), inside), known)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from lists group by lang),
spots as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
grams as (select lang, w[i : i + k - 1] as p from spots, range(1, 5) as ks(k) where i + k - 1 <= len(w)),
f as (select lang, p, count(*) as f from grams group by lang, p having count(*) >= 30),
c as (select lang, p, f as a from f where len(p) > 1),
cuts as (
  select c.lang, c.p, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
  from c, range(1, 4) as ks(k), f x, f y
  where k < len(c.p) and x.lang = c.lang and y.lang = c.lang and x.p = c.p[1 : k] and y.p = c.p[k + 1 : len(c.p)]),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (
  select lang, q, max(a) as most
  from (select lang, p[i : i + k - 1] as q, a from c, range(2, 4) as ks(k), range(1, 4) as js(i) where k < len(p) and i + k - 1 <= len(p))
  group by lang, q),
kept as (select b.* from best b left join longer x on x.lang = b.lang and x.q = b.p where x.most is null or 100 * x.most < 80 * b.a),
ranked as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, score,
         row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
  from kept)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000
"""
