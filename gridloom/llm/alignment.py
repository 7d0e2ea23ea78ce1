"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often.

Texts are encoded by a byte-level BPE (A, from space + text) and by a piece BPE (B, which adds the space itself). A
whole batch is one byte sequence: the tokens' lengths, summed up, are its A ends and B ends. Each is counted once over
the batch's bytes; where both occur, the batch is cut into groups. Every distinct end closes a stretch that lies in
one A token and one B token, which is one link. Prefix sums of the marks, taken at the documents' ends, give each
document's share.

1. Each document's figures and its distinct linked id pairs, with their number of links, are written once, so that no
   text is encoded twice.
2. The pairs are counted in tasks and summed up: a pair's count is the number of documents that hold it.
3. Pairs with many documents, TABLE of them at most, are broadcast; every document looks up its own. Where there are
   more pairs, the rarer ones join their documents by a shuffle, and no pair among them is a frequent one.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, frequent_bound, stash, table

#: Where the tokenizers' files are.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most pairs that are broadcast, at 13 bytes each.
TABLE = 1 << 21
#: Pairs counted at once inside a task.
COUNTED = 1 << 22


class Vocabulary(NamedTuple):
    """Bytes of all tokens, one after the other, with the start and length of each."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, joined."""
        sizes = self.lengths[ids]
        return self.data[np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Coders(NamedTuple):
    a: object
    b: object
    a_vocabulary: Vocabulary
    b_vocabulary: Vocabulary


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which a byte-level vocabulary writes bytes: themselves where they are printable, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def coders(a_path: str, b_path: str) -> Coders:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    alphabet, known = byte_alphabet(), a.get_vocab(with_added_tokens=True)
    a_tokens = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        a_tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    b_tokens = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    if len(a_tokens) * len(b_tokens) >= 1 << 32:
        raise ValueError("pairs of token ids must fit in 32 bits")
    return Coders(a, b, _vocabulary(a_tokens), _vocabulary(b_tokens))


class Aligned(NamedTuple):
    """Of a batch of documents; ``pairs`` are a * (size of B) + b, distinct in a document and in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]  # a1,a2|b1;a3|b2,b3
    ends: list[np.ndarray]  # of the groups, in bytes of space + text
    pairs: list[np.ndarray]
    times: list[np.ndarray]


def _shares(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks between each two of the bounds, by the marks' running sums; those at a bound count before it."""
    return np.diff(sums[bounds]).astype(np.int64)


@functools.lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n in decimal, as rows of bytes with zeros before the first digit, and how many digits they have."""
    places = len(str(n - 1))
    rest, out = np.arange(n), np.zeros((n, places + 1), np.uint8)
    lengths = np.ones(n, np.int64)
    for k in range(places - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        out[:, k] = digit + 0x30
    for k in range(places - 1):
        above = np.arange(n) >= 10 ** (places - 1 - k)
        out[~above, k] = 0
        lengths += above
    return out, lengths


def _digits(ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number in decimal with its separator (0: none), as bytes side by side, and their lengths."""
    digits, lengths = _decimals(1 << int(ids.max(initial=0)).bit_length())
    out = digits[ids]
    out[:, -1] = separators
    flat = out.ravel()
    return flat[flat != 0], lengths[ids] + (separators > 0)


def cut(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray, b_size: int) -> Aligned:
    """Aligns the tokens of a batch. ``bounds`` are the documents' offsets in its bytes, which both sides' tokens cover."""
    total = int(bounds[-1])
    in_a, in_b = np.bincount(a_ends, minlength=total + 1), np.bincount(b_ends, minlength=total + 1)
    both, either = in_a & in_b, in_a | in_b
    sums_a, sums_b, sums_both, sums_either = (np.cumsum(marks) for marks in (in_a, in_b, both, either))
    at = np.flatnonzero(either)
    links = a[sums_a[at] - in_a[at]].astype(np.int64) * b_size + b[sums_b[at] - in_b[at]]

    n_links, n_groups = _shares(sums_either, bounds), _shares(sums_both, bounds)
    of = np.repeat(np.arange(len(n_links)), n_links)
    distinct, times = np.unique(of << 32 | links, return_counts=True)
    parts = np.cumsum(np.bincount(distinct >> 32, minlength=len(n_links)))[:-1]

    cuts = np.flatnonzero(both)
    a_until, b_until = sums_a[cuts], sums_b[cuts]
    group_a, group_b = (sums_both[ends] - both[ends] for ends in (a_ends, b_ends))
    size = len(a) + len(b)
    ids, marks = np.zeros(size, np.int64), np.zeros(size, np.uint8)
    place_a = np.arange(len(a)) + np.concatenate([[0], b_until])[group_a]
    place_b = np.arange(len(b)) + a_until[group_b]
    ids[place_a], ids[place_b] = a, b
    marks[place_a] = np.where(both[a_ends] > 0, ord("|"), ord(","))
    marks[place_b] = np.where(both[b_ends] > 0, ord(";"), ord(","))
    last = np.cumsum(_shares(sums_a, bounds) + _shares(sums_b, bounds))
    marks[last[np.diff(bounds) > 0] - 1] = 0
    text, lengths = _digits(ids, marks)
    sums = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], last])]
    raw = text.tobytes()
    return Aligned(
        _shares(sums_a, bounds),
        _shares(sums_b, bounds),
        n_groups,
        n_links,
        [raw[i:j] for i, j in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)],
        np.split(cuts - np.repeat(bounds[:-1], n_groups), np.cumsum(n_groups)[:-1]),
        np.split((distinct & 0xFFFFFFFF).astype(np.uint32), parts),
        np.split(times.astype(np.uint32), parts),
    )


def _whole(flat: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document, whether its tokens' joined bytes are its own."""
    sizes = np.concatenate([[0], np.cumsum(vocabulary.lengths[flat])])[np.concatenate([[0], np.cumsum(counts)])]
    right = np.diff(sizes) == np.diff(bounds)
    found = vocabulary.bytes_of(flat)
    if right.all() and np.array_equal(found, data):
        return right
    for k in np.flatnonzero(right).tolist():
        right[k] = np.array_equal(found[sizes[k] : sizes[k + 1]], data[bounds[k] : bounds[k + 1]])
    return right


def align_texts(texts: list[str | None], data: np.ndarray, offsets: np.ndarray, coder: Coders) -> Aligned:
    """Aligns whole texts; ``data`` and ``offsets`` are their UTF-8. Documents without tokens have empty results."""
    sizes = np.diff(offsets)
    chosen = np.flatnonzero(sizes > 0)
    own = [texts[k] for k in chosen.tolist()]
    a = [e.ids for e in coder.a.encode_batch_fast([" " + t for t in own], add_special_tokens=False)]
    b = coder.b.encode(own, num_threads=1) if own else []
    spaced = np.insert(data, offsets[chosen], 0x20)
    bounds = np.concatenate([[0], np.cumsum(sizes[chosen] + 1)])
    counts_a, counts_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, counts_a), (b, counts_b)))
    right = _whole(flat_a, counts_a, coder.a_vocabulary, spaced, bounds) & _whole(flat_b, counts_b, coder.b_vocabulary, spaced, bounds)
    flat_a, flat_b = flat_a[np.repeat(right, counts_a)], flat_b[np.repeat(right, counts_b)]
    lengths = np.zeros(len(texts), np.int64)
    lengths[chosen[right]] = sizes[chosen[right]] + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return cut(flat_a, flat_b, np.cumsum(coder.a_vocabulary.lengths[flat_a]), np.cumsum(coder.b_vocabulary.lengths[flat_b]), bounds, len(coder.b_vocabulary.lengths))


def aligned(docs: DataFrame, key: str, text: str, folder: str, keep_groups: bool) -> DataFrame:
    """Figures, pairs and their numbers of links of every document; with ``keep_groups`` the groups and their ends too."""
    kind = docs.schema[key].dataType.simpleString()
    a_path, b_path = f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"

    def run(batches):
        coder = coders(a_path, b_path)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                found = align_texts(batch.column(1).slice(i, j - i).to_pylist(), data, offsets, coder)
                columns = [batch.column(0).slice(i, j - i), *(pa.array(n, pa.int64()) for n in found[:4])]
                columns.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string()))
                columns += [pa.array([x.tobytes() for x in side], pa.binary()) for side in (found.pairs, found.times)]
                if keep_groups:
                    columns += [pa.array([g.decode() for g in found.groups], pa.string()), pa.array(found.ends, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups", "ends"] if keep_groups else [])]
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string, ends array<long>" * keep_groups
    return docs.select(key, text).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and each row's first."""
    values = column.to_pylist()
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its A id has more)."""

    def merged(kept: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, of = np.unique(np.concatenate(kept), return_inverse=True)
        return distinct, np.bincount(of, np.concatenate(numbers)).astype(np.int64)

    def rows(pairs: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(numbers)], ["pair", "n"])

    def run(batches):
        kept, numbers, size = [], [], 0
        for batch in batches:
            pairs, _ = _joined(batch.column(0))
            for at in range(0, len(pairs), COUNTED):
                kept.append(pairs[at : at + COUNTED])
                numbers.append(np.ones(len(kept[-1]), np.int64))
                size += len(kept[-1])
                if size >= COUNTED:
                    one, n = merged(kept, numbers)
                    kept, numbers, size = [one], [n], len(one)
                    if size >= COUNTED // 2:
                        yield rows(one, n)
                        kept, numbers, size = [], [], 0
        if size:
            yield rows(*merged(kept, numbers))

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has at most as many pairs as B has ids
    return counts.withColumn("a", F.expr(f"pair div {b_size}")).withColumn("best", F.expr("n = max(n) over (partition by a)")).drop("a")


def _looked_up(found: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """row, n_best and count_sum by the pairs with at least ``least`` documents."""
    held = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    shared = found.sparkSession.sparkContext.broadcast((held["pair"].to_numpy().astype(np.uint32), held["n"].to_numpy(), held["best"].to_numpy()))

    def run(batches):
        keys, numbers, best = shared.value
        for batch in batches:
            pairs, first = _joined(batch.column(1))
            times, _ = _joined(batch.column(2))
            at = np.searchsorted(keys, pairs)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == pairs[hit]
            sums = []
            for values in (best, numbers):
                each = np.zeros(len(pairs), np.int64)
                each[hit] = values[at[hit]] * times[hit].astype(np.int64)
                sums.append(np.diff(np.concatenate([[0], np.cumsum(each)])[first]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.int64()) for s in sums), *batch.columns[3:]], ["row", "n_best", "count_sum", *batch.schema.names[3:]])

    rest = [f for f in found.schema.fields if f.name not in ("row", "pairs", "times")]
    schema = "row long, n_best long, count_sum long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return found.select("row", "pairs", "times", *(f.name for f in rest)).mapInArrow(run, schema)


def _rare(found: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """row, n_best and count_sum by the pairs with fewer than ``least`` documents, of the rows that have any."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs, first = _joined(part.column(1))
                times, _ = _joined(part.column(2))
                rows = np.repeat(part.column(0).to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs.astype(np.int64)), pa.array(times.astype(np.int64))], ["row", "pair", "times"])

    posted = found.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    often = counts.where(F.col("n") >= least).select("pair")
    posted = posted.join(F.broadcast(often), "pair", "left_anti")
    told = posted.join(counts.where(F.col("n") < least), "pair")
    return told.groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, most: int = TABLE, keep_groups: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    With ``keep_groups`` also groups, as ``a1,a2|b1;a3|b2,b3`` in ids, and ends, the groups' ends in bytes of space +
    text. Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have no tokens: zeros
    and an empty digest. Every row is a document of its own, also those with a null or repeated key or a repeated
    text. Pairs with equally many documents are all the best. Whole texts of any length count; other columns are left
    aside. An empty table gives an empty result.
    """
    found = stash(aligned(docs, key, text, folder, keep_groups))
    b_size = len(coders(f"{folder}/{A_FILE}", f"{folder}/{B_FILE}").b_vocabulary.lengths)
    counts = stash(pair_counts(found, b_size))
    least = frequent_bound(counts, "n", most)
    out = _looked_up(found, counts, least)
    if least > 1:
        rare = _rare(found, counts, least)
        out = out.join(rare, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups", "ends"] if keep_groups else [])]
    return out.select(F.col("key").alias(key), *names)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
