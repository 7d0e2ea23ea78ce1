"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from Spark (one bounded, hash-drawn sample of labelled documents for each language);
the log-probability matrix of ``buckets`` x languages is broadcast, its size bounded by ``max_languages``.
Scoring is a sparse product in numpy over whole Arrow batches: each n-gram of a document looks up its row.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table

#: Longest n-gram of characters; all shorter ones count too.
ORDERS = (1, 2, 3)
#: Hash buckets of n-grams.
BUCKETS = 1 << 15
#: Additive smoothing of the counts.
SMOOTHING = 0.1
#: About so many labelled documents of each language are learned from, drawn by a hash of their id.
SAMPLE_PER_LANGUAGE = 3000
#: The matrix has at most BUCKETS x MAX_LANGUAGES numbers.
MAX_LANGUAGES = 500
#: Buckets whose counts come to the driver in one row.
BLOCK = 4096
#: Characters scored at once.
CHARACTERS = 1 << 20

_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@functools.cache
def _folded() -> np.ndarray:
    """Lower case of each letter by code point; 32 for whatever isn't a letter."""
    fold = np.full(sys.maxunicode + 1, 32, np.uint32)
    for cp in range(sys.maxunicode + 1):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            fold[cp] = ord(low) if len(low) == 1 else cp
    return fold


def _groups(texts: list[str], limit: int = CHARACTERS):
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each text's first place, its number of letters, and for each order the bucket of the n-gram at each place.

    At a text's last places n-grams would reach into the next one: of the order n, ``n`` - 1 of them don't count.
    """
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer("".join([*(t + "  " for t in texts), " "]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _folded()[codes]
    letters = np.add.reduceat((codes != 32).astype(np.int64), starts[:-1]) if len(texts) else np.zeros(0, np.int64)
    buckets = []
    for n in ORDERS:
        h = np.full(len(codes), np.uint32(n))
        for k in range(n):
            part = codes[k:] if k else codes
            h[: len(part)] = (h[: len(part)] ^ part) * _MULTIPLIERS[k % 3]
            h[: len(part)] ^= h[: len(part)] >> np.uint32(15)
        buckets.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(17))
    return starts, letters, buckets


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    #: languages x BUCKETS
    log_probability: np.ndarray


def fit(labelled: DataFrame, text: Column, label: Column, draw: Column, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows with a text and a label.

    ``draw`` is a column of whole numbers below 2**32 that spreads the rows evenly; of each language about
    ``sample`` rows with the lowest draws are read. Rows with a null text or label are left out. No rows give a
    model without languages. More than MAX_LANGUAGES labels raise ValueError.
    """
    rows = labelled.select(label.alias("label"), text.alias("text"), draw.alias("draw")).where("label is not null and text is not null and draw is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    below = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, sample / sizes[k]) * 2**32))])

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _groups(texts):
                starts, _, orders = _grams(texts[i:j])
                for k in range(i, j):
                    total = counts.setdefault(labels[k], np.zeros(BUCKETS, np.int64))
                    for n, b in zip(ORDERS, orders, strict=True):
                        total += np.bincount(b[starts[k - i] : starts[k - i + 1] - n + 1], minlength=BUCKETS)
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["label", "bucket", "n"])

    drawn = rows.where(F.col("draw") < below[F.col("label")]).select("label", "text")
    counted = drawn.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    blocks = counted.groupBy("label", F.expr(f"bucket div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("x")).select("label", "x.bucket", "x.n")
    number = {k: i for i, k in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    for block in blocks.toLocalIterator():
        counts[number[block["label"]], block["bucket"]] += block["n"]
    prior = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _best(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text (-1: none) and its posterior probability."""
    best, sure = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    for i, j in _groups(texts):
        if not model.languages:
            break
        starts, letters, orders = _grams(texts[i:j])
        total = np.tile(model.prior, (j - i, 1))
        for c in range(len(model.languages)):
            of_gram = model.log_probability[c]
            for n, b in zip(ORDERS, orders, strict=True):
                cuts = np.stack([starts[:-1], starts[1:] - n + 1], 1).ravel()
                total[:, c] += np.add.reduceat(of_gram[b], cuts, dtype=np.float64)[::2]
        best[i:j] = np.where(letters > 0, total.argmax(1), -1)
        sure[i:j] = np.where(letters > 0, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
    return best, np.round(sure, 6)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior probability, 0 to 1) in place of the text.

    A null text or one without letters, and any text under a model without languages, gives ``und`` with score 0.
    Whole texts are read, whatever their length; equal scores go to the first language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            best, sure = _best(model, [t or "" for t in batch.column(at).to_pylist()])
            kept = [k for k in range(batch.num_columns) if k != at]
            names = pa.array(["und" if b < 0 else model.languages[b] for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), names, pa.array(sure)], [*(batch.schema.names[k] for k in kept), "lang_pred", "score"])

    others = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text)
    return docs.mapInArrow(score, f"{others}lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior probability of ``least`` or more, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in slices(batches):
            best, sure = _best(shared.value, [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            yield batch.filter(pa.array((best >= 0) & (sure >= least)))

    return docs.mapInArrow(keep, docs.schema)


def fit_documents(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of documents whose crc32 of the id as text isn't 1 modulo 3."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    draw = F.when(fold != 1, F.crc32(F.concat(F.lit("draw:"), F.col("doc_id").cast("string"))))
    return fit(docs.select("doc_id", "text", "lang"), F.col("text"), F.col("lang"), draw, sample)


def identify(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from documents with a text and a lang whose crc32 of the id as text isn't 1 modulo 3; a null id is
    neither learned from nor held out. Repeated rows are separate documents.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), fit_documents(docs, sample))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
