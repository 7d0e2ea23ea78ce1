"""Near duplicates by a signature-coordinate inverted join.

1. A document's set of word shingles gives a signature of COORDINATES minimum hashes. Documents with equal sets are
   one class; only classes go on.
2. Every class is posted under its coordinate-value pairs. Values that only one class has can't collide and are
   dropped at once. With a match threshold of m among k coordinates, two classes can only reach m if they share one of
   their k - m + 1 rarest pairs (prefix merging); a class with that many unshared pairs is skipped altogether.
3. In each posting the members are first held against one leader, the class with the most widely shared pairs.
   Candidates with m equal coordinates are confirmed on the full sets, and their components formed.
4. Only members of one posting that are still in different components are compared again: short postings pair by
   pair; long ones in blocks inside tasks, where just confirmed links leave the task. So no link between components
   is lost, and no group is expanded into all its pairs.

The match threshold is the largest at which a pair exactly at the similarity threshold is missed with a probability
below MISS. Everything that is linked is confirmed exactly on 64-bit hashes of whole shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER, NOT_SPACE, chunks, mix64, run_hashes, stash, table, word_bounds, word_hashes

#: Words of a shingle.
SHINGLE = 5
#: Minimum hashes of a signature.
COORDINATES = 32
#: Largest probability of missing a pair exactly at the threshold.
MISS = 2e-5
#: Postings up to this length are compared pair by pair.
SHORT = 50
#: Members of a block of a long posting.
BLOCK = 256

_random = np.random.default_rng(20240607)
_FACTORS = (_random.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Most equal coordinates that can be asked for, if a pair at the threshold may be missed with probability ``miss``."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def shingle_sets(column: pa.Array):
    """For each run of documents: first, end, and the sorted distinct 64-bit shingle hashes of each."""
    for i, j, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        words = word_hashes(data, starts, ends)
        runs = run_hashes(words, SHINGLE)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                sets.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                sets.append(mix64(run_hashes(words[a:b], b - a) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, j, sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum over the set of COORDINATES permutations of 32 bits."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 8192):
        mixed = short[None, at : at + 8192] * _FACTORS[:, None] + _SHIFTS[:, None]
        mixed ^= mixed >> np.uint32(15)  # linear maps alone order few shingles too regularly
        mixed *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, (mixed ^ mixed >> np.uint32(12)).min(1))
    return low


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (size of the set), cid (128-bit digest of the set; null if empty) and sig of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, sets in shingle_sets(batch.column(1)):
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [signature(s).astype(np.int32) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                    ["key", "n", "cid", "sig"],
                )

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n long, cid binary, sig array<int>")


def class_sets(docs: DataFrame, text: str) -> DataFrame:
    """cid and shingles (array of long) of every row with words."""

    def run(batches):
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(0)):
                own = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.astype(np.int64) for s in own], pa.list_(pa.int64()))], ["cid", "shingles"])

    return docs.select(text).mapInArrow(run, "cid binary, shingles array<long>")


def postings(classes: DataFrame, m: int) -> DataFrame:
    """token, freq, cid, weight: every class under the shared ones of its COORDINATES - m + 1 rarest coordinate-value pairs."""
    tokens = classes.select("cid", F.posexplode("sig").alias("place", "value")).select("cid", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    own = tokens.join(shared, "token").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("t"))
    keep = F.size("t") - (m - 1)  # the rarest COORDINATES - m + 1, less those that nobody shares
    own = own.where(keep > 0).select("cid", F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["freq"]).alias("weight"), F.slice("t", F.lit(1), keep).alias("t"))
    return own.select("cid", "weight", F.explode("t").alias("x")).select("x.token", "x.freq", "cid", "weight")


def _likely(pairs: DataFrame, classes: DataFrame, m: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) with m equal coordinates whose sizes allow the similarity."""
    a = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.distinct().join(a, "a").join(b, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (equal >= m)).select("a", "b", "na", "nb")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(b, "b").join(a, "a").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _blocks(posted: DataFrame, classes: DataFrame, sets: DataFrame, m: int, percent: int) -> DataFrame:
    """Confirmed links between components inside long postings.

    ``posted`` has token, cid, root. In each posting the members outside the most common component are the
    questions; they meet all members block by block.
    """
    sizes = posted.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    sizes = sizes.select("token", F.col("top.root").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top.k")) / BLOCK).cast("int").alias("asked"))
    rows = posted.join(sizes, "token")
    prefix = rows.groupBy("cid").agg(F.array_sort(F.collect_list("token")).alias("prefix"))
    full = rows.join(prefix, "cid").join(classes.select("cid", "n", "sig"), "cid").join(sets, "cid")
    place = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    columns = [F.col(c).alias(c) for c in ("token", "block", "question", "cid", "root", "n", "sig", "prefix", "shingles")]
    members = full.withColumn("block", place).withColumn("question", F.explode(F.sequence(F.lit(0), F.col("asked") - 1))).select(*columns)
    questions = full.where(F.col("root") != F.col("main")).withColumn("question", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("asked")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links = []
        if len(left) and len(right):
            token = left["token"].iat[0]
            sigs, sizes_ = np.stack(right["sig"].to_list()), right["n"].to_numpy()
            roots, ids, sets_, prefixes = right["root"].to_list(), right["cid"].to_list(), right["shingles"].to_list(), [frozenset(p) for p in right["prefix"]]
            codes = {r: k for k, r in enumerate(dict.fromkeys([*roots, *left["root"]]))}
            of = np.array([codes[r] for r in roots])
            for x in left.itertuples():
                own, tokens, joined = codes[x.root], set(x.prefix), set()
                fits = (of != own) & (100 * np.minimum(sizes_, x.n) >= percent * np.maximum(sizes_, x.n)) & ((sigs == np.asarray(x.sig)).sum(1) >= m)
                for y in np.flatnonzero(fits):
                    if of[y] in joined or min(tokens & prefixes[y]) != token:
                        continue
                    common = len(np.intersect1d(x.shingles, sets_[y], assume_unique=True))
                    if 100 * common >= percent * (x.n + sizes_[y] - common):
                        joined.add(of[y])
                        links.append((x.cid, ids[y]))
        return pd.DataFrame(links, columns=["a", "b"])

    keys = ("token", "block", "question")
    return questions.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, "a binary, b binary")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    Documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` / 100 or more are linked; the
    component is named by its smallest key. Null and empty texts, and rows with a null key (whose component_id is
    null), are linked with nothing and kept. Equal rows stay in one component; rows that repeat a key are kept or not
    alike. Whole texts count, in any length; other columns are left aside. An empty table gives an empty result.
    """
    m = match_threshold(percent)
    rows = stash(signatures(docs, key, text))
    known = rows.where("key is not null and cid is not null")
    classes = stash(known.groupBy("cid").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    posted = stash(postings(classes, m))
    leaders = posted.groupBy("token").agg(F.max(F.struct("weight", "cid")).alias("top")).select("token", F.col("top.cid").alias("lead"))
    star = posted.join(leaders, "token").where("cid != lead").select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b"))
    likely = stash(_likely(star, classes, m, percent))
    wanted = posted.select("cid").distinct()
    reps = classes.join(wanted, "cid", "left_semi").select("rep").distinct()
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(reps.hint("shuffle_hash"), "rep", "left_semi")
    sets = stash(class_sets(texts, "text").join(wanted, "cid", "left_semi").dropDuplicates(["cid"]))
    links = stash(_confirmed(likely, sets, percent))
    roots = components(links)

    rooted = stash(posted.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    short = rooted.where(F.col("freq") <= SHORT).select("token", "cid", "root")
    other = short.select("token", F.col("cid").alias("b"), F.col("root").alias("other"))
    rest = short.withColumnRenamed("cid", "a").join(other, "token").where("a < b and root != other").select("a", "b")
    more = _confirmed(_likely(rest, classes, m, percent), sets, percent)
    more = stash(more.union(_blocks(rooted.where(F.col("freq") > SHORT).select("token", "cid", "root"), classes, sets, m, percent)))
    if more.take(1):
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    members = classes.join(roots.withColumnRenamed("node", "cid"), "cid").select("cid", "root", "rep")
    least = members.groupBy("root").agg(F.min("rep").alias("component"))
    named = members.join(least, "root").select("cid", "component").union(classes.join(roots, classes["cid"] == roots["node"], "left_anti").select("cid", F.col("rep").alias("component")))
    out = rows.drop("sig").join(named, "cid", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def op3_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
