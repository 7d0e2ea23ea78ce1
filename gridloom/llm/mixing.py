"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources a document counts towards). A small
transport problem then routes the patterns' words to the sources' quotas: a pattern offers its words once
at cost 0, a second time at cost 1, a third time at cost 2 and so on (convex, so nothing is repeated while
something fresh would do). The flow gives each pattern a number of whole passes and a remainder, and the
remainder is filled with documents in a seeded order. Only the aggregate, bounded by ``max_patterns``,
reaches the driver; everything per document stays in Spark.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, stash, table, word_bounds

#: Seeds the order in which documents fill a remainder.
SEED = "mix"
#: Passes a document may take part in at most.
MAX_PASSES = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Buckets of the seeded order, so that no source's documents are ordered in one task.
BUCKET_DIGITS = 3


def word_counts(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """``docs`` with the number of runs of non-white-space in ``text`` (null: 0) in place of the text."""

    def count(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in chunks(batch.column(at)):
                sizes[i:j] = np.diff(word_bounds(data, offsets, NOT_SPACE)[2])
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sizes)], [*(batch.schema.names[k] for k in kept), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{name}` long"])
    return docs.mapInArrow(count, schema)


def capped_targets(sizes: list[int], weights: list[float], passes: int = MAX_PASSES) -> list[float]:
    """Shares of all words by weight, none above ``passes`` times its source; the excess goes to the others by weight."""
    total, targets = sum(sizes), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    rest = total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * rest > passes * sizes[i] * weight]
        if not full:
            for i in free:
                targets[i] = weights[i] * rest / weight
            break
        for i in full:
            targets[i] = float(passes * sizes[i])
            rest -= passes * sizes[i]
        free = [i for i in free if i not in set(full)]
    return targets


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest maximum flow, by shortest augmenting paths."""
    to, left, cost, leaving = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in arcs:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            leaving[u].append(len(to))
            to.append(v)
            left.append(c)
            cost.append(p)
    potential = [0] * nodes
    while True:
        distance, came = [float("inf")] * nodes, [-1] * nodes
        distance[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for e in leaving[u]:
                if left[e] and (near := d + cost[e] + potential[u] - potential[to[e]]) < distance[to[e]]:
                    distance[to[e]], came[to[e]] = near, e
                    heapq.heappush(heap, (near, to[e]))
        if came[sink] < 0:
            return [left[2 * k + 1] for k in range(len(arcs))]
        for v in range(nodes):
            if distance[v] < float("inf"):
                potential[v] += distance[v]
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = to[came[v] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def route(patterns: dict[tuple, int], quotas: dict, passes: int = MAX_PASSES) -> dict[tuple, int]:
    """Words to take from each pattern (a tuple of sources) so that the sources' quotas are met at least cost.

    Patterns and sources that share nothing are separate problems and are solved one by one.
    """
    group = {s: s for p in patterns for s in p}

    def root(s):
        while group[s] != s:
            group[s] = s = group[group[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            group[root(s)] = root(p[0])
    parts = defaultdict(list)
    for p in patterns:
        parts[root(p[0])].append(p)
    taken = {}
    for part in parts.values():
        sources = list(dict.fromkeys(s for p in part for s in p))
        number = {s: 2 + i for i, s in enumerate(sources)}
        arcs = [(0, number[s], quotas.get(s, 0), 0) for s in sources]
        for i, p in enumerate(part):
            node = 2 + len(sources) + i
            arcs += [(number[s], node, passes * patterns[p], 0) for s in p]
            arcs += [(node, 1, patterns[p], k) for k in range(passes)]
        flow = min_cost_flow(arcs, 2 + len(sources) + len(part), 0, 1)
        taken |= dict.fromkeys(part, 0)
        for (a, b, _, _), f in zip(arcs, flow, strict=True):
            if b == 1:
                taken[part[a - 2 - len(sources)]] += f
    return taken


def mix(sized: DataFrame, key: str, members: Column, size: str = "size", weights: dict | None = None, passes: int = MAX_PASSES, seed: str = SEED, max_patterns: int = 100_000) -> DataFrame:
    """Words the mixture takes of every document.

    ``sized`` has one row per document with its ``key`` and ``size``; ``members`` is an array of the sources it
    counts towards (null entries are a source of their own; an empty or null array takes no part). A source's
    size is the words of all its documents. ``weights`` maps sources to positive weights; by default they take
    5, 2, 1 in code point order, nulls last. The targets share all words by weight and stop at ``passes`` times
    the source. Quotas are whole words; a document at the end of a quota is cut. Rows with a null size count 0
    words. Repeated rows are separate documents. An empty table gives an empty result. More than
    ``max_patterns`` different patterns raise ValueError: the aggregate is planned on the driver.

    Returns key, ``members``, ``size``, ``source_size``, ``target`` (both of the first source of a document) and ``taken``.
    """
    spark = sized.sparkSession
    rows = stash(
        sized.select(
            F.col(key).alias("key"),
            F.array_sort(F.array_distinct(members)).alias("members"),
            F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        ).withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))))
    )
    counted = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(counted) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["members"]): r["size"] for r in counted if r["members"]}
    of_source: dict = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            of_source[s] += words
    sources = sorted(of_source, key=lambda s: (s is None, s or ""))
    chosen = [weights[s] for s in sources] if weights else [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]
    # all words are shared once, though a document of several sources counts towards each of them
    all_words = sum(patterns.values())
    scale = [of_source[s] for s in sources]
    targets = capped_targets(scale, chosen, passes) if sum(scale) == all_words else [t * all_words / max(1, sum(scale)) for t in capped_targets(scale, chosen, passes)]
    quota = {s: int(t) for s, t in zip(sources, targets, strict=True)}
    target = dict(zip(sources, targets, strict=True))
    taken = route(patterns, quota, passes)
    plan = spark.createDataFrame(
        [(list(p), of_source[p[0]], float(target[p[0]]), taken[p] // words if words else 0, taken[p] % words if words else 0) for p, words in patterns.items()],
        "members array<string>, source_size long, target double, whole long, rest long",
    )
    if len(patterns) <= 10_000:
        plan = F.broadcast(plan)
    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    before = (
        rows.groupBy("members", bucket.alias("bucket"))
        .agg(F.sum("size").alias("words"))
        .withColumn("ahead", F.sum("words").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
        .select(F.col("members").alias("m"), F.col("bucket").alias("b"), "ahead")
    )
    inside = Window.partitionBy("members", "bucket").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("bucket", bucket).withColumn("within", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(before, placed["members"].eqNullSafe(before["m"]) & (placed["bucket"] == before["b"]), "left")
    plan = plan.withColumnRenamed("members", "p")
    out = placed.join(plan, placed["members"].eqNullSafe(plan["p"]), "left")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("ahead") - F.col("within")))
    return out.select(
        F.col("key").alias(key),
        "members",
        "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce(F.col("size") * F.col("whole") + extra, F.lit(0)).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, by its single ``source`` (null is a source)."""
    sized = word_counts(docs.select("doc_id", "source", "text"))
    return mix(sized, "doc_id", F.array("source"), **options).select("doc_id", "size", "source_size", "target", "taken")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, (SELECT sum(s) FROM per) - coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 3.0 * s / w DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS ws,
         row_number() OVER o AS k
  FROM per WINDOW o AS (ORDER BY 3.0 * s / w, source NULLS LAST)
), level AS (
  SELECT rest, ws, k FROM ranked WHERE w * rest <= 3 * s * ws ORDER BY k LIMIT 1
), goal AS (
  SELECT source, s, CASE WHEN ranked.k < coalesce(level.k, 1000000000) THEN (3 * s)::DOUBLE
                         ELSE (w * level.rest)::DOUBLE / level.ws::DOUBLE END AS target
  FROM ranked LEFT JOIN level ON true
), placed AS (
  SELECT doc_id, size, s, target, floor(target)::BIGINT AS quota,
         sum(size) OVER (PARTITION BY sized.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, s AS source_size, target,
       (CASE WHEN s = 0 THEN 0 ELSE size * (quota // s) + least(size, greatest(0, quota % s - ahead)) END)::BIGINT AS taken
FROM placed
"""
