"""Exact deduplication by skew-safe combining, in DataFrame functions alone.

1. Locally: each task that reads documents combines its equal texts, in the partial aggregate before the shuffle.
2. Salted: what the tasks found is merged by digest, salt and text. The salt is the task's number modulo SALTS, so that
   a text which every task has is merged in SALTS places.
3. Globally: the winners of the salts, at most SALTS for each text, are merged by digest and text.

Every stage groups by the whole text; the digest comes first in the keys and names the group afterwards. Where texts
of one digest differ, their documents are matched to the winners by digest and text.

Each document then learns its winner by digest. Groups with over 1 / HOT_GROUPS of all rows, of which there are fewer
than HOT_GROUPS, are broadcast; no other digest has more rows than that, so the others join by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

#: Places in which one text's local groups are merged before the last stage.
SALTS = 32
#: Groups with more than one in so many rows are joined by broadcast.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null is empty. Single spaces, the usual case, aren't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, content, keep_id (smallest id) and group_size of the distinct texts of ``rows`` (id, digest, content)."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _told(ids: DataFrame, winners: DataFrame, hot_groups: int) -> DataFrame:
    """``ids`` (id, digest) with the winners' columns, by digest."""
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    often = F.col("group_size") * hot_groups > F.lit(total)
    hot = F.broadcast(winners.where(often))
    rest = ids.join(F.broadcast(winners.where(often).select("digest")), "digest", "left_anti")
    return ids.join(hot, "digest").unionByName(rest.join(winners.where(~often), "digest"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS, hot_groups: int = HOT_GROUPS) -> DataFrame:
    """key, keep_id, group_size, kept and digest of every row.

    Texts are equal if they are after ``normalised``; null is the empty text, and all empty texts are one group. Of a
    group the smallest key stays (keep_id); group_size counts all of its rows. A row with a null key stays only where
    its group has no other keys, keep_id being null then. Rows that repeat both key and text are kept or not alike;
    ``distinct`` leaves one. Whole texts of any length count; other columns, whatever their names, are left aside. An
    empty table gives an empty result.
    """
    content = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("id"), digest(content).alias("digest"), content.alias("content"))
    ids = stash(rows.select("id", "digest"))
    winners = stash(combine(rows, salts).drop("content"))
    alike = winners.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if alike.take(1):
        alike = stash(alike)
        told = _told(ids.join(alike, "digest", "left_anti"), winners.join(alike, "digest", "left_anti"), hot_groups)
        unsure = rows.join(alike, "digest", "left_semi")
        told = told.unionByName(unsure.join(combine(unsure, salts), ["digest", "content"]).drop("content"))
    else:
        told = _told(ids, winners, hot_groups)
    return told.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, one for each different text: the one with the smallest key. Rows without a key go."""
    kept = link(docs, key, text).where(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_kept_id")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs[key] == kept["_kept_id"], "left_semi").dropDuplicates([key])


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
select doc_id, min(doc_id) over (partition by content) as keep_id, count(*) over (partition by content) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by content) as kept, sha256(content) as text_sha256
from t
"""
