"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie. A tree is built over ordered offset ranges: the records of one range of
RANGE_BYTES give a node, FANOUT neighbouring nodes give a node above, up to one root for each volume. Two replicas are
compared from their roots down, and only the children of mismatching nodes are looked at on the next level; the
records of the mismatching ranges are compared last. No group is larger than a range or FANOUT nodes, whatever the
size of a volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Bytes of an offset range that makes a node of the lowest level.
RANGE_BYTES = 1 << 16
#: Children of a node.
FANOUT = 16
#: Records of a volume in the query over ``pages``.
VOLUME_RECORDS = 1024


def _hashed(group, ordered: str, *values: str):
    """Digest over a group's rows in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ordered), *(F.col(v) for v in values))))
    text = F.transform(items, lambda x: F.concat_ws(":", x[ordered].cast("string"), *(x[v].cast("string") for v in values)))
    return group.agg(F.sha2(F.concat_ws(",", text), 256).alias("hash"))


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """(level, volume, side, node, hash) over records (volume, side, offset, length, digest), and the number of the top level."""
    node = F.expr(f"offset div {range_bytes}")
    level = stash(_hashed(records.groupBy("volume", "side", node.alias("node")), "offset", "length", "digest"))
    most = level.agg(F.max("node")).first()[0] or 0
    levels, top = [level.withColumn("level", F.lit(0))], 0
    while most > 0:
        top, most = top + 1, most // fanout
        above = level.withColumn("child", F.col("node")).groupBy("volume", "side", F.expr(f"node div {fanout}").alias("node"))
        level = stash(_hashed(above, "child", "hash"))
        levels.append(level.withColumn("level", F.lit(top)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, top


def _differing(nodes: DataFrame) -> DataFrame:
    grouped = nodes.groupBy("volume", "node").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    return grouped.where("n < 2 or low != high").select("volume", "node")


def roots(primary: DataFrame, replica: DataFrame, **shape) -> DataFrame:
    """volume, primary_root and replica_root; null where a side lacks the volume."""
    nodes, top = tree(_both(primary, replica), **shape)
    return nodes.where(F.col("level") == top).groupBy("volume").agg(F.max(F.when(F.col("side") == 0, F.col("hash"))).alias("primary_root"), F.max(F.when(F.col("side") == 1, F.col("hash"))).alias("replica_root"))


def _both(primary: DataFrame, replica: DataFrame) -> DataFrame:
    columns = ["volume", "offset", "length", "digest", "record"]
    sides = [d.select(*columns).withColumn("side", F.lit(s)) for s, d in ((0, primary), (1, replica))]
    return stash(sides[0].unionByName(sides[1]).where("volume is not null and offset is not null"))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Damaged records: volume, offset, record, status, primary_digest, replica_digest.

    Both tables have volume, offset, length (long), digest (string) and record (the record's id). A record is
    ``corrupt`` if the replica has others at its offset, ``missing`` if it has none there, ``extra`` if only the replica has
    one. Equal rows are compared by how often they occur. A null digest or length counts as an empty one; rows
    without a volume or offset are left out. Empty tables give no rows, or every record of the other side.
    """
    records = _both(primary, replica)
    nodes, top = tree(records.withColumns({"length": F.coalesce("length", F.lit(0)), "digest": F.coalesce("digest", F.lit(""))}), range_bytes, fanout)
    nodes = nodes.withColumn("parent", F.expr(f"node div {fanout}"))
    frontier = stash(_differing(nodes.where(F.col("level") == top)))
    for level in range(top - 1, -1, -1):
        parents = frontier.withColumnRenamed("node", "parent")
        frontier = stash(_differing(nodes.where(F.col("level") == level).join(parents, ["volume", "parent"], "left_semi")))
    suspects = records.withColumn("node", F.expr(f"offset div {range_bytes}")).join(frontier, ["volume", "node"], "left_semi")
    counted = suspects.groupBy("volume", "offset", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("digest", F.lit("")).alias("digest")).agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("balance"), F.min("record").alias("record")
    )
    odd = counted.where("balance != 0")
    here = odd.where("balance > 0").select("volume", "offset", F.col("digest").alias("primary_digest"), F.col("record").alias("own"))
    there = odd.where("balance < 0").select("volume", "offset", F.col("digest").alias("replica_digest"), F.col("record").alias("other"))
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra").otherwise("corrupt")
    return here.join(there, ["volume", "offset"], "full").select("volume", "offset", F.coalesce("own", "other").alias("record"), status.alias("status"), "primary_digest", "replica_digest")


def records(pages: DataFrame) -> DataFrame:
    """Pages as records of WARC volumes: VOLUME_RECORDS ids to a volume, laid out in order of id.

    The digest is SHA-256 of the URL, a line end and the HTML; the length that of the same bytes. Nulls are empty; pages
    without an id are spread over volumes below 0 by their digest.
    """
    payload = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    hashed = pages.select(F.col("page_id").alias("record"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("length"))
    spread = -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20))
    volume = F.when(F.col("record").isNull(), spread).otherwise(F.floor(F.col("record") / VOLUME_RECORDS)).cast("long")
    order = Window.partitionBy("volume").orderBy("record", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.withColumn("volume", volume).withColumn("offset", F.sum("length").over(order) - F.col("length")).select("volume", "offset", "length", "digest", "record")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults, for want of a second table: about one record in 20, drawn by MD5 of its id.

    One in 40 has another first letter, one in 80 is absent, and one in 80 is followed by a record that the primary lacks.
    """
    draw = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 80
    whole = records(pages)
    fault = F.conv(F.substring(F.md5(F.col("record").cast("string")), 1, 4), 16, 10).cast("int") % 80
    broken = pages.where(draw < 2).select(F.col("page_id").alias("id"), F.sha2(F.concat(F.lit("X"), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))), 256).alias("other"))
    kept = whole.where(fault.isNull() | (fault != 2)).join(broken, F.col("record") == F.col("id"), "left")
    kept = kept.select("volume", "offset", "length", F.coalesce("other", "digest").alias("digest"), "record")
    extra = whole.where(fault == 3).select("volume", (F.col("offset") + 1).alias("offset"), F.lit(1).cast("long").alias("length"), F.sha2(F.col("record").cast("string"), 256).alias("digest"), "record")
    return kept.unionByName(extra)


def op2_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(records(pages), damaged(pages))


ORACLE = r"""
WITH laid AS (
  SELECT page_id, page_id // 1024 AS volume, ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 80 AS fault,
         coalesce(url, '') || chr(10) || coalesce(html, '') AS body
  FROM pages
), placed AS (
  SELECT *, sha256(body) AS digest,
         (sum(strlen(body)) OVER (PARTITION BY volume ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(body))::BIGINT AS pos
  FROM laid
)
SELECT volume, pos AS "offset", page_id AS record, CASE WHEN fault < 2 THEN 'corrupt' ELSE 'missing' END AS status,
       digest AS primary_digest, CASE WHEN fault < 2 THEN sha256('X' || body) END AS replica_digest
FROM placed WHERE fault < 3
UNION ALL
SELECT volume, pos + 1, page_id, 'extra', NULL, sha256(page_id::VARCHAR) FROM placed WHERE fault = 3
"""
