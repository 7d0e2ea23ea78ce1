"""Gridded relations over the driver's tables, and the same in DuckDB's SQL.

``lr``: a coarse grid of depths, 100 columns wide, from ``events``; errors are nodata. ``hr``: the same, twice as fine.
``dem``: elevations of the fine grid from ``orders``. ``pairs``: references and estimates from ``lineitem``.
Computed doubles are snapped to 1e-4 with an off-grid offset, so that two engines' last bits don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import upsample_nearest

NODATA = -9999.0
WIDTH = 100
MAX_DEPTH = 5.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snap(x: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e4 + 0.4871) / 1e4


def lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "error", F.lit(NODATA)).otherwise(F.col("value") / 50)
    return e.select(F.expr(f"event_id div {WIDTH}").alias("r"), (F.col("event_id") % WIDTH).alias("c"), (F.col("value") / 50).alias("raw"), v.alias("v"))


def hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsample_nearest(lr(spark, sf_dir), 2)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, z of the fine grid."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("z"))
    n = orders.agg(F.count("*").alias("n"))
    cells = hr(spark, sf_dir).select("r", "c").crossJoin(F.broadcast(n))  # one row
    keyed = cells.select("r", "c", ((F.col("r") * 2 * WIDTH + F.col("c")) % F.col("n")).alias("o_orderkey"))
    return keyed.join(orders, "o_orderkey").select("r", "c", "z")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ref = F.col("l_quantity") / 10
    return li.select(F.col("l_suppkey").alias("tile"), F.col("l_linestatus").alias("status"), ref.alias("ref"), (ref * (1 - F.col("l_discount"))).alias("est"), (ref * (1 - F.col("l_tax"))).alias("alt"))


LR = "lr AS (SELECT event_id // 100 AS r, event_id % 100 AS c, value / 50 AS raw, CASE WHEN event_type = 'error' THEN -9999.0::DOUBLE ELSE value / 50 END AS v FROM events)"
HR = LR + ", hr AS (SELECT 2 * r + a AS r, 2 * c + b AS c, raw, v FROM lr, range(2) x(a), range(2) y(b))"
DEM = HR + ", dem AS (SELECT h.r, h.c, o_totalprice / 1000 AS z FROM hr h JOIN orders ON o_orderkey = (h.r * 200 + h.c) % (SELECT count(*) FROM orders))"
PAIRS = "pairs AS (SELECT l_suppkey AS tile, l_linestatus AS status, l_quantity / 10 AS ref, l_quantity / 10 * (1 - l_discount) AS est, l_quantity / 10 * (1 - l_tax) AS alt FROM lineitem)"


def S(x: str) -> str:
    """``snap`` in SQL."""
    return f"floor(({x}) * 1e4 + 0.4871) / 1e4"


ZERO = "CASE WHEN abs(v + 9999) <= 1e-8 + 1e-5 * 9999 THEN 0 ELSE v END"
UNIT = "least(greatest(ln(1 + least(greatest(d, 0), 5)) / ln(6), 0), 1)"
