"""Queries of manifests, configurations, digests, paths and sets, over stand-ins among the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import registry, stac
from .relations import query, table


@query("SELECT doc_id, sha256(coalesce(text, '')) AS got, CASE WHEN doc_id % 7 = 0 THEN false ELSE true END AS ok FROM documents")
def sha256_verify(spark, sf_dir):
    content = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), content.alias("content"))
    expected = docs.select("name", F.when(F.col("name").cast("long") % 7 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.concat(F.lit(" "), F.upper(F.sha2("content", 256)))).alias("sha256"))
    return registry.verified(docs, expected).select(F.col("name").cast("long").alias("doc_id"), "got", "ok")


@query("SELECT page_id, substr(sha256('EPSG:3979|' || printf('%.8f,%.8f,%.8f,%.8f', page_id / 7.0, page_id / 11.0, page_id / 7.0 + 1, page_id / 11.0 + 1) || '|' || url || '|hrdem|dtm'), 1, 24) AS key FROM pages")
def fetch_cache_key(spark, sf_dir):
    x, y = F.col("page_id") / 7.0, F.col("page_id") / 11.0
    key = stac.mosaic_key(F.lit("EPSG:3979"), [x, y, x + 1, y + 1], F.col("url"), F.lit("hrdem"), F.lit("dtm"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"))


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def json_extract(spark, sf_dir):
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.countDistinct(k).alias("kinds"))


@query(
    "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') THEN 'http' ELSE 'file' END AS backend FROM pages"
)
def url_scheme_dispatch(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", registry.scheme(url).alias("scheme"), registry.host(url).alias("host"), registry.backend_column(url).alias("backend"))


@query(
    "SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}_]', '_', 'g') AS module, p_brand || '_sr' || CASE WHEN p_size % 2 = 0 THEN '.tif' ELSE '.asc' END AS output, lower(trim(p_type)) AS source_id, "
    "CASE WHEN regexp_matches('x_' || lpad((p_size % 20 + 10)::VARCHAR, 3, '0') || '_dem', '(?:^|[_/])([0-9]{2,})_?dem') THEN regexp_extract('x_' || lpad((p_size % 20 + 10)::VARCHAR, 3, '0') || '_dem', '(?:^|[_/])([0-9]{2,})_?dem', 1)::DOUBLE ELSE 2 END AS res FROM part"
)
def string_paths(spark, sf_dir):
    size = F.col("p_size")
    name = F.concat(F.col("p_brand"), F.when(size % 2 == 0, F.lit("")).otherwise(F.lit(".asc")))
    dem = F.concat(F.lit("x_"), F.lpad((size % 20 + 10).cast("string"), 3, "0"), F.lit("_dem"))
    columns = {"module": registry.module_name(F.col("p_name")), "output": registry.output_name(name), "source_id": registry.source_id(F.col("p_type")), "res": registry.dem_resolutions(dem)}
    return table(spark, sf_dir, "part").select("p_partkey", *(v.alias(k) for k, v in columns.items()))


@query(
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, c_acctbal, 5.0) AS max_depth, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey"
)
def config_coalesce(spark, sf_dir):
    given = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    sidecar = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    joined = table(spark, sf_dir, "orders").join(sidecar, "o_custkey", "left")
    return joined.select("o_orderkey", F.coalesce(given, "c_acctbal", F.lit(5.0)).alias("max_depth"), F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def params_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


def _models(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("version"), F.concat(F.lower("n_name"), F.lit(".onnx")).alias("file_name"), F.concat(F.lit("https://models/"), F.col("n_regionkey").cast("string")).alias("url"))


@query("SELECT n_name || chr(9) || lower(n_name) || '.onnx' || chr(9) || 'https://models/' || n_regionkey AS line FROM nation ORDER BY n_name")
def manifest_list(spark, sf_dir):
    return registry.listed(_models(spark, sf_dir))


@query("SELECT n_nationkey AS ord, n_name AS version FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def runnable_models(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("ord"))
    workers = _models(spark, sf_dir).join(rich, "ord", "left_semi").select(registry.module_name(F.col("version")).alias("module"))
    return registry.runnable(_models(spark, sf_dir), workers).select("ord", "version")


@query("SELECT n_regionkey, arg_min(n_name, n_nationkey) FILTER (WHERE n_nationkey % 2 = 1) AS first_valid, arg_min(n_name, n_nationkey) AS first_any FROM nation GROUP BY n_regionkey")
def first_valid(spark, sf_dir):
    valid = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min_by("n_name", valid).alias("first_valid"), F.min_by("n_name", "n_nationkey").alias("first_any"))


@query(
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') "
    "SELECT 'missing' AS op, count(*) AS n, min(k) AS first FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', count(*), min(k) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) "
    "UNION ALL SELECT 'either', count(*), min(k) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'differ', count(*), min(k) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))"
)
def set_ops(spark, sf_dir):
    """Differences, intersections, unions and symmetric differences of key sets, in one aggregation."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = F.array(F.when(a & ~b, "missing"), F.when(a & b, "both"), F.when(a | b, "either"), F.when(a != b, "differ"))
    return orders.select("k", F.explode(F.array_compact(ops)).alias("op")).groupBy("op").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("SELECT label, sum((1 + abs(vec_id) % 4) * (2 + vec_id % 3) * 64)::BIGINT AS parameters, count(*) AS n FROM embeddings GROUP BY label")
def array_product(spark, sf_dir):
    """Numbers of parameters: the product of each tensor's dimensions, summed."""
    k = F.col("vec_id")
    dims = F.array(1 + F.abs(k) % 4, 2 + k % 3, F.size("embedding").cast("long"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sum(scalar.product(dims)).alias("parameters"), F.count("*").alias("n"))
