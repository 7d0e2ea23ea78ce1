import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalogue, growths

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(got.select(*columns).collect()) == normal(want.fetchall())


def test_growth_equals_sql(spark, duck):
    want = duck.execute(growths.COSTGROW_SQL)
    got = growths.costgrow(spark, SF).select(*(d[0] for d in want.description)).collect()
    assert normal(got) == normal(want.fetchall()) and len(got) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.QUERIES) >= 60


@pytest.mark.parametrize("name", ["feather_blend", "error_metrics", "superres_flagship"])
def test_any_number_of_partitions(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(normal(catalogue.QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
