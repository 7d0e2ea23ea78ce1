from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing


def test_capped_targets():
    assert mixing.capped_targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    got = mixing.capped_targets([10, 1000, 500], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(1510) and got[1] == pytest.approx(2 * got[2])
    assert mixing.capped_targets([], []) == [] and mixing.capped_targets([0, 0], [5, 2]) == [0, 0]


def test_flow_is_cheapest():
    patterns = {("a",): 10, ("a", "b"): 10, ("b",): 5}
    for qa, qb in product(range(0, 50, 7), repeat=2):
        taken = mixing.route(patterns, {"a": qa, "b": qb})
        cost = lambda x: sum(sum(max(0, x[p] - k * n) for k in (1, 2)) for p, n in patterns.items())
        best = None
        for a, ab in product(range(31), repeat=2):
            for b in range(16):
                if max(0, a) <= qa and b <= qb and a + ab + b <= qa + qb and ab <= (qa - a) + (qb - b):
                    x = {("a",): a, ("a", "b"): ab, ("b",): b}
                    key = (-(a + ab + b), cost(x))
                    best = key if best is None or key < best else best
        assert (-sum(taken.values()), cost(taken)) == best


def test_rows_match_the_oracle(spark, documents, tmp_path):
    texts = [(i, "w " * (i * 37 % 91 + 1)) for i in range(400)] + [(1, None), (2, ""), (2, ""), (None, "a b c")]
    docs = documents(texts, sources={i: None if i % 11 == 0 else f"s{min(i % 29, 6)}" for i in range(400)})
    docs.select("doc_id", "source", "text").write.parquet(f"{tmp_path}/d")
    got = mixing.mix_documents(docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    total = got.join(docs.select("doc_id", "source").distinct(), "doc_id").where("size > 0").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal")).collect()
    assert all(abs(r.t - r.goal) < 12 for r in total if r.goal > 100)
    assert all(r.taken <= 3 * r.size for r in got.collect())


def test_overlapping_sources_and_edges(spark):
    rows = [(1, ["a"], 10), (2, ["b", "a"], 10), (3, ["a", "b"], 5), (4, None, 7), (5, [], 3), (6, ["b"], None)]
    df = spark.createDataFrame(rows, "id long, s array<string>, n long")
    out = {r.id: r for r in mixing.mix(df, "id", F.col("s"), "n").collect()}
    assert out[4].taken == out[5].taken == out[6].taken == 0 and sum(out[i].taken for i in (1, 2, 3)) > 20
    assert mixing.mix(df.limit(0), "id", F.col("s"), "n").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, "id", F.col("s"), "n", max_patterns=2)


def test_long_texts_and_clashing_columns(spark, documents):
    """A text of a million words, and columns named like those inside and those that come out."""
    docs = documents([(1, "w " * 1_000_000), (2, "a b c"), (3, None)], sources={1: "x", 2: "y"})
    clash = docs.withColumns({k: F.lit("z") for k in ("size", "taken", "target", "source_size", "pattern", "id", "n", "s", "rank")})
    got = {r.doc_id: r for r in mixing.mix_documents(clash).collect()}
    assert got[1].size == 1_000_000 and got[1].source_size == 1_000_000 and got[3].size == 0 and got[3].taken == 0
    assert got == {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert all(r.taken <= 3 * r.size for r in got.values()) and abs(got[2].taken - got[2].target) < 3
    assert mixing.mix_documents(clash.limit(0)).count() == 0
