from pyspark.sql import functions as F

from gridloom.llm import fixity

SCHEMA = "volume long, offset long, length long, digest string, record long"


def rows(volumes, per=40, size=700):
    return [(v, i * size, size, f"d{v}-{i}", v * 1000 + i) for v in range(volumes) for i in range(per)]


def located(df):
    return {(r.volume, r.offset, r.status) for r in df.collect()}


def test_finds_just_the_damage(spark):
    good = rows(5)
    bad = [list(r) for r in good if r[:2] != (1, 700)]
    for r in bad:
        if r[:2] == [3, 1400] or r[:2] == [4, 27300]:
            r[3] = "broken"
    bad.append([2, 10, 5, "new", 77])
    bad.append([9, 0, 5, "volume", 78])
    a, b = spark.createDataFrame(good, SCHEMA), spark.createDataFrame([tuple(r) for r in bad], SCHEMA)
    want = {(1, 700, "missing"), (3, 1400, "corrupt"), (4, 27300, "corrupt"), (2, 10, "extra"), (9, 0, "extra")}
    for shape in ({}, {"range_bytes": 1000, "fanout": 4}):
        assert located(fixity.audit(a, b, **shape)) == want
    roots = {r.volume: r for r in fixity.roots(a, b, range_bytes=1000, fanout=4).collect()}
    assert roots[0].primary_root == roots[0].replica_root and roots[1].primary_root != roots[1].replica_root and roots[9].primary_root is None


def test_order_of_rows_and_repeats(spark):
    good = rows(2)
    a = spark.createDataFrame(good + good[:1], SCHEMA)
    assert fixity.audit(a, spark.createDataFrame(good[:1] + good[::-1], SCHEMA)).count() == 0
    assert located(fixity.audit(a, spark.createDataFrame(good, SCHEMA))) == {(0, 0, "missing")}


def test_nulls_and_empty(spark):
    odd = [(0, 0, None, None, None), (None, 1, 1, "x", 1), (0, None, 1, "y", 2)]
    a, none = spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert fixity.audit(a, a).count() == 0 and fixity.audit(none, none).count() == 0
    assert located(fixity.audit(a, none)) == {(0, 0, "missing")}


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * i) for i in range(300)] + [(None, None, None), (7, "http://h/7", None)], "page_id long, url string, html string")
    good = fixity.records(pages)
    assert good.count() == 302 and good.agg(F.count_if(F.col("offset").isNull())).first()[0] == 0
    found = fixity.audit(good, fixity.damaged(pages))
    assert {r.status for r in found.collect()} <= {"corrupt", "missing", "extra"} and found.count() > 3


def test_long_records_ties_and_clashing_columns(spark):
    """A page of some megabytes, pages at one place, and columns named like those inside."""
    long = "word " * 600_000
    pages = spark.createDataFrame([(1, "u", long), (1, "u", "same id"), (1, "u", "same id"), (2, "u", ""), (3, None, long + "x")], "page_id long, url string, html string")
    good = fixity.records(pages)
    assert sorted(r.length for r in good.collect()) == [2, 9, 9, 3_000_002, 3_000_002]
    assert fixity.audit(good, good).count() == 0
    changed = fixity.records(pages.withColumn("html", F.when(F.col("page_id") == 3, F.lit(long + "y")).otherwise(F.col("html"))))
    assert [(r.record, r.status) for r in fixity.audit(good, changed).collect()] == [(3, "corrupt")]
    one = spark.createDataFrame([(0, 0, 5, "a", 1), (0, 0, 5, "a", 2), (0, 0, 5, "b", 3)], SCHEMA)  # ties: three records at one offset
    less = spark.createDataFrame([(0, 0, 5, "a", 9), (0, 0, 5, "b", 3)], SCHEMA)
    assert [(r.offset, r.status, r.primary_digest) for r in fixity.audit(one, less).collect()] == [(0, "missing", "a")]
    clash = [x.withColumns({"node": F.lit("n"), "level": F.lit(9), "side": F.lit(True), "balance": F.lit(None).cast("int"), "parent": F.lit(1.5)}) for x in (good, changed)]
    assert [(r.record, r.status) for r in fixity.audit(*clash).collect()] == [(3, "corrupt")]
