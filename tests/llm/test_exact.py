import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact

PLACES = [f"Same words {'here' * k}\tand\n there" for k in range(4)]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for content, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(content.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def texts(words, n=400):
    rows = [(i, None if i % 37 == 0 else words.choice(["", " ", "\r\n\x0b", *PLACES, f"lone {i}", "a b", "a b", "hot text"])) for i in range(n)]
    words.shuffle(rows)
    return rows


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()), key=repr)


@pytest.mark.parametrize("hot_groups", [1, 3, 1000])
def test_equals_brute_force(documents, words, hot_groups):
    rows = texts(words)
    assert found(exact.link(documents(rows).repartition(7), hot_groups=hot_groups)) == brute(rows)


def test_texts_of_one_digest_are_told_apart(documents, words):
    rows = texts(words)
    weak = exact.link(documents(rows).repartition(5), digest=lambda c: F.encode(F.substring(F.sha2(c, 256), 1, 1), "utf-8"))
    assert [r[:4] for r in found(weak)] == [r[:4] for r in brute(rows)]


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(exact.link(awkward)) == brute(rows)
    assert exact.link(awkward.limit(0)).collect() == []
    kept = [r.doc_id for r in exact.distinct(awkward).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 7]


def test_each_stage_groups_by_content_and_combines_locally(documents):
    df = exact.combine(documents([(1, "a")]).select(F.col("doc_id").alias("id"), F.lit("d").alias("digest"), F.col("text").alias("content")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 2 and "Python" not in plan and "InArrow" not in plan
    assert all("content" in line for line in plan.splitlines() if "HashAggregate(keys" in line or "hashpartitioning" in line)


def test_single_spaces_are_left_as_they_are(spark):
    odd = "a b  c\t\td \n e\x0b\x0cf  g"
    assert spark.createDataFrame([(odd,)], "text string").select(exact.normalised(F.col("text"))).first()[0] == re.sub(r"[\x20\x09-\x0D]+", " ", odd)
