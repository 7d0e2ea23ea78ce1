import random
import re

import test_decontamination
import test_language
import test_neardup

import corpus_pipeline
from gridloom.llm import decontamination, neardup, pii
from gridloom.llm.queries import QUERIES

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark, tmp_path):
    r = random.Random(8)
    word = {"en": "the and with water house over tree", "de": "das und mit wasser haus über baum"}
    make = lambda lang, n: " ".join(r.choice(word[lang].split()) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))
    item = "which answer of these twelve strange options would the careful reader never pick first"
    rows = []
    for i in range(60):
        lang = r.choice(("en", "de"))
        rows.append((i, make(lang, 40), lang, f"s{i % 3}", 0))
    rows += [(100, rows[3][1], "en", "s1", 0), (101, "so " + rows[4][1], "en", "s1", 0), (102, make("en", 30) + ". " + item, "en", "s2", 0), (103, make("de", 30) + " a@b.org", "de", None, 0), (104, None, None, None, None), (105, "12 34 !!", None, "s1", 8), (106, make("en", 20), "en", "s0", 0), (106, None, "en", "s0", None)]
    rows = [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == DOCUMENT, name
        ids.append({x.doc_id for x in now.collect()})
    everything = {x[0] for x in rows}
    assert ids[0] == everything - {104, 105}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {102} and ids[3] == ids[2]
    assert any(x.text.endswith("[EMAIL]") and x.n_chars == len(x.text) for x in now.collect())
    left = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(left) <= ids[3] and all(0 < x.taken <= 3 * x.size for x in left.values())
    assert abs(sum(x.taken for x in left.values()) - sum(x.size for x in corpus_pipeline.mixing.mix_documents(now).collect())) < 10


def test_the_thirteen_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] and decontamination and neardup and pii


def brute_kept(rows, asked):
    """The rows (id, text, lang, source, length) that four stages leave, each stage by its definition."""
    found = test_language.brute([(i, t) for i, t, *_ in rows], {i: x for i, _, x, *_ in rows})
    rows = [x for x, (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= 0.5]
    kept = test_neardup.brute([(i, t) for i, t, *_ in rows], 80)
    rows = [x for x in rows if kept[x[0]][2]]
    rows = [x for x in rows if not any(test_decontamination.brute_leaks(x[1], item) for _, item in asked)]
    redacted = [(i, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", re.sub(r"\b[0-9]+(\.[0-9]+){3}\b", "[IP]", t)), g, s, n) for i, t, g, s, n in rows]
    return [(i, t, g, s, n if t == was[1] else len(t)) for (i, t, g, s, n), was in zip(redacted, rows, strict=True)]


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(21)
    asked = test_decontamination.random_benchmark(r, 12)
    rows = []
    for i in range(160):
        lang = r.choice(list(test_language.BASE))
        words = [r.choice(test_language.BASE[lang].split()) + r.choice(("", "", "er", "ing", "x")) for _ in range(r.randint(1, 60))]
        text = " ".join(words)
        if i > 5 and r.random() < 0.3:
            w = r.choice([x for x in rows if x[1]])[1].split()
            w[r.randrange(len(w))] = "other"
            text = " ".join(w) + r.choice(("", " end"))
        if r.random() < 0.2:
            text += ". " + test_decontamination.changed(r, r.choice(asked)[1])
        if r.random() < 0.2:
            text += r.choice((" write to a.b@mail.example.org now", " from 10.0.200.7 today", " 12 !!"))
        rows.append((i, r.choice((text, text, text, text, text, "12 34", "")), lang, r.choice(("a", "b", "c", None)), len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = brute_kept(rows, asked)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
    assert sorted(map(tuple, now.collect())) == kept and 60 < len(kept) < 120 and sum("[" in x[1] for x in kept) >= 8
    mixed = corpus_pipeline.mixing.mix_documents(spark.createDataFrame(kept, schema)).where("taken > 0")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.select(mixed.columns).collect())) == sorted(map(str, mixed.collect()))


def test_odd_rows(spark, tmp_path, documents, awkward):
    english = "the house and the tree with water over there and so on by the old river "
    rows = documents([(5, english), (5, english), (5, english + "again"), (None, english), (None, english), (8, english * 3000), (9, None)], {5: "en", 8: "en"}, {5: "a", 8: "b"})
    benchmark = spark.createDataFrame([(None, None), (1, ""), (2, "one two")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (rows, awkward, rows.limit(0)):
        before = docs.collect()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == awkward.columns, name
        left = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(left) <= len(before) and (not before or docs.count() <= len(before))
    out = rows
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, out, str(tmp_path))
    assert sorted((x.doc_id or 0) for x in out.collect()) == [0, 0, 5, 8]
