import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import phrases


def brute(rows, least=30, longest=4, top=2000, inside=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            dropped |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= inside * f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in dropped:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus(words, n=600):
    vocabulary = ["the", "of", "New", "york", "É", "é", "as", "well", "x" * 90, "42"]
    fixed = ["as well as the", "new York city", "of the of the of the", "a\tb  c", "as well, as"]
    rows = []
    for _ in range(n):
        parts = [words.choice(fixed) if words.random() < 0.4 else words.choice(vocabulary) + words.choice(["", "", str(words.randrange(40))]) for _ in range(words.randrange(30))]
        rows.append((words.choice(["en", "en", "en", "de", None, "und"]), words.choice([" ", "\t", "  "]).join(parts) + words.choice([".", "\n", ""]) + "The end"))
    return rows


def asked(documents, rows):
    return documents([(k, text) for k, (_, text) in enumerate(rows)], {k: lang for k, (lang, _) in enumerate(rows)})


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("most", "part"), [(1 << 20, 1 << 20), (1 << 20, 50), (4, 50), (0, 7)])
def test_equals_brute_force(documents, words, monkeypatch, most, part):
    rows = corpus(words)
    monkeypatch.setattr(phrases, "POINTERS", part)
    expected = brute(rows)
    assert len(expected) > 40 and found(phrases.mine(asked(documents, rows).repartition(5), most=most)) == expected


def test_top_and_lengths(documents, words):
    rows = corpus(words)
    assert found(phrases.mine(asked(documents, rows), least=10, longest=3, top=5, inside=50)) == brute(rows, 10, 3, 5, 50)


def test_growth_is_the_same_in_any_ranges():
    random = np.random.default_rng(3)
    rows = np.sort(random.integers(0, 3, (500, 3)), axis=0)
    rows = rows[np.lexsort(rows.T[::-1])].T
    whole = dict(zip(*phrases.grow(rows, np.ones(500, int), 20), strict=True))
    for step in (1, 7, 100, 499):
        parts = Counter()
        for at in range(0, 500, step):
            for p, n in zip(*phrases.grow(rows[:, at : at + step], np.ones(min(step, 500 - at), int), 20), strict=True):
                parts[p] += n
        assert {p: n for p, n in parts.items() if n >= 20} == {p: n for p, n in whole.items() if n >= 20}


def test_words_with_one_first_hash_are_told_apart():
    d = phrases.Dictionary(np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64), True)
    assert d.codes(np.array([5, 5, 5, 9, 10], np.uint64), np.array([1, 2, 3, 3, 3], np.uint64)).tolist() == [0, 1, -1, 2, -1]


def test_awkward_rows(awkward):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert found(phrases.mine(awkward)) == brute(rows)
    assert phrases.mine(awkward.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 10**15
    table = spark.createDataFrame([([1, 2], big)], "p array<long>, f long")
    known = spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", big)], "code long, lang string, word string, n long")
    row = phrases.scored(table, known).first()
    assert (row.score, row.l, row.r, row.lang) == (500_000, 3 * big, big, "en")
