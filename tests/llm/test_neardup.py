import random
from itertools import combinations

import pytest

from gridloom.llm import neardup
from gridloom.operators.components import components


def shingles(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    words = [bytes(w) for w in words]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts, percent=85):
    sets, parent = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed, groups=6, members=25):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(8, 140))]
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                at = r.randrange(len(w))
                kind = r.random()
                if kind < 0.5:
                    w[at] = r.choice(vocabulary)
                elif kind < 0.75:
                    del w[at]
                else:
                    w.insert(at, r.choice(vocabulary))
                w = w or ["x"]
            texts.append((" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("short", "block"), [(50, 256), (3, 4)])
def test_equals_brute_force(documents, monkeypatch, short, block):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(11)
    for percent in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link(documents(texts), percent=percent).collect()}
        assert got == brute(texts, percent)


def test_awkward(awkward):
    out = neardup.link(awkward).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and all(r.kept for r in out)
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[None].component_id is None and by[5].n_shingles == 1 and by[5].component_id == 5
    assert neardup.link(awkward.limit(0)).count() == 0


def test_match_threshold_misses_little():
    import math

    for percent in (80, 85, 95):
        m, p = neardup.match_threshold(percent), percent / 100
        below = sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(m))
        assert below <= neardup.MISS and m > 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("common", "each"), [(17, 3), (85, 15), (170, 30)])
def test_pairs_at_the_threshold_are_candidates(common, each):
    """12,000 pairs of sets with a similarity of exactly 85 %, for each of three sizes; one miss at most is likely."""
    import numpy as np

    g, m = np.random.default_rng(common), neardup.match_threshold(85)
    missed = 0
    for _ in range(12_000):
        shingles_ = g.integers(0, 1 << 63, common + each, dtype=np.uint64)
        a = np.concatenate([shingles_[:common], shingles_[common : common + each // 2]])
        b = np.concatenate([shingles_[:common], shingles_[common + each // 2 :]])
        missed += (neardup.signature(a) == neardup.signature(b)).sum() < m
    assert missed <= 2
