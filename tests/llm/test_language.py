import random
import zlib

from gridloom.llm import language

BASE = {"en": "the house and the tree with water over there", "de": "das haus und der baum mit wasser über dort", "fr": "la maison et l'arbre avec de l'eau là-bas"}


def corpus(n=240):
    r = random.Random(6)
    texts, langs = [], {}
    for i in range(n):
        langs[i] = r.choice(list(BASE))
        texts.append((i, " ".join(r.choice(BASE[langs[i]].split()) for _ in range(r.randint(5, 60)))))
    return texts, langs


def test_held_out_accuracy(documents):
    texts, langs = corpus()
    rows = language.identify(documents(texts, langs)).collect()
    assert len(rows) == 240 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_dont_matter(documents):
    texts, langs = corpus()
    wrong = {i: "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else x for i, x in langs.items()}
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(documents(texts, x)).collect()} for x in (langs, wrong))
    assert a == b and "xx" not in {p for p, _ in a.values()}


def test_bounded_sample(documents):
    texts, langs = corpus(600)
    rows = language.identify(documents(texts, langs), sample=20).collect()
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) > 570


def test_awkward(documents, awkward):
    out = {r.doc_id: r for r in language.identify(awkward).collect()}
    assert {r.lang_pred for r in out.values()} == {"und"} and language.identify(awkward.limit(0)).count() == 0
    texts, langs = corpus(60)
    extra = [(900, None), (901, ""), (902, "123 !?"), (903, "Δ"), (None, "the house")]
    got = {r.doc_id: r for r in language.identify(documents(texts + extra, langs)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred != "und" and got[None].held_out is False


def test_keeping_rows(documents):
    texts, langs = corpus(60)
    docs = documents(texts + [(900, None), (901, "?? 12")], langs)
    kept = language.keep_identified(docs, language.fit_documents(docs), 0.5)
    assert kept.schema == docs.schema and kept.count() == 60


def brute(texts, langs):
    """(likeliest language, posterior) of every text by the definition: counts, smoothing, prior, sums of logarithms."""
    import math
    from collections import Counter

    fold = lambda t: [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in t + "  "]

    def bucket(gram):
        h = len(gram)
        for x, k in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            h = (h ^ x) * k & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x27D4EB2F & 0xFFFFFFFF) >> 17

    grams = lambda t: [bucket(x[p : p + n]) for x in [fold(t)] for n in (1, 2, 3) for p in range(len(x) - n + 1)]
    counts, sizes = {}, Counter()
    for i, t in texts:
        if i is not None and t is not None and langs.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(langs[i], Counter()).update(grams(t))
            sizes[langs[i]] += 1
    totals = {x: sum(c.values()) + 0.1 * 32768 for x, c in counts.items()}
    out = []
    for _, t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        own = Counter(grams(t))
        score = {x: math.log(sizes[x] / sum(sizes.values())) + sum(n * math.log((counts[x][b] + 0.1) / totals[x]) for b, n in own.items()) for x in sorted(counts)}
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())))
    return out


def test_scores_equal_brute_force(documents):
    r = random.Random(3)
    langs, texts = {}, []
    for i in range(90):
        langs[i] = r.choice(list(BASE))
        mixed = [r.choice(BASE[r.choice(list(BASE))].split())[:3] for _ in range(r.randint(1, 5))]
        texts.append((i, " ".join(mixed)))
    texts += [(500, "t"), (501, None), (502, ""), (503, "9 9"), (504, "Straße ÀÉ ǅ İ 中文 x")]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(documents(texts, langs)).collect()}
    want = brute(texts, langs)
    assert sum(0.01 < s < 0.99 for _, s in want) > 10
    for (i, _), (lang, score) in zip(texts, want, strict=True):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, i
