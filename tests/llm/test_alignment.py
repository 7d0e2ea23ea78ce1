import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import alignment

ODD = ["", " ", "two  spaces\t\n", "<|endoftext|> and <s> <0x41>", "a ▁ b", "é𝄞 ünï ½ ﬁ", "\0\x7f", "naïve Straße 12345678", "x" * 3000]


def tokens():
    c = alignment.coders(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}")
    bytes_ = [[v.data[s : s + n].tobytes() for s, n in zip(v.starts, v.lengths, strict=True)] for v in (c.a_vocabulary, c.b_vocabulary)]
    return c, *bytes_


def brute(rows):
    """Token by token, range by range."""
    c, in_a, in_b = tokens()
    per, corpus = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a = c.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = c.b.encode(text) if text else []
        if b"".join(in_a[t] for t in a) != whole or b"".join(in_b[t] for t in b) != whole:
            a = b = []
        spans = []
        for ids, names in ((a, in_a), (b, in_b)):
            at, side = 0, []
            for t in ids:
                side.append((t, at, at + len(names[t])))
                at += len(names[t])
            spans.append(side)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        links = Counter()
        first = 0
        for t, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links[t, spans[1][k][0]] += 1
                k += 1
        corpus.update(links.keys())
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (t, _), n in corpus.items():
        most[t] = max(most[t], n)
    return [(i, n_a, n_b, g, sum(links.values()), sum(n for p, n in links.items() if corpus[p] == most[p[0]]), sum(corpus[p] * n for p, n in links.items()), sha) for i, n_a, n_b, g, links, sha in per]


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [0, 40, 1 << 21])
def test_equals_brute_force(spark, documents, words, most):
    vocabulary = ["tion", "Lorem", "ips", "über", "qu'il", "42", "...", "naïf", "the", "of", "\n"]
    texts = [" ".join(words.choices(vocabulary, k=words.randrange(60))) for _ in range(60)] + ODD + [None, "the of"] * 5
    rows = list(enumerate(texts))
    assert found(alignment.align(documents(rows).repartition(3), most=most)) == sorted(brute(rows), key=repr)


def test_chunks_of_a_batch_change_nothing(documents, monkeypatch):
    texts = ["some words in it", None, "ünï", "", "▁", "last one"] * 3
    coder = tokens()[0]
    data = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    whole = alignment.align_texts(texts, np.frombuffer(b"".join(data), np.uint8), offsets, coder)
    for k, t in enumerate(texts):
        one = alignment.align_texts([t], np.frombuffer(data[k], np.uint8), np.array([0, len(data[k])]), coder)
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            assert getattr(one, name)[0] == getattr(whole, name)[k]
        assert one.groups[0] == whole.groups[k] and one.pairs[0].tolist() == whole.pairs[k].tolist() and one.ends[0].tolist() == whole.ends[k].tolist()


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.where("doc_id is null or doc_id != 4").collect()]
    assert found(alignment.align(awkward.where("doc_id is null or doc_id != 4"))) == sorted(brute(rows), key=repr)
    assert alignment.align(awkward.limit(0)).collect() == []
    long = alignment.align(awkward, keep_groups=True).where("doc_id = 4").first()
    assert long.n_a > 200_000 and len(long.ends) == long.n_groups and long.n_links == long.n_a + long.n_b - long.n_groups
    assert long.ends[-1] == 1 + len("word " * 200_000 + "licensed under cc by 4.0") and long.groups.count(";") == long.n_groups - 1


def test_text_that_pieces_cannot_give_back_has_no_tokens(documents):
    row = alignment.align(documents([(1, "a ▁ b")])).first()
    assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256) == (0, 0, 0, 0, 0, 0, "")


def test_decimals_of_a_vocabulary():
    ids, marks = np.array([0, 7, 10, 99, 100, 50257, 65535, 1]), np.array([44, 0, 59, 124, 0, 44, 59, 0], np.uint8)
    text, lengths = alignment._digits(ids, marks)
    want = [f"{i}{chr(m) if m else ''}" for i, m in zip(ids.tolist(), marks.tolist(), strict=True)]
    assert text.tobytes().decode() == "".join(want) and lengths.tolist() == [len(x) for x in want]
    assert alignment._decimals(1 << 16) is alignment._decimals(1 << 16)  # written out once for a vocabulary
