import hashlib
import random

import numpy as np

from gridloom.llm import substrings


def brute(texts, window=20):
    seen, out = set(), {}
    for i, t in sorted(texts):
        words = [bytes(w) for w in (t or "").encode().split()]
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone[k : k + window] = [True] * window
            seen.add(run)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (19, 20, 21, 60)]
    texts = []
    for i in range(80):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 5))]
        texts.append((i * 3 - 50, r.choice((" ", "\n", "\t ")).join(parts)))
    texts += [(1000, texts[5][1]), (-1000, texts[7][1]), (1001, "x " * 70), (1002, "x " * 19)]
    return texts


def test_equals_brute_force(documents):
    texts = corpus()
    want = brute(texts)
    for buckets, groups in ((None, None), (1, 1), (7, 1000), (300, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(documents(texts), buckets=buckets, groups=groups).collect()}
        assert got == want


def test_colliding_hashes_are_told_apart():
    """Hashes of a few bits send nearly every window to the second step; windows of other words still stay."""
    texts = sorted(corpus(), key=lambda t: t[0])
    want = brute(texts)
    first = substrings._first_hashes
    for bits in (64, 60, 16):  # the lowest ones go
        try:
            substrings._first_hashes = lambda words, window, bits=bits: first(words, window) >> np.uint64(bits - 1) << np.uint64(bits - 1)
            assert local(texts, 5, 4) == want
        finally:
            substrings._first_hashes = first


def local(texts, buckets, groups, window=20):
    """The operator's steps without Spark, whose workers don't see what a test replaces."""
    import pyarrow as pa

    dealt = [pa.table({"bucket": pa.array([k] * len(part), pa.int32()), "key": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string())}) for k, part in enumerate(np.array_split(np.array(texts, object), buckets))]

    def counted(step, posted):
        rows = pa.concat_tables(posted)
        return pa.concat_tables([substrings._counter(step)(rows.filter(pa.compute.equal(rows["grp"], g))) for g in set(rows["grp"].to_pylist())])

    of = lambda rows, k: rows.filter(pa.compute.equal(rows["bucket"], k))
    shared = counted(1, [substrings._poster(window, groups)(t) for t in dealt])
    earlier = counted(2, [substrings._reposter(window, groups)(t, of(shared, k)) for k, t in enumerate(dealt)])
    out = {}
    for k, t in enumerate(dealt):
        own, at = substrings._bucket(t, window), 0
        later = substrings._later(own, of(earlier, k), groups)
        for key, n, (starts, ends), raw in zip(own.keys, own.sizes.tolist(), own.words, own.texts, strict=True):
            gone = substrings.covered(len(starts), np.flatnonzero(later[at : at + n]), window)
            at += n
            kept = b" ".join(raw.tobytes()[a:b] for a, b, g in zip(starts, ends, gone, strict=True) if not g)
            out[key] = (len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_intervals_and_text(documents):
    passage = " ".join(f"w{k}" for k in range(25))
    rows = {r.doc_id: r for r in substrings.deduplicate(documents([(1, passage), (2, "a " + passage + " b")]), keep_text=True).collect()}
    assert rows[1].removed == [] and [tuple(x) for x in rows[2].removed] == [(1, 26)] and rows[2].kept == "a b"


def test_awkward(documents, awkward):
    out = substrings.deduplicate(awkward).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[1].n_words == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[4].n_removed == 199_999
    assert substrings.deduplicate(awkward.limit(0)).count() == 0
    passage = " ".join(f"w{k}" for k in range(30))
    again = substrings.deduplicate(documents([(5, passage), (5, passage), (5, "q " + passage), (None, passage), (None, passage), (6, passage)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in again) == [(False, 5, 0), (False, 5, 0), (False, 5, 0), (False, 6, 30), (True, 0, 0), (True, 0, 0)]
