import random
import re

from gridloom.llm import decontamination as d

ITEM = "Tom has 5 apples and 3 pears in his big basket. He gives 5 apples to Mary and then walks 12 km to the old market in Berlin."
PLAIN = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the than heoron."


def items(spark, rows=((9, ITEM), (4, PLAIN), (5, "too short"), (None, "null id of some words here"), (6, None))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def docs_of(documents):
    swap = lambda t, **k: " ".join(k.get(w, w) for w in t.split())
    people = {"Tom": "John", "Mary": "Susan"}
    numbers = swap(ITEM, **people).replace("5 apples", "7 apples").replace("12 km", "20 miles").replace("Berlin", "New York")
    return documents(
        [
            (1, "Before. " + ITEM + " After."), (2, "Before. " + numbers + " After."), (3, "Before. " + numbers.replace("gives 7", "gives 9") + " After."), (4, ITEM.upper()),
            (5, "Some words | " + PLAIN.replace(" ", "%%% ").lower()), (6, "clean text that shares that and onesen erblest it hein only"), (7, None), (8, ""), (9, "too short"), (9, "too short"), (None, PLAIN),
        ]
    )


def test_verbatim_and_reparameterised(spark, documents):
    got = {(r.doc_id, r.n_tokens): r for r in d.find(docs_of(documents), items(spark)).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert by[1].item_ids == "9" and by[2].item_ids == "9" and by[5].item_ids == "4" and by[None].item_ids == "4"
    assert not by[3].contaminated, "5 apples became 7 and 9 apples"
    assert not any(by[i].contaminated for i in (6, 7, 8, 9)) and by[7].n_tokens == 0


def test_shuffled_path_gives_the_same(spark, documents):
    docs = docs_of(documents)
    rows = lambda most: sorted(map(str, d.find(docs, items(spark), most=most).collect()))
    assert rows(1) == rows(10**6)
    assert d.find(docs, items(spark, []), most=-1).where("contaminated").count() == 0


def test_empty_and_awkward(spark, documents, awkward):
    assert d.find(awkward, items(spark)).count() == 9 and d.find(awkward, items(spark)).where("contaminated").count() == 0
    assert d.find(awkward.limit(0), items(spark)).count() == 0 and d.find(awkward, items(spark, [])).count() == 9


def test_slots():
    import numpy as np

    def kinds(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return d.tokenize(data, np.array([0, len(data)])).kind.tolist()

    assert kinds("pay 1,000.50 dollars to New York now") == [0, d.NUMBER, d.UNIT, 0, d.NAME, 0]
    assert kinds("five kg. The end") == [d.NUMBER, d.UNIT, 0, 0] and kinds("ALL CAPS words") == [0, 0, 0]


def test_verbatim_copies_of_slot_dense_items(spark, documents):
    asked = [(1, "What is 12 * 7 + 5?"), (2, "Alice has 5 apples and Bob 3"), (3, "Add 5 to nine"), (4, "Paris lies on the old river"), (5, "New York City Hall")]
    docs = documents([(i, f"Question {t} and so on") for i, t in asked] + [(6, "What is 12 * 8 + 5? Alice has 5 apples and Bob 4"), (7, "they say, paris lies on the old river.")])
    for most in (10**6, 1):
        got = {r.doc_id: r.item_ids for r in d.find(docs, items(spark, asked), most=most).collect()}
        assert got == {1: "1", 2: "2", 3: "3", 4: "4", 5: "5", 6: "", 7: "4"}


def test_slots_are_judged_by_run_and_one_way(spark, documents):
    asked = [(9, "Tom has 5 apples and 3 pears in his basket now while she slowly eats 5 plums with 3 figs and some bread")]
    swap = lambda *new: asked[0][1].replace("5 apples", f"{new[0]} apples").replace("3 pears", f"{new[1]} pears").replace("5 plums", f"{new[2]} plums").replace("3 figs", f"{new[3]} figs")
    tail = " and they all sit down near the wide river"
    docs = documents([(1, swap(4, 4, 4, 4)), (2, swap(7, 2, 9, 2).replace("now", "soon")), (3, swap(7, 2, 9, 2)), (4, asked[0][1].replace("3 figs", "4 figs") + tail)])
    asked.append((8, asked[0][1] + tail))
    for most in (10**6, 1):
        got = {r.doc_id: r.item_ids.split(",") for r in d.find(docs, items(spark, asked), most=most).collect()}
        assert "9" in got[1] and "9" in got[2] and got[3] == [""] and "8" in got[4]


def brute_tokens(text):
    """Words in lower case and tokens (kind or None, literal) with the words each stands for, by the definition."""
    numbers, units, names = (set(x.split()) for x in (d._NUMBER_WORDS, d._UNITS, d._NAMES))
    found = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text))
    kinds = []
    for k, m in enumerate(found):
        w, low = m[0], m[0].lower()
        between = text[found[k - 1].end() : m.start()] if k else ""
        begins = not k or any(x in "\n\r.?!:" for x in between)
        kind = None
        if "A" <= w[0] <= "Z" and (low in names or (not begins and any("a" <= x <= "z" for x in w))):
            kind = "name"
        if w[0] in "0123456789" or low in numbers:
            kind = "number"
        elif low in units and k and kinds[-1] == "number":
            kind = "unit"
        kinds.append(kind)
    tokens = []
    for k, m in enumerate(found):
        gap = text[found[k - 1].end() : m.start()] if k else ""
        same = k and kinds[k] and kinds[k] == kinds[k - 1] and len(gap) == 1
        if same and (kinds[k] == "name" or (kinds[k] == "number" and gap != " ")):
            tokens[-1] = (kinds[k], (*tokens[-1][1], m[0].lower()), [*tokens[-1][2], k])
        else:
            tokens.append((kinds[k], (m[0].lower(),), [k]))
    return [m[0].lower() for m in found], tokens


def brute_leaks(text, item):
    """Whether an item leaks into a text, by comparing every window of the one with every window of the other."""
    (words, tokens), (item_words, item_tokens) = brute_tokens(text), brute_tokens(item)
    if len(item_words) < 4:
        return False
    shape = lambda ts: [k or w for k, w, _ in ts]
    covered, n = set(), min(8, len(item_tokens))
    if len(item_tokens) >= 4:
        own, other = shape(tokens), shape(item_tokens)
        diagonals = {}
        for a in range(len(own) - n + 1):
            for b in range(len(other) - n + 1):
                if own[a : a + n] == other[b : b + n] and sum(k is None for k, _, _ in item_tokens[b : b + n]) >= 4:
                    diagonals.setdefault(a - b, []).append(b)
        for shift, places in diagonals.items():
            runs = []
            for b in places:
                if runs and b <= runs[-1][-1] + 1:
                    runs[-1] += range(runs[-1][-1] + 1, b + n)
                else:
                    runs.append(list(range(b, b + n)))
            for run in runs:
                pairs = {(item_tokens[p][:2], tokens[p + shift][1]) for p in run if item_tokens[p][0]}
                if len(pairs) == len({a for a, _ in pairs}):
                    covered.update(run)
    m, copied = min(8, len(item_words)), set()
    for b in range(len(item_words) - m + 1):
        if any(words[a : a + m] == item_words[b : b + m] for a in range(len(words) - m + 1)):
            copied.update(range(b, b + m))
    covered.update(k for k, (_, _, own) in enumerate(item_tokens) if copied.issuperset(own))
    return len(covered) >= min(13, len(item_tokens)) or 2 * len(covered) >= len(item_tokens)


def random_benchmark(r, n):
    plain = "the of a train leaves station and then travels how many are left in each box when they share all what is total speed".split()
    slots = ("Alice", "Bob", "New York", "John Smith", "5", "12", "1,000.5", "seven", "3 km", "20 miles", "40 euros")
    return [(i, " ".join(r.choice(slots) if r.random() < 0.25 else r.choice(plain) for _ in range(r.randint(3, 30))) + r.choice((".", "?", ""))) for i in range(n)]


def changed(r, text):
    """A text with some of its slots, and sometimes a word, exchanged."""
    to = {"Alice": "Emma", "Bob": "Alice", "John": "Peter", "York": "Town", "5": "9", "12": "5", "seven": "8", "km": "miles", "20": "30"}
    to = {k: v for k, v in to.items() if r.random() < 0.7}
    out = [to.get(w, w) if r.random() < 0.95 else "9" if w.isdigit() else w for w in text.split(" ")]
    if r.random() < 0.4:
        out[r.randrange(len(out))] = "other"
    at = sorted(r.randint(0, len(out)) for _ in range(2)) if r.random() < 0.3 else (0, len(out))
    return " ".join(out[at[0] : at[1]])


def test_equals_brute_force(spark, documents):
    r = random.Random(12)
    asked = random_benchmark(r, 40)
    texts = [(i, " ".join(changed(r, r.choice(asked)[1]) if r.random() < 0.5 else random_benchmark(r, 1)[0][1] for _ in range(r.randint(1, 3)))) for i in range(150)]
    want = {i: ",".join(str(k) for k, x in asked if brute_leaks(t, x)) for i, t in texts}
    assert 40 < sum(x != "" for x in want.values()) < 150
    for most in (10**6, 1):
        got = {x.doc_id: x.item_ids for x in d.find(documents(texts), items(spark, asked), most=most).collect()}
        assert got == want
