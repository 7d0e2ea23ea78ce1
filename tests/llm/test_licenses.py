import random
import re
from re import _constants as c, _parser

from gridloom.llm import licenses, license_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def rows(df):
    return {(r.doc_id, r.n_words): r for r in df.collect()}


def test_base_columns_match_brute_force(documents, spark):
    texts = [
        "CC-BY cc by CC  BY", "(cc) [by] account by", "xcc by", "cc by", "the GNU General\nPublic License, all rights reserved.", "ALL RIGHTS RESERVED all rights reserved", "general public licence",
        "Été cc by cc by", "all rights; reserved! general/public_license", "occ by all right reserved", "kcc by", "",
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_labels_priority_and_containment(documents):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "SPDX-License-Identifier: GPL-2.0-or-later", 3: "Released under the MIT License.", 4: "Licensed under CC BY-NC 4.0.",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "Das ist mit Lizenz nichts", 7: "Copyright (c) 2020 and https://creativecommons.org/licenses/by-sa/4.0/",
    }
    got = {r.doc_id: r for r in licenses.scan(documents(list(texts.items()))).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["apache-2.0", "gpl-2.0-or-later", "mit", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "", "cc-by-sa-4.0,copyright"]
    assert all(0 < got[i].score <= 1 for i in (1, 2, 3, 4, 5, 7)) and got[6].score == 0


def test_suppression_equals_pairwise():
    import random

    r = random.Random(3)
    for _ in range(300):
        found = {(s, s + r.randint(1, 6), r.randint(1, 5), k) for k in range(r.randint(0, 12)) for s in [r.randint(0, 12)]}
        kept = set(licenses.suppress(list(found)))
        for d in found:
            inside = [o for o in found if o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and ((o[0], o[1], o[2]) != d[:3] or o[3] < d[3])]
            assert (d in kept) == (not inside)


def test_hundreds_of_rules_reachable_by_their_keywords():
    rules = license_rules.load()
    assert len(rules) > 300 and all(r.keywords and 1 <= r.tier <= 5 for r in rules)
    assert {b"cc", b"general", b"reserved"} <= {r.keywords[0] for r in rules}


def test_awkward(awkward):
    out = licenses.scan(awkward).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 9 and by[1].n_words == by[2].n_words == by[3].n_words == by[7].n_words == 0
    assert by[4].n_words == 200_006 and by[4].base_labels == "cc-by" and by[4].labels == "cc-by,cc-by-4.0" and by[4].first_word == 200_002
    assert by[1].first_word is None and by[1].labels == "" and by[1].score == 0
    assert licenses.scan(awkward.limit(0)).count() == 0


def generated(parsed, r):
    """A random string that a pattern matches; repeats at their least and most, lookarounds left out."""
    out = b""
    for op, arg in parsed:
        if op is c.LITERAL:
            out += bytes([arg])
        elif op is c.IN:
            out += {c.LITERAL: lambda v: bytes([v]), c.RANGE: lambda v: bytes([r.choice(v)]), c.CATEGORY: lambda v: b"7" if v is c.CATEGORY_DIGIT else b"w"}[(x := r.choice(arg))[0]](x[1])
        elif op is c.BRANCH:
            out += generated(r.choice(arg[1]), r)
        elif op is c.SUBPATTERN:
            out += generated(arg[3], r)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            for _ in range(r.choice((arg[0], min(arg[1], 3 if arg[0] < 3 else arg[0])))):
                out += generated(arg[2], r)
        else:
            assert op in (c.ASSERT, c.ASSERT_NOT), op
    return out


def test_whatever_a_pattern_matches_passes_its_gate():
    r = random.Random(7)
    for rule in license_rules.load():
        parsed = _parser.parse(rule.pattern.pattern)
        for _ in range(200):
            text = generated(parsed, r)
            if rule.pattern.search(b" " + text + b" "):
                assert rule.may_match(set(text.split())), (rule.label, text)


def test_spellings_reach_their_rules(documents):
    texts = {1: "For noncommercial use only", 2: "Unauthorised copying of this file", 3: "A commercial licence required", 4: "licensed under the MIT licence", 5: "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"}
    got = {r.doc_id: r.labels for r in licenses.scan(documents(list(texts.items()))).collect()}
    tiers = {d.tier for d in licenses.scan(documents([(4, texts[4])])).first().detections}
    assert got == {1: "noncommercial", 2: "proprietary", 3: "proprietary", 4: "mit", 5: "cc0-1.0"} and tiers == {3}
