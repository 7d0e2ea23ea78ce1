"""Licence scans: ordered signature rules with a keyword prefilter and containment suppression.

A text becomes its words in lower case. An Aho-Corasick automaton over the rules' rare keywords (as whole words)
passes over every text; only texts with a hit are searched, and only by the rules whose keywords all occur. A
detection that lies inside another of the same or a higher tier is suppressed; of equal ones the earlier rule stays.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, LOWER, chunks, table, word_bounds
from .license_rules import CONFIDENCE, load

#: Phrases whose places are counted, with the label each gives.
BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
#: A rare word of each of them, for the prefilter.
BASE_WORDS = {b"cc", b"general", b"reserved"}
#: Confidence of a text in which only base phrases stand.
BASE_CONFIDENCE = 0.5

#: Bytes outside words as spaces, A-Z in lower case.
_WORDS = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)


@functools.cache
def _rules():
    rules = load()
    automaton = ahocorasick.Automaton()
    for word in {*(k for r in rules for k in r.gate[0]), *BASE_WORDS}:
        automaton.add_word(f" {word.decode('latin-1')} ", True)
    automaton.make_automaton()
    base = [(re.compile(b"(?= " + p + b" )"), len(p.split()), label) for p, label in BASE.items()]
    return rules, automaton, base


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (start, end, tier, rule) that lie in no other of the same or a higher tier."""
    kept, reach = [], [-1] * 6
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if max(reach[d[2] :]) < d[1]:
            kept.append(d)
        reach[d[2]] = max(reach[d[2]], d[1])
    return kept


def scan_words(words: list[bytes]) -> tuple[int, int | None, int | None, set[str], list[tuple[int, int, int, int]]]:
    """Of one text: number of base places, first and last word of them, base labels, kept detections (in words)."""
    rules, _, base = _rules()
    text = b" " + b" ".join(words) + b" "
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    places, labels = [], set()
    for pattern, _, label in base:
        at = [m.start() for m in pattern.finditer(text)]
        if at:
            labels.add(label)
            places += np.searchsorted(gaps, at).tolist()
    present, found = set(words), []
    for k, rule in enumerate(rules):
        if rule.may_match(present):
            for m in rule.pattern.finditer(text):
                found.append((int(np.searchsorted(gaps, m.start() - 1)), int(np.searchsorted(gaps, m.end())), rule.tier, k))
    return len(places), min(places, default=None), max(places, default=None), labels, suppress(found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence findings of every row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Whole texts are read; null and empty ones have no words, empty label lists, null first and last words and score 0.
    ``detections`` is an array of (label, start, end, tier) in words, end exclusive. Repeated rows give equal rows;
    the other columns of ``docs`` are left aside.
    An empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        rules, automaton, _ = _rules()
        detection = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tier", pa.int32())]))
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                flat = _WORDS[data].tobytes()
                n, rows = j - i, []
                for k in range(n):
                    own = flat[offsets[k] : offsets[k + 1]]
                    if next(automaton.iter(f" {own.decode('latin-1')} "), None) is None:
                        rows.append((0, None, None, "", "", 0.0, []))
                        continue
                    words = own.split()
                    count, low, high, labels, kept = scan_words(words)
                    named = labels | {rules[d[3]].label for d in kept}
                    sure = max([CONFIDENCE[d[2]] for d in kept] + [BASE_CONFIDENCE] * bool(labels), default=0.0)
                    rows.append((count, low, high, ",".join(sorted(labels)), ",".join(sorted(named)), sure, [{"label": rules[d[3]].label, "start": d[0], "end": d[1], "tier": d[2]} for d in kept]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), detection]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(first)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
                    ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, start: long, end: long, tier: int>>"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
