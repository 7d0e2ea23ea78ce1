"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, ``://`` and cue words
such as "account" or "token". At each anchor small deterministic parsers expand to the left and right and validate
what they took (labels of a host name, parts of an IP address, Luhn and IBAN checksums, digit counts). Offsets are
code points. Nothing is searched away from an anchor, so clean text costs the single pass.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table

#: Kinds in their order; the first four are counted on their own.
KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_TAIL = re.compile(r"[^\s\"'<>\\^`{|}]+")
_SCHEMES = ("https", "http", "sftp", "ftp", "ssh")
_PERSONAL_QUERY = re.compile(r"[?&;](?:user|username|email|mail|token|key|auth|session|sid|password)=[^&#]", re.IGNORECASE)
_ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "passport")
_SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "passwort")
_ACCOUNT_LEAD = re.compile(r"(?: ?(?:number|no|nr|num|id|nummer)\.?)?[ \t]*[:#=]?[ \t]*", re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Z0-9](?:[ -]?[A-Z0-9]){5,33}")
_SECRET_LEAD = re.compile(r"[ \t]*[:=][ \t]*[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{8,}")


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("@", 1))
    automaton.add_word("+", ("+", 1))
    automaton.add_word("://", (":", 3))
    for d in "0123456789":
        automaton.add_word(d, ("0", 1))
    for kind, cues in (("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = re.sub(r"[ -]", "", text)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _account(text: str, after: int) -> tuple[int, int] | None:
    start = _ACCOUNT_LEAD.match(text, after).end()
    m = _ACCOUNT.match(text, start)
    if not m:
        return None
    end = m.end()
    if end < len(text) and _word(text[end]):
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
    value = text[start : max(start, end)].rstrip(" -")
    if iban(value) or (len(value) >= 6 and 2 * sum(c.isdigit() for c in value) > len(value) and sum(c.isdigit() for c in value) >= 6):
        return start, start + len(value)
    return None


def _secret(text: str, after: int, left: int) -> tuple[tuple[int, int] | None, int]:
    """The span, and the end of what was judged; a run that starts before ``left`` is the rest of a judged one."""
    lead = _SECRET_LEAD.match(text, after)
    m = _SECRET.match(text, lead.end()) if lead and lead.end() >= left else None
    if not m:
        return None, left
    return (m.span() if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) else None), m.end()


def _url(text: str, at: int, left: int) -> tuple[int, int] | None:
    """``at`` is the colon of ``://``; ``left`` the end of the URL before."""
    for scheme in _SCHEMES:
        start = at - len(scheme)
        if start >= left and text[start:at].lower() == scheme and not (start > 0 and _word(text[start - 1])):
            break
    else:
        return None
    m = _URL_TAIL.match(text, at + 3)
    if not m:
        return None
    tail = m[0].rstrip(".,;:!?)]")
    authority = re.split(r"[/?#]", tail, maxsplit=1)[0]
    user, _, host = authority.rpartition("@")
    if _HOST.match(host) and (user or _PERSONAL_QUERY.search(tail)):
        return start, at + 3 + len(tail)
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in order of kind and start; those of one kind don't overlap, leftmost first."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)
    judged = 0

    def take(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] >= after[kind]:
            found[kind].append(span)
            after[kind] = span[1]

    for last, (anchor, length) in _anchors().iter(text):
        at = last + 1 - length
        if anchor == "0":
            if at >= after["ip"]:
                m = _IP.match(text, at)
                if m and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
                after["ip"] = m.end() if m else _DIGITS.match(text, at).end()
            if at >= after["card"]:
                m = _CARD.match(text, at)
                if m and m.end() - at < 60:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                after["card"] = m.end() if m else at + 1
        elif anchor == "@":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _HOST.match(text, at + 1)):
                take("email", (start, m.end()))
        elif anchor == "+":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
                after["phone"] = m.end()
        elif anchor == ":":
            take("url", _url(text, at, after["url"]))
        elif not (at > 0 and _word(text[at - 1])) and not (last + 1 < len(text) and _word(text[last + 1])):
            if anchor == "account":
                take("account", _account(text, last + 1))
            else:
                span, judged = _secret(text, last + 1, judged)
                take("secret", span)
    return [(k, *span) for k in KINDS for span in found[k]]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones as one, replaced by its kind in brackets."""
    parts, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_other, the spans of other kinds.

    Whole texts are read; null and empty ones have no spans (the digest of the empty string). Repeated rows give
    equal rows; the other columns of ``docs`` are left aside. An empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                spans = find(t) if t else []
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS)
                rows.append((*(sum(s[0] == k for s in spans) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans), sum(s[0] not in BASE_KINDS for s in spans)))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long").withColumnRenamed("key", key)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind; ``length`` is brought up to date.

    All columns keep their names, order and types; a null text stays null, and rows without spans stay as they are.
    """

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [redact(t, spans) if t and (spans := find(t)) else t for t in old]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None and (n := batch.schema.get_field_index(length)) >= 0:
                columns[n] = pa.array([len(t) if t is not None and t is not o else was for t, o, was in zip(new, old, columns[n].to_pylist(), strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_pii_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
