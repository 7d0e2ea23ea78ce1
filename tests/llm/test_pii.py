import hashlib
import random
import re

from gridloom.llm import pii


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(1)
    for n in range(30_000):
        text = "".join(r.choice("a@@..+123450 -()é%𝄞") for _ in range(r.randint(0, 60)))
        if n % 5 == 0:
            text = "".join(r.choice("0123456789 -") for _ in range(r.randint(15, 24))) + text
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute(text), text


def test_added_kinds():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds('Token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"') == ["secret"]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 and") == ["account"]
    assert kinds("see https://bob:pw@host.example.com/x") == ["email", "url"]
    assert kinds("my account is fine, the token too, http://example.com/page") == []


def test_redaction():
    text = "mail é a.b@c.org, or +1 (017) 555-7713."
    assert pii.redact(text, pii.find(text)) == "mail é [EMAIL], or [PHONE]."
    assert pii.redact("abc", [("x", 0, 2), ("y", 1, 3)]) == "[X]"


def test_rows_and_awkward(documents, awkward):
    r = pii.scan(documents([(1, "x a@b.co 1.2.3.4")])).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.spans == "email:2:8,ip:9:16" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    out = pii.scan(awkward).collect()
    assert len(out) == 9 and {x.base_sha256 for x in out} == {hashlib.sha256(b"").hexdigest()}
    assert pii.scan(awkward.limit(0)).count() == 0


def test_redacted_keeps_rows_and_columns(documents, awkward):
    docs = documents([(1, "x a@b.co"), (2, None), (3, "clean")])
    out = pii.redacted(docs)
    assert out.schema == docs.schema
    assert [(r.text, r.n_chars) for r in out.orderBy("doc_id").collect()] == [("x [EMAIL]", 9), (None, None), ("clean", 5)]
    assert sorted(map(str, pii.redacted(awkward).collect())) == sorted(map(str, awkward.collect()))


def test_long_runs_are_linear():
    pii.find("a" * 200_000 + "@" * 1000 + "1" * 100_000 + "+1" * 20_000 + ". " * 1000 + "1.2.3." * 20_000)


def test_long_secrets_go_whole(documents):
    secret = "eyJ0" + "aB3_-.xyZ9" * 100
    out = {r.doc_id: r.text for r in pii.redacted(documents([(1, f"token: {secret} end"), (2, f"password={'x' * 300}7"), (3, "token=token=abcdefg1 x")])).collect()}
    assert out == {1: "token: [SECRET] end", 2: "password=[SECRET]", 3: "token=[SECRET] x"}
    pii.find("token=" * 200_000)
