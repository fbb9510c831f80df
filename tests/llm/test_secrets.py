import hashlib
import random
import re

from ionsieve.llm import secrets

HEX = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"


def plain_base(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"""(?:{word}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), m.end(), 0) for m in re.finditer(assign, text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], x[2]))


def texts():
    rng = random.Random(5)
    parts = ["token", "Secret", "API_KEY", "apikey", "passWD", "=", ":", " ", '"', "'", "AKIA", "AKIA" + "Z9" * 8, HEX, HEX[:30],
             "abcdefgh", "abc", "é", "漢字", "ſecret", "\n", "x=y", "token: secret: abcdefghij", HEX + HEX]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)]


def test_known_forms_against_plain_patterns(spark):
    rows = list(enumerate(texts()))
    found = {x.doc_id: x for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = plain_base(text)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in base)
        row = found[i]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == j for _, _, k in base) for j in range(3)), text
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [s for s in row.spans.split(",") if s and not s.startswith("novel")] == [s for s in joined.split(",") if s]


def test_novel_strings_in_a_sensitive_context():
    key = "q7Zr0PwX2mLk9VbT4nYc8HdS1gFj"
    text = f"Authorization header, bearer {key} and then"
    (start, end, _), = secrets.novel_spans(text, [])
    assert text[start:end] == key
    assert not secrets.novel_spans(f"nothing of note: {key}", [])
    assert not secrets.novel_spans("the session is named authorization_session_identifier_1 here", [])
    assert not secrets.novel_spans(f"value {key} once, then the cookie {key}", [])  # the text itself has it
    assert not secrets.novel_spans(text, [(start, end, 0)])
    assert secrets.novelty(text, start, end) > 0.9


def test_odd_rows(odd_docs, no_docs):
    found = secrets.scan_secrets(odd_docs).collect()
    assert len(found) == odd_docs.count() and {x.spans for x in found} == {""}
    assert {x.base_sha256 for x in found} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan_secrets(no_docs).count() == 0
