import hashlib
import random
import re

from llm.helpers import documents, edge_rows
from pagetide.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PARTS = [
    "a", "b.c", "@", ".", "com", "+", "1", "23", "456", "7890", "4111111111111111", "4111 1111-1111 1111", " ", "-", "(", ")", "_", "%", "é", "😀",
    "255", "256", "0255", "1.2.3.4", "+1 (386) 555-3733", "x@y.z", "password=abc123def456", "\n", 'token = "e96702bb6bffa955b"',
]


def test_base_spans_match_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    rows = edge_rows() + [(100 + i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))), "a") for i in range(800)]
    df = documents(spark, rows, extra=True)
    monkeypatch.setattr(pii, "documents", lambda s, d: df)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(brute(t))
    for r in pii.op5_pii(spark, "").collect():
        base = next(b for b in want[r.doc_id] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in BASE]
        assert set(base) <= set(r.spans.split(",") if r.spans else [])


def test_long_runs_do_not_stall_or_overflow(spark):
    rows = [(1, "1" * 200_000, "a"), (2, "a" * 200_000 + "@", "a"), (3, "1." * 50_000, "a"), (4, "1 " * 50_000, "a"), (5, "+1" * 20_000, "a")]
    assert pii.label(documents(spark, rows), ["doc_id"]).count() == 5


def test_redact(spark):
    rows = [
        (1, "😀 write x.y@mail.example.com or call +1 (386) 555-3733, password=abc123def456 ok", "a"), (2, "nothing here", "a"), (3, None, "a"),
    ]
    df = documents(spark, rows, extra=True)
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "😀 write <EMAIL> or call <PHONE>, <SECRET> ok"
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == "nothing here" and out[3].text is None
    assert pii.redact(df).columns == df.columns
    assert pii.redact(df.limit(0)).count() == 0


def test_secrets_go_whole(spark):
    """However long a secret is, and whatever base spans it holds."""
    rnd = random.Random(4)
    key = "".join(rnd.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(1000))
    values = [key, "ab10.0.0.1cd", "x@y.com!z9", "k4111111111111111z", "ab+1(386)555-3733cd"]
    rows = [(i, f"😀 first password={v} then call +1 (386) 555-3733", "a") for i, v in enumerate(values)]
    out = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    assert out == {i: "😀 first <SECRET> then call <PHONE>" for i in range(len(values))}
    found = pii.label(documents(spark, rows), ["doc_id"]).collect()
    at = len("😀 first ")
    for r in found:
        assert [(s.start, s.stop) for s in r.spans if s.kind == "secret"] == [(at, at + len("password=" + values[r.doc_id]))]
