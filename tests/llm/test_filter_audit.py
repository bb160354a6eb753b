"""Operator 13 against one document at a time and one order at a time."""

import random
from itertools import permutations

import pytest

from pagetide.llm.filter_audit import AUDIT, MEASURES, failures, interactions

from . import helpers


def failed(rows):
    """The failed filters of each (doc_id, text, lang) row."""
    space = " \t\n\x0b\f\r"
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words, word = [], ""
        for c in t + " ":
            if c in space:
                words += [word] if word else []
                word = ""
            else:
                word += c
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            f.add("C")
        if any(c in "#$%&*|" for c in t):
            f.add("D")
        order = lambda x: (x is None, x)
        if any((u or "") == t and i != doc_id and (doc_id is None or (i is not None and order(i) < order(doc_id))) for i, u, _ in rows):
            f.add("E")
        out.append(f)
    return out


def brute(rows, labels):
    fails = failed(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                share[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = share[v[-1]]
    return out


def audit(spark, rows, labels, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        from pyspark.sql import functions as F

        clash = {**helpers.CLASHES, "mask": 3, "digest": "x", "part": "p", "good": False, "toxic": 1, "first": 1, "key": 2, "A": True, "s": 1}
        docs = docs.withColumns({k: F.lit(v) for k, v in clash.items() if k not in docs.columns})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = interactions(failures(docs, marks))
    assert found.columns == ["part", "filter_order", "step", *MEASURES]
    return {(r[0], r[1], r[2]): list(r[3:]) for r in found.collect()}


def table(seed, n=300):
    rnd = random.Random(seed)
    texts = ["", None, "word", "A B", " \x0b", "#"]
    for _ in range(40):
        vocab = [rnd.choice(["the", "The", "of", "é", "x#y", "AND", f"w{i}"]) if rnd.random() < 0.5 else f"v{i}" for i in range(rnd.choice([3, 90, 150, 400]))]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(rnd.choice(vocab) for _ in range(rnd.choice([1, 150, 199, 200, 201, 260]))))
    rows = [(rnd.choice([i, i, i, None, i // 2]), rnd.choice(texts), rnd.choice(["en", "fr", None, ""])) for i in range(n)]
    labels = [(rnd.choice([i, i, None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 1), (4, 0, 0)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rows, labels = table(seed)
    want = brute(rows, labels)
    assert audit(spark, rows, labels) == want
    assert {k for k in range(7) if any(v[k] for v in want.values())} == set(range(7))


def test_edge_rows_and_clashing_columns(spark):
    rows = [(d, t, s) for d, t, s in helpers.edge_rows()]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    assert audit(spark, rows, labels, extra=True) == brute(rows, labels)


def test_empty_table(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    assert AUDIT.startswith("part string")


def test_one_text_holds_a_third_of_the_rows(spark):
    rows = [(i, "same text", "en" if i % 2 else "fr") for i in range(900, 0, -1)] + [(i, f"t{i}", "en") for i in range(1000, 2800)]
    assert audit(spark, rows, [(900, 1, 0)]) == brute_fast(rows)


def brute_fast(rows):
    """For rows whose texts all have few words: A fails, copies fail E."""
    out = {}
    lowest = {}
    for d, t, _ in rows:
        lowest[t] = min(d, lowest.get(t, d))
    for part in ("en", "fr"):
        mine = [(d, t) for d, t, p in rows if p == part]
        n, e = len(mine), sum(lowest[t] < d for d, t in mine)
        good = 900 in [d for d, _ in mine]
        for order in permutations("ABCDE"):
            order = "".join(order)
            first_e = order.index("E") < order.index("A")
            kept = n
            for step, x in enumerate(order, 1):
                removed = {"A": n - e if first_e else n, "E": e if first_e else 0}.get(x, 0)
                kept -= removed
                fails = {"A": n, "E": e}.get(x, 0)
                lost = int(good and (x == "E") == first_e and x in "AE")
                share = {"A": 60 * n + 60 * (n - e), "E": 60 * e}.get(x, 0)
                out[part, order, step] = [kept, removed, fails - removed, n - e if x == "A" else 0, lost, 0, share]
    return out
