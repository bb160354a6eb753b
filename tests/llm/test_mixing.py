import random
import re

from llm.helpers import documents, edge_rows
from pagetide.llm import mixing
from pagetide.llm.common import materialize


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def run(spark, rows):
    df = materialize(mixing.sized(documents(spark, rows, extra=True), ["doc_id"]), "t")
    return mixing.with_copies(df, df).selectExpr("doc_id", "size", "_null", "_source", "source_size", "target", "copies * size as taken").collect()


def test_targets_and_taken(spark):
    rnd = random.Random(8)
    rows = edge_rows() + [(100 + i, "w " * rnd.randint(0, 60), rnd.choice(["a", "a", "a", "b", "c", "é", None, "z"])) for i in range(1500)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), {}
    for r in out:
        s = None if r["_null"] else r["_source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    big = max(len(re.findall(r"\S+", t or "")) for _, t, _ in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 2 * big, (s, taken[s], t)
    again = {(r["doc_id"], r["size"]): r["taken"] for r in run(spark, rows[::-1]) if r["doc_id"] is not None and r["doc_id"] >= 100}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in out if r["doc_id"] is not None and r["doc_id"] >= 100}


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = documents(spark, edge_rows(), extra=True)
    out = mixing.mix(df)
    assert out.columns == df.columns
    copies = {}
    for r in out.collect():
        copies[(r["doc_id"], r["text"], r["source"])] = copies.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    assert max(copies.values()) <= 4  # the row that stands twice: two copies each
    assert mixing.mix(df.limit(0)).count() == 0


def test_all_empty_texts(spark):
    assert {r["taken"] for r in run(spark, [(1, "", "a"), (2, None, None)])} == {0}
