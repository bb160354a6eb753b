"""Operator 11 against a trie of tuples."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pagetide.llm import trie as M

from . import helpers

COLUMNS = [*M.STATS, "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    done = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        done[c] = tuple(own.get(head, [])[:h] + v[h:])
    nodes = {}
    for c, v in done.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for q, members in nodes.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += kids[q] == 0
            saved[q[:d]] += (len(members) - 1) * (len(q[-1][1].encode()) if q else 0)
    out = []
    for p, members in nodes.items():
        ended = sorted(c for c in members if len(done[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], sha))
    return helpers.ordered(out)


def found(spark, rows, extra=False, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        clash = {**helpers.CLASHES, "c": 1, "d": 2, "pa": 3, "pb": 4, "h": 5, "k": 6, "pos": 7, "digest": "x", "_part": 8, "_at": 9, "bytes": 1, "stretch": 0, "shared": True}
        df = df.withColumns({k: F.lit(v) for k, v in clash.items()})
    return helpers.ordered(M.trie(df, **how).select(*COLUMNS).collect())


def table(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    talk = [("user", "hello"), ("assistant", "hi é"), ("user", None), (None, "x" * 30), ("user", ""), ("a", "b")]
    for c in rnd.sample(range(-12, 3 * n), n):
        for t in range(rnd.choice([1, 1, 2, 5, 9, 14])):
            role, text = rnd.choice(talk[: rnd.choice([1, 2, 6])])
            rows.append((c, t if rnd.random() < 0.9 else None, role, text if rnd.random() < 0.7 else f"{text}{rnd.randint(0, 9)}"))
    rows += rnd.sample(rows, 15) + [(None, 1, "user", "hello"), (7, None, None, None), (7, 3, "user", "a"), (7, 3, "b", "a"), (7, 3, "b", "a")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = table(seed)
    assert found(spark, rows, extra=seed == 2) == brute(rows)


def test_a_full_sketch_changes_nothing(spark):
    rows = table(3)
    assert found(spark, rows, max_cells=8) == brute(rows)


def test_long_conversations_carry_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 4)
    rows = table(4, 20) + [(c, t, "user", f"turn {t}" if t < 30 else f"turn {t} of {c}") for c in (1000, 1001, 1002, 1005) for t in range(34)]
    assert found(spark, rows) == brute(rows)


def test_a_third_of_all_conversations_are_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(2)] + [(c, 0, "user", "same" if c % 2 else f"t{c}") for c in range(3000, 6000)]
    got = found(spark, rows)
    assert got == brute(rows)
    copies = next(r for r in got if r[:2] == (0, 2))
    assert copies[3] >= 3000 and copies[7] != M.EMPTY_SHA256


def test_turnless_conversations_and_empty_table(spark):
    assert found(spark, []) == []
    lonely = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lonely, 0, "user", "x"), (lonely, 1, "user", "y")]
    assert found(spark, rows) == brute(rows) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_sketch_never_calls_a_shared_prefix_single():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(-(1 << 63), 1 << 63, (2, 5000))
    for width in (8, 1 << 10, 1 << 15, 1 << 18):
        one, two, all_ = M.Sketch(width), M.Sketch(width), M.Sketch(width)
        one.add(a[:3000], b[:3000])
        two.add(a[2000:], b[2000:])  # 1,000 prefixes stand on both sides
        all_.add(np.concatenate((a[:3000], a[2000:])), np.concatenate((b[:3000], b[2000:])))
        both = {}
        for sketch in (one, two):
            for i, blob in sketch.slices():
                both.setdefault(i, []).append(blob)
        step = min(M.SLICE, width)
        bits = np.zeros((M.ROWS * width // step, step // 8), np.uint8)
        for i, blobs in both.items():
            merged = M.merge_slices(blobs)
            assert merged[len(merged) // 2:] == np.packbits(all_.count.reshape(-1, step)[i] > 1).tobytes()
            bits[i] = np.frombuffer(merged, np.uint8).reshape(2, -1)[1]
        single = M.estimate_is_one(bits.reshape(M.ROWS, -1), a, b)
        assert not single[2000:3000].any()
        if width >= 1 << 15:
            assert single.mean() > 0.75


def test_long_texts(spark):
    rows = [(5, 0, "user", "é" * 400_000), (6, 0, "user", "é" * 400_000), (10, 0, "user", "é" * 400_000 + "x")]
    assert found(spark, rows) == brute(rows)
