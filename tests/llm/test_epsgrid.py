import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import ordered
from pagetide.llm import epsgrid


def brute(rows):
    root, count = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    groups = {}
    for i, r in enumerate(rows):
        if usable(r):
            groups.setdefault((r[2], len(r[1])), []).append(i)
    for ids in groups.values():
        v = np.array([rows[i][1] for i in ids], float)
        norm = np.linalg.norm(v, axis=1)
        link = (v @ v.T) / norm[:, None] / norm[None, :] >= 0.98
        np.fill_diagonal(link, False)
        for a, b in zip(*np.nonzero(link)):
            count[ids[a]] += 1
            root[find(ids[a])] = find(ids[b])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], count[i], least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows)]


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 20)):
                v = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.13, 0.2])
                rows.append((i, [float(x) for x in (v * rng.choice([1, 3])).astype("f4")], label))
                i += 1
        rows += [
            (i, [0.0] * 16, label), (i + 1, None, label), (i + 2, [float("nan")] * 16, label), (i + 3, [1.0, None] + [0.0] * 14, label),
            (i + 4, [], label), (i + 5, [1.0] * 8, label), (i + 6, [1.0] * 8, label), (None, [1.0] * 8, label), (i + 7, [float("inf")] * 16, label),
        ]
        i += 8
    return rows + [(5, rows[5][1], 0), (100_000, rows[5][1], 0)]


@pytest.mark.parametrize("block,leaf", [(16, 4), (1024, 128)])
def test_links_match_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(epsgrid, "BLOCK", block)
    monkeypatch.setattr(epsgrid, "LEAF", leaf)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"component_id": F.lit("x"), "cid": F.lit(1)})
    assert ordered(epsgrid.near_duplicates(df).collect()) == ordered(brute(rows))


def test_skipping_never_loses_a_link(monkeypatch):
    monkeypatch.setattr(epsgrid, "LEAF", 4)
    rng = np.random.default_rng(2)
    u = epsgrid._unit(np.repeat(rng.normal(size=(40, 12)), 8, axis=0) + rng.normal(size=(320, 12)) * 0.06)
    axes = {12: np.linalg.qr(rng.normal(size=(12, epsgrid.LEADING)))[0]}
    p = epsgrid._project(u, axes)
    order = np.lexsort(np.floor(p / 0.2).T[::-1])
    u, p = u[order], p[order]
    want = u @ u.T >= 0.98
    np.fill_diagonal(want, False)
    assert (epsgrid.block_links(u, u, p, p, True, 0.98, 0.2) == want).all()
    assert (epsgrid.block_links(u[:100], u[100:], p[:100], p[100:], False, 0.98, 0.2) == want[:100, 100:]).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert epsgrid.near_duplicates(df).count() == 0
