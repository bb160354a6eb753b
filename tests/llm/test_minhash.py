import random
import re

import numpy as np
import pytest

from llm.helpers import documents, edge_rows, ordered, random_texts
from pagetide.llm import minhash


def shingles(text, width):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and sets[j]:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), c, r[0] is not None and r[0] == c))
    return out


def near_copies(seed):
    rnd = random.Random(seed)
    rows, n = [], 100
    for words in (4, 5, 9, 30, 120, 400):
        for _ in range(4):
            base = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(words)]
            for _ in range(rnd.randint(1, 6)):
                copy = list(base)
                for _ in range(rnd.randint(0, 1 + words // 40)):
                    copy[rnd.randrange(len(copy))] = rnd.choice(["x", "y", "Z"])
                rows.append((n, " ".join(copy), "a"))
                n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    rows = edge_rows() + near_copies(width) + [(900 + i, t, "a") for i, t in enumerate(random_texts(10, 30))]
    got = minhash.near_duplicates(documents(spark, rows, extra=True), width).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == ordered(brute(rows, width))


def test_dedup_keeps_one_of_each_group(spark):
    rows = edge_rows() + near_copies(3)
    df = documents(spark, rows, extra=True)
    out = minhash.dedup(df)
    assert out.columns == df.columns
    want = brute(rows, 5)
    ids = sorted(r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None)
    assert ids == sorted({w[0] for w in want if w[3]})
    assert minhash.dedup(df.limit(0)).count() == 0


def test_sketch_of_few_values_is_dense_and_similar_sets_agree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert np.isin(minhash.sketch(s), s).all()
    agree = []
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(pool[:900]), np.sort(pool[100:])
        agree.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(agree) - 800 / len(pool)) < 0.02


def test_shared_passage_without_link_stays_apart(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, passage + " " + " ".join(word() for _ in range(40)), "a") for i in range(60)]
    assert minhash.dedup(documents(spark, rows)).count() == 60


def test_templated_crowd_matches_brute_force(spark):
    """Pages of one template (0.78 alike) that come in pairs just above the threshold."""
    rnd = random.Random(11)
    words = lambda k: ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(k)]
    template, rows = words(303), []
    for _ in range(700):
        shared = words(6)
        rows += [(0, " ".join(template + shared + words(36)), "a") for _ in range(2)]
    rnd.shuffle(rows)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    number = {}
    sets = [frozenset(number.setdefault(x, len(number)) for x in shingles(t, 4)) for _, t, _ in rows]
    want = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                want[i] = want[j]
    assert len(set(want)) == 700
    got = minhash.near_duplicates(documents(spark, rows), 4).select("doc_id", "component_id").collect()
    assert [r.component_id for r in sorted(got)] == want


@pytest.mark.parametrize("small,block", [(2, 3), (1000, 512)])
def test_rest_is_exact_in_blocks_and_in_small_buckets(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies(21) + near_copies(22)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = minhash.near_duplicates(documents(spark, rows), 4).select("doc_id", "n_shingles", "component_id", "kept")
    assert ordered(got.collect()) == ordered(brute(rows, 4))


def pair_at_threshold(rng, n):
    """Sorted sets of n values whose similarity is 0.8 or a little more."""
    same = -(-8 * n // 9)  # |a and b| / |a or b| = same / (2n - same)
    pool = np.unique(rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    pool = rng.permutation(pool)
    return np.sort(pool[:n]), np.sort(np.concatenate((pool[:same], pool[n:])))


@pytest.mark.parametrize("n", [200, 230, 1000])
def test_sketch_check_and_bands_lose_no_pair_at_the_threshold(n):
    rng = np.random.default_rng(n)
    least, banded, total = minhash.CHECKED, 0, 3000 if n < 1000 else 1000
    for _ in range(total):
        a, b = (minhash.sketch(s) for s in pair_at_threshold(rng, n))
        same = a[: minhash.CHECKED].astype(np.uint8) == b[: minhash.CHECKED].astype(np.uint8)
        least = min(least, int(same.sum()))
        banded += bool((minhash.band_keys(a) == minhash.band_keys(b)).any())
    assert least >= minhash.AGREE and banded == total


def test_prefixes_of_a_templated_crowd_make_few_matches():
    """What all pages share makes no pairs, and pairs at the threshold meet."""
    import collections

    import pyarrow as pa

    rnd = random.Random(11)
    words = lambda k: ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(k)]
    template, texts = words(303), []
    for _ in range(700):
        shared = words(6)
        texts += [" ".join(template + shared + words(36)) for _ in range(2)]
    sets = list(minhash.shingle_sets(pa.array(texts), 4))
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["cid", "text"])
    sides = {True: collections.defaultdict(list), False: collections.defaultdict(list)}
    size = [len(s) for s in sets]
    for found in minhash._prefixes([batch], 4, 80, 100, tokens[counts > 1], counts[counts > 1]):
        for r in found.to_pylist():
            own = int(minhash.size_class(size[r["cid"]]))
            for partner in range(r["lo"] - 1, r["hi"] + 2):
                sides[r["short"]][r["token"], *((own, partner) if r["short"] else (partner, own))].append(r["cid"])
    met = {(a, b) for key, ones in sides[True].items() for a in ones for b in sides[False].get(key, ()) if a != b}
    matches = sum(len(ones) * len(sides[False].get(key, ())) for key, ones in sides[True].items())
    assert matches < 60 * len(texts)
    assert all((2 * i, 2 * i + 1) in met or (2 * i + 1, 2 * i) in met for i in range(700))
