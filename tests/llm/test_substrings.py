import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.helpers import documents, edge_rows, ordered, random_texts
from pagetide.llm import chunks, hashing, runindex, substrings


def brute_words(rows):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows):
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (rows[i][0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def fixture():
    rows = [(r[0], r[1] and r[1][:20_000], r[2]) for r in edge_rows()]
    texts = random_texts(11, 80)
    rows += [(100 + i // 2 * (1 + i % 3), t, "a") for i, t in enumerate(texts)]
    return rows + [
        (900, "ab" * 700, "a"), (901, "ab" * 300 + "c" + "ab" * 300, "a"), (902, "a" * 1000, "a"), (903, "z" * 99, "a"), (904, "y" * 100, "a"),
        (907, texts[1] + texts[1], "a"), (0, texts[1], "a"),
    ]


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 5000])
def test_words_match_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    rows = fixture()
    got = substrings.remove_repeats(documents(spark, rows, extra=True)).collect()
    assert ordered(got) == ordered(brute_words(rows))


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 5000])
def test_bytes_match_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    rows = fixture()
    got = runindex.remove_repeats(documents(spark, rows, extra=True).coalesce(1)).collect()
    assert ordered(got) == ordered(brute_bytes(rows))


def test_empty_tables(spark):
    df = documents(spark, edge_rows()).limit(0)
    assert substrings.remove_repeats(df).count() == 0
    assert runindex.remove_repeats(df).count() == 0


def test_cover_holds_every_difference():
    c = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in c for b in c} == set(range(substrings.PERIOD))


def test_pieces_of_a_long_text_give_the_same_anchors(monkeypatch):
    data = np.frombuffer(" ".join(random_texts(12, 30)).encode(), np.uint8)
    offsets = np.array([0, 1000, 1000, 1050, len(data)])
    whole = runindex.anchors(data, offsets)
    monkeypatch.setattr(runindex, "PIECE", 700)
    parts = runindex.anchors(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_run_index_streams_what_sorting_gives():
    rng = np.random.default_rng(3)
    for text in (rng.integers(0, 2, 500), np.tile(rng.integers(0, 4, 30), 20), np.zeros(64), rng.integers(0, 3, 9), np.array([5])):
        text = text.astype(np.uint8)
        raw, n = text.tobytes(), len(text)
        order = sorted(range(n), key=lambda i: raw[i:])
        assert runindex.suffix_order(text)[0].tolist() == order
        ahead, common = runindex.RunIndex(text).stream()
        for before, i in zip(order, order[1:]):
            same = next((k for k in range(n) if raw[i + k:i + k + 1] != raw[before + k:before + k + 1] or i + k >= n), n)
            assert (ahead[i], common[i]) == (before, same)
        assert common[order[0]] == 0
        of = runindex.match_classes(text, 6)
        for i in range(n):
            whole = len(raw[i:i + 6]) == 6
            assert [j for j in range(n) if of[j] == of[i]] == ([j for j in range(n) if raw[j:j + 6] == raw[i:i + 6]] if whole else [i])


def test_a_line_in_every_document_is_compared_string_by_string(spark):
    """A line of 70 bytes in 1,500 texts, more than meet as contexts, with what
    stands around it shared by some of them."""
    rnd = random.Random(8)
    word = lambda k: "".join(rnd.choice("abcdefghij ") for _ in range(k))
    line = word(70)
    around = [word(45) for _ in range(40)]
    rows = [(i, word(rnd.randint(0, 60)) + rnd.choice(around) + line + rnd.choice([word(50), rnd.choice(around)]) + word(rnd.randint(0, 20)), "a") for i in range(1500)]
    rnd.shuffle(rows)
    got = runindex.remove_repeats(documents(spark, rows).repartition(4)).collect()
    want = brute_bytes(sorted(rows))
    assert ordered(got) == ordered(want)
    assert sum(r[2] > 0 for r in want) > 1000


def test_words_of_pieces_hash_alike(monkeypatch):
    rnd = random.Random(4)
    texts = random_texts(5, 40) + ["", "x" * 500, " " * 300, "a b", "y" * 90 + " z"]
    rnd.shuffle(texts)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = hashing.words(data, offsets, lower=True)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for a, b in zip(whole, hashing.words(data, offsets, lower=True)):
            assert (a == b).all()


def test_words_hash_like_their_bytes():
    texts = ["a b\tc", "", "  x  y ", "b", "c a"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    hashes, starts, ends, first = hashing.words(np.frombuffer(data, np.uint8), offsets, lower=False)
    words = [data[s:e] for s, e in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first, first[1:])] == [t.encode().split() for t in texts]
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
