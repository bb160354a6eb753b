import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.helpers import documents, edge_rows, ordered, random_texts
from pagetide.llm import packing, tokens

ALPHABET = " \n\t  abé'.,!ßİſΣσςK中🙂́ 　\x00\x1c\r<s>|▁0123"


def fuzz(n):
    rnd = random.Random(4)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return out + [" ", " a", "a ", "  ", "a  b", "<s> </s><unk>", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΑΣ.", "The, the. THE"]


def test_cached_counts_equal_the_library():
    path = public_tokenizers.path(tokens.PIECE_MODEL)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), tokens.PieceCounter(path)
    for t in fuzz(1500) + random_texts(5, 20):
        n = len(model.encode(t))
        assert own.counts([t]) == [n]
        assert not t or sum(own.counts(list(own.pieces(t, 7)))) == n, t


def test_cached_ids_equal_the_library():
    path = public_tokenizers.path(tokens.WORD_MODEL)
    model, own = Tokenizer.from_file(path), tokens.WordEncoder(path)
    for t in fuzz(1500) + random_texts(6, 20):
        ids = np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode([t]) == [ids]
        assert b"".join(own.encode(list(own.pieces(t, 7)))) == ids, t


def test_cache_generations_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 10)
    cache = tokens.UnitCache(len)
    for i in range(100):
        assert cache[str(i)] == len(str(i))
        assert len(cache) <= 10 and len(cache.old) <= 10


def test_token_counts(spark):
    rows = edge_rows()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.PIECE_MODEL))
    got = tokens.token_counts(documents(spark, rows, extra=True)).collect()
    want = []
    for d, t, _ in rows:
        n = len(model.encode(t or ""))
        want.append((d, len((t or "").encode()), n, n > 4096))
    assert ordered(got) == ordered(want)
    assert tokens.token_counts(documents(spark, rows).limit(0)).count() == 0


def test_packing_is_lossless_gapless_and_tight(spark):
    rows = edge_rows() + [(100 + i, t, "a") for i, t in enumerate(random_texts(7, 40))]
    model = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_MODEL))
    ids = {}
    for d, t, _ in rows:
        if d is not None and d != 5:
            ids[d] = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    out = packing.pack(documents(spark, rows, extra=True), with_ids=True).toPandas()
    for r in out.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, want in ids.items():
        mine = out[out.doc_id == d].sort_values("start")
        assert list(mine.start) == list(np.cumsum(mine.length) - mine.length)
        assert b"".join(mine.ids) == want.tobytes() and set(mine.doc_tokens) == {len(want)}
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length)
        total = g.length.sum()
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packer_places_by_sum_of_squares(seed):
    rnd = random.Random(seed)
    done = []
    p = packing.Packer(64, done.append)
    sent = {}
    for d in range(300):
        ids = np.array([rnd.randrange(1000) for _ in range(rnd.choice([1, 3, 17, 31, 33, 40, 64, 150]))], "<u4").tobytes()
        sent[d] = ids
        p.add(d, ids)
        assert [len(x) for x in p.open] == list(p.counts) and p.n_open == p.counts.sum()
    p.drain()
    back = {}
    for pieces in done:
        n = sum(len(i) // 4 for _, _, i in pieces)
        assert n == 64 or n & (n - 1) == 0
        for d, start, ids in pieces:
            back.setdefault(d, []).append((start, ids))
    assert {d: b"".join(i for _, i in sorted(v)) for d, v in back.items()} == sent
