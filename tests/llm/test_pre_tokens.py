"""Texts in Latin-1 are encoded from their pre-tokens: the same ids as the library's, few units kept."""

import random

from pagetide.llm.tokens import WORD_MODEL, WordEncoder, pack_ids, tokenizer_path


def test_pre_tokens_as_the_library():
    enc = WordEncoder(tokenizer_path(WORD_MODEL))
    rng = random.Random(5)
    plain = [chr(i) for i in range(256)] + ["'s", "'LL", "it's", " ", "\n"] * 10
    wide = plain + ["<|endoftext|>", "<|startoftext|>", "İ", "Σ", "é", "K", "—", " ́"]
    texts = ["", " ", "'", "it'S 3.14%%%"] + ["".join(rng.choices(a, k=rng.randint(0, 30))) for a in (plain, wide) for _ in range(3000)]
    assert enc.known
    assert enc.encode(texts) == [pack_ids(x.ids) for x in enc.model.encode_batch(texts, add_special_tokens=False)]


def test_units_of_a_text_are_its_pre_tokens():
    enc = WordEncoder(tokenizer_path(WORD_MODEL))
    enc.whole = None  # no unit of letters takes the whole pipeline
    enc.cache["%%%"] = enc.cache["."] = enc.cache[","] = b""
    enc.encode(["rope rope. Rope, ROPE%%% rope", "Rope"])
    assert set(enc.cache) == {"rope", "%%%", ".", ","}
