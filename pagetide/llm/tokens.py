"""Operator 8: token counts, and the word-cached encoders it shares with packing.

Counting runs in ``mapInArrow``: Arrow batches of texts come in, lengths go
out, nothing is shuffled. Inside a task, texts are grouped into work batches of
about ``BATCH_BYTES`` (long texts are cut at safe boundaries first), and each
distinct unit goes through the library once per worker and cache generation.

A cut is safe where no merge of the vocabulary can cross it:

* sentencepiece: before a run of spaces that follows another character (no
  piece holds a space mark after another character; checked on load);
* tokenizers with white-space splitting: at spaces and line feeds, which the
  normalizer and the splitting pattern drop.

Defined cases: null and empty texts have zero bytes and tokens; repeated rows
get the same answer each; null doc_id is carried through; texts of any length
work in bounded memory; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import documents, python_ready, text_or_empty

BATCH_BYTES = 1 << 20
#: Units kept per Python worker and generation.
CACHE_UNITS = 150_000
LIMIT = 4096

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"

_loaded: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitCache(dict):
    """unit -> value, computed on a miss. Two generations bound its size and
    keep what is in use: a full cache becomes the old one, and a hit there
    moves back."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, unit):
        value = self.old.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


class PieceCounter:
    """Token counts of a sentencepiece model, unit by unit.

    A unit is a run of spaces and what follows up to the next space; the model
    puts a space in front of a text, so a text is its units after one space.
    """

    UNIT = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "\u2581"
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if mark in piece.lstrip(mark):
                raise ValueError(f"{path}: piece {piece!r} crosses a space, cutting there is not safe")
        # a lone space after a text is the empty unit; an empty text has no unit
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.cache = UnitCache(lambda u: len(self.model.encode(u)) if u else self.space)

    def units(self, text: str) -> list[str]:
        # the model's own space mark in a text counts as a space
        spaced = " " + text.replace("\u2581", " ")
        if "  " in spaced:
            return [u[1:] for u in self.UNIT.findall(spaced)]
        return spaced.split(" ")[1:]

    def pieces(self, text: str, size: int = BATCH_BYTES) -> Iterator[str]:
        """``text`` cut into parts of about ``size`` characters at safe places."""
        if len(text) > size:
            text = text.replace("\u2581", " ")
        at = 0
        while len(text) - at > size:
            cut = at + size
            while True:
                cut = text.find(" ", cut)
                if cut < 0 or text[cut - 1] != " ":
                    break
                cut += 1
            if cut < 0 or cut + 1 >= len(text):
                break
            yield text[at:cut]
            at = cut + 1  # the model puts this space back
        yield text[at:]

    def counts(self, texts: list[str]) -> list[int]:
        get = self.cache.__getitem__
        return [sum(map(get, self.units(t))) if t else 0 for t in texts]


#: The splitting pattern and the normalizers of the word model: pre-tokens below
#: U+0100 are told apart here as the library does (there NFC changes nothing).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_LETTERS, _NUMBERS, _SPACES = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"


class WordEncoder:
    """Ids of a ``tokenizers`` model that drops white space, as little-endian
    unsigned 32-bit bytes, unit by unit.

    Units of a text in Latin-1 are its lower-case pre-tokens, of which runs of
    letters go to the library's BPE model directly. Other texts, and those that
    may hold a special string, are cut into words: those in Latin-1 are put
    together from pre-tokens, all others take the whole pipeline.
    """

    LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
    PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+").findall
    WIDE = re.compile("[^\x00-\xff]").search

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.bpe = self.model.model
        # the byte-level alphabet: printable bytes stand for themselves, the
        # others for the code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        made = json.loads(self.model.to_str())
        cut, *_ = made["pre_tokenizer"].get("pretokenizers") or [{}]
        lowered = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", ())]
        self.known = cut.get("pattern") == {"Regex": SPLIT} and lowered == NORMALIZERS
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.cache = UnitCache(self.word)

    def plain(self, text: str) -> bool:
        """Whether ``text`` can be cut into pre-tokens here."""
        return self.known and (text.isascii() or not self.WIDE(text)) and not any(s in text for s in self.special)

    def whole(self, word: str) -> bytes:
        return pack_ids(self.model.encode(word, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        if self.LATIN(word) and self.known:
            return pack_ids([t.id for t in self.bpe.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
        if self.plain(word):
            units = self.PRE_TOKENS(word.lower())
            if units != [word]:
                return b"".join(map(self.cache.__getitem__, units))
        return self.whole(word)

    def units(self, text: str) -> list[str]:
        if self.plain(text):
            return self.PRE_TOKENS(text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.cache.__getitem__
        return [b"".join(map(get, self.units(t))) for t in texts]

    def pieces(self, text: str, size: int = BATCH_BYTES) -> Iterator[str]:
        at = 0
        while len(text) - at > size:
            cut = text.find(" ", at + size)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encoder(kind, path: str):
    """One encoder per Python worker and file; workers are reused by Spark."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def work_batches(rows: Iterable[tuple[int, str]], pieces) -> Iterator[list[tuple[int, str]]]:
    """(row, text) pairs regrouped into lists of about BATCH_BYTES characters;
    a long text is spread over several lists."""
    batch, size = [], 0
    for row, text in rows:
        for part in pieces(text):
            batch.append((row, part))
            size += len(part)
            if size >= BATCH_BYTES:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _count_batches(batches, path, model):
    counter = encoder(PieceCounter, path or tokenizer_path(model))
    for b in batches:
        texts = b.column("text")
        totals = [0] * len(texts)
        rows = ((i, texts[i].as_py()) for i in range(len(texts)))
        for work in work_batches(rows, counter.pieces):
            for (i, _), n in zip(work, counter.counts([t for _, t in work])):
                totals[i] += n
        cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
        names = [name for name in b.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(totals, pa.int64())], names=[*names, "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, model: str = PIECE_MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    ``path`` names the model file on the workers; by default ``model`` of the
    installed package of public vocabularies.
    """
    python_ready(docs.sparkSession)
    text = text_or_empty()
    src = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = src.drop("text").schema.add("n_tokens", "long")
    out = src.mapInArrow(lambda batches: _count_batches(batches, path, model), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
