"""Operator 9: substring dedup over words with difference-cover anchors.

A window is ``WINDOW`` words. Positions whose residue modulo ``PERIOD`` lies in
the difference cover are anchors, and an anchor's fingerprint covers
``WINDOW - PERIOD + 1`` words: for any two positions some shift below the period
brings both onto cover positions, so two equal windows hold an equal anchor at
the same place inside. Three passes over the chunks:

1. anchors: fingerprints of the corpus that occur twice or more are returned;
2. extension: only windows that hold a returned anchor are hashed in full, and
   those that occur twice or more are returned;
3. marking: words under returned windows are removed.

Fingerprints are 64-bit hashes of the words' 64-bit hashes.

Words are runs without ASCII white space, unchanged. Defined cases: null text
counts as empty; a text of fewer words than a window loses nothing; empty text
keeps the empty string; rows that repeat are documents of their own (so both
lose their windows); null doc_id is carried through; texts of any length are
read whole, one text at a time where it is larger than a chunk; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagetide.llm import chunks as C
from pagetide.llm import hashing as H
from pagetide.llm.common import documents, materialize

WINDOW = 35
# a perfect difference cover: every residue is a difference of two members
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1


def _words(batch):
    data, offsets = H.column_bytes(batch.column("text"))
    hashes, _, _, first = H.words(data, offsets, lower=False)
    return hashes, first


def _anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the anchors that stay inside a text."""
    fingerprints = H.runs(hashes, ANCHOR)
    n = np.diff(first)
    inside = np.arange(len(hashes)) - np.repeat(first[:-1], n)
    room = np.repeat(first[1:], n) - np.arange(len(hashes))
    # an anchor matters only in a text that holds a window
    at = np.flatnonzero(np.isin(inside % PERIOD, COVER) & (room >= ANCHOR) & (np.repeat(n, n) >= WINDOW))
    return at, fingerprints[at]


def _windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of windows by start, and which starts stay inside a text."""
    prints = H.runs(hashes, WINDOW)
    n = np.diff(first)
    room = np.repeat(first[1:], n) - np.arange(len(hashes))
    return prints, room[: len(prints)] >= WINDOW


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of positions in some [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _result_schema(chunks_of: DataFrame, with_text: bool) -> T.StructType:
    schema = T.StructType([chunks_of.schema["doc_id"]]).add("n_words", "long", False).add("n_removed", "long", False)
    schema = schema.add("kept_sha256", "string", False)
    return schema.add("kept_text", "string", False) if with_text else schema


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and kept_text) per row."""
    chunks = C.chunked(docs)
    n = C.buckets(chunks)

    def anchors(chunk, batch):
        return C.packed_rows(chunk, _anchors(*_words(batch))[1], n)

    shared = C.shared_values(C.each_chunk(chunks, anchors, C.PACKED))

    def extend(chunk, batch, table):
        returned = C.joined(table)
        if not len(returned):
            return C.packed_rows(chunk, returned, n)
        hashes, first = _words(batch)
        at, fingerprints = _anchors(hashes, first)
        at = at[C.in_sorted(fingerprints, returned)]
        prints, inside = _windows(hashes, first)
        # windows that hold the anchor start from WINDOW - ANCHOR words before it
        held = _covered(np.maximum(at - (WINDOW - ANCHOR), 0), WINDOW - ANCHOR + 1, len(hashes))[: len(prints)]
        return C.packed_rows(chunk, prints[held & inside], n)

    windows = C.with_returned(chunks, shared, extend, C.PACKED)
    repeated = C.shared_values(windows)
    schema = _result_schema(docs, with_text)

    def mark(chunk, batch, table):
        returned = C.joined(table)
        hashes, first = _words(batch)
        gone = np.zeros(len(hashes), bool)
        if len(returned):
            prints, inside = _windows(hashes, first)
            hit = np.flatnonzero(inside)
            hit = hit[C.in_sorted(prints[hit], returned)]
            gone = _covered(hit, WINDOW, len(hashes))
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = before[first[1:]] - before[first[:-1]]
        digests, texts = [], []
        for i, text in enumerate(batch.column("text")):
            words = text.as_buffer().to_pybytes().split()
            if removed[i]:
                words = compress(words, ~gone[first[i]:first[i + 1]])
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        cols = [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        if with_text:
            cols.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    return C.with_returned(chunks, repeated, mark, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
