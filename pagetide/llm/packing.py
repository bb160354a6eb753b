"""Operator 10: packing by sum of squares.

Each task packs the documents of its own input split, so ids are never
shuffled: whole windows of a long document are cut off at once, and the rest
goes into the open window whose fill level, once the rest is added, keeps the
sum of squared counts of open windows per level smallest. The counts live in
one level array. When a task ends (or more than ``MAX_OPEN`` windows are
open), the emptiest open windows are poured into the gaps of the fullest, and
what is left over is cut into sequences whose lengths are powers of two, so
that no padding is left.

Defined cases: a null or empty text is the closing id alone; null doc_id is
carried through; repeated rows are separate documents; a document of any
length is cut; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagetide.llm.common import documents, python_ready, releasing, text_or_empty
from pagetide.llm.tokens import WORD_MODEL, WordEncoder, encoder, tokenizer_path, work_batches

WINDOW = 4096
END_ID = 2
#: Bounds what a task holds: at most this many open windows of ids.
MAX_OPEN = 4096
ROWS_OUT = 20_000
BYTES_OUT = 8 << 20  # of ids, where they are given out


class Packer:
    """Packs pieces ``(doc, start, ids)`` of one task; ``emit(seq, pieces)``."""

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.counts = np.zeros(window + 1, np.int64)  # open windows per fill level
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def add(self, doc, ids: bytes) -> None:
        step = 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.emit([(doc, at // 4, ids[at:at + step])])
        if whole < len(ids):
            self.place((doc, whole // 4, ids[whole:]))
        if self.n_open > MAX_OPEN:
            self.drain()

    def place(self, piece) -> None:
        w, size = self.window, len(piece[2]) // 4
        # change of the sum of squares when a window moves from level h to h + size
        fits = w - size
        change = 1 - 2 * self.counts[: fits + 1]
        change[0] = 0  # level 0: a new window
        change[:fits] += 2 * self.counts[size:w] + 1  # level w is full and leaves the count
        change[1:][self.counts[1 : fits + 1] == 0] = np.iinfo(np.int64).max
        h = int(change.argmin())
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self.keep(h + size, pieces)

    def keep(self, level: int, pieces: list) -> None:
        if level == self.window:
            self.emit(pieces)
        else:
            self.open[level].append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def drain(self) -> None:
        """Close every open window without padding."""
        full = [p for level in range(self.window, 0, -1) for p in self.open[level]]
        levels = [level for level in range(self.window, 0, -1) for _ in self.open[level]]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        first, last = 0, len(full) - 1
        while first < last:
            gap = 4 * (self.window - levels[first])
            while gap and first < last:
                doc, start, ids = full[last].pop()
                take = min(gap, len(ids))
                # the front of the piece moves, its rest stays
                full[first].append((doc, start, ids[:take]))
                if take < len(ids):
                    full[last].append((doc, start + take // 4, ids[take:]))
                gap -= take
                levels[first] += take // 4
                levels[last] -= take // 4
                if not full[last]:
                    last -= 1
            if levels[first] == self.window:
                self.emit(full[first])
                first += 1
        if first == last and full[first]:
            self.powers(full[first], levels[first])

    def powers(self, pieces: list, left: int) -> None:
        pieces = pieces[::-1]
        while left:
            room = 4 * (1 << (left.bit_length() - 1))
            left -= room // 4
            out = []
            while room:
                doc, start, ids = pieces.pop()
                out.append((doc, start, ids[:room]))
                if room < len(ids):
                    pieces.append((doc, start + room // 4, ids[room:]))
                room -= min(room, len(ids))
            self.emit(out)


def _pack_batches(batches, path, model, window, end_id, with_ids, schema):
    from pyspark import TaskContext

    enc = encoder(WordEncoder, path or tokenizer_path(model))
    end = np.array([end_id], "<u4").tobytes()
    base = TaskContext.get().partitionId() << 33
    out: list[tuple] = []
    made = held = 0

    def emit(pieces):
        nonlocal made, held
        at = 0
        for (doc_id, total), start, ids in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), total, base + made, at, *([ids] if with_ids else [])))
            at += n
        made += 1
        held += 4 * at if with_ids else 0

    def flush():
        nonlocal held
        held = 0
        cols = list(zip(*out)) or [[] for _ in schema]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    packer = Packer(window, emit)
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        parts: list[bytes] = []
        current = 0

        def close(i):
            whole = b"".join(parts) + end
            parts.clear()
            packer.add((ids[i].as_py(), len(whole) // 4), whole)

        for work in work_batches(((i, texts[i].as_py()) for i in range(len(texts))), enc.pieces):
            for (i, _), encoded in zip(work, enc.encode([t for _, t in work])):
                if i != current:
                    close(current)
                    current = i
                parts.append(encoded)
            if len(out) >= ROWS_OUT or held >= BYTES_OUT:
                yield flush()
        if len(texts):
            close(current)
    packer.drain()
    yield flush()


def pack(
    docs: DataFrame, path: str | None = None, model: str = WORD_MODEL, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian bytes."""
    python_ready(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType([src.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long", False)
    if with_ids:
        schema = schema.add("ids", "binary", False)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return src.mapInArrow(lambda batches: releasing(_pack_batches(batches, path, model, window, end_id, with_ids, arrow)), schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
