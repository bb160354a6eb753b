"""Operator 6: byte-level repeat removal with a run-length index.

A string of ``LENGTH`` bytes holds at least one *anchor*: a position whose
``K``-byte fingerprint is smallest among those of some string of that length.
Equal strings have their anchors at the same places inside, so:

1. chunks send the fingerprints of their anchors with how often they hold them,
   and get back those that the corpus holds twice or more (``chunks``), the ones
   held more than ``HOT`` times marked;
2. for each returned anchor, chunks send its *context* (all bytes of the strings
   that hold it), once per distinct context and chunk, to the fingerprint's
   bucket;
3. a bucket decides which strings start earlier elsewhere. Where all contexts of
   an anchor are equal, the first keeps everything. The others are indexed: the
   distinct contexts are concatenated and the Burrows-Wheeler transform of the
   suffix order is run-compressed. Of the order only samples at the run ends are
   kept (a run's first text position, the position before it in suffix order, and
   their common prefix). Along the text the matching statistics are streamed from
   these samples: between two of them the position before moves on by one per byte
   and the matching length falls by one. Positions that match the one before over
   ``LENGTH`` bytes are linked to it; the links make classes of equal strings, and
   all but the first string of a class go;
4. the strings that hold a marked anchor (a line that stands in millions of texts)
   are sent one by one instead, the first of a chunk only, as 128-bit hash and
   place, to the hash's bucket: only equal strings meet, one entry a chunk;
5. chunks mark the bytes under the strings that go, and drop them.

Contexts are compared byte by byte; fingerprints only route and preselect. Strings
of step 4 are equal when their 128-bit hashes are.

The order of "earlier" is doc_id (null last), then the place of the row in the
input, then the byte position. Defined cases: null text counts as empty; empty
and shorter texts lose nothing; rows that repeat: all but the first lose the
text (if it has ``LENGTH`` bytes); an empty table gives no rows; extra columns
are ignored. ``doc_id`` must be an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm import chunks as C
from pagetide.llm import hashing as H
from pagetide.llm.common import documents

LENGTH = 100
K = 40
SPAN = LENGTH - K + 1  # fingerprints in a string
SEPARATOR = 0xFF  # no byte of UTF-8 text
MASK_BYTES = (SPAN + 7) // 8
RECORD = np.dtype([("at", "<i8"), ("mask", "u1", MASK_BYTES)])
PIECE = 1 << 19  # bytes hashed at a time
INDEX_BYTES = 1 << 18  # contexts indexed at a time, one anchor's at least (HOT contexts at most)
HOT = 1024  # occurrences up to which an anchor's contexts meet
FINER = 4  # buckets of contexts per bucket of fingerprints

COUNTED = np.dtype([("print", "<u8"), ("n", "<u4")])
STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("null", "u1"), ("number", "<i8"), ("row", "<i4"), ("start", "<i4"), ("at", "<i4")])
CODE_2 = np.random.default_rng(20260301).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

SENT = T.StructType().add("bucket", "integer", False).add("chunk", "long", False).add("blob", "binary", False)
MARKS = T.StructType().add("chunk", "long", False).add("kind", "integer", False).add("packed", "binary", False)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``data`` of all anchors of all texts, and fingerprints."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 2 * PIECE:  # pieces that overlap by all that an anchor depends on bound the memory
        found = []
        for lo in range(0, n, PIECE):
            a, b = max(0, lo - LENGTH), min(n, lo + PIECE + LENGTH)
            at, prints = anchors(data[a:b], np.clip(offsets, a, b) - a)
            mine = (at + a >= lo) & (at + a < lo + PIECE)
            found.append((at[mine] + a, prints[mine]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    prefix = H.prefix_hash(H.BYTE_CODE[data])
    starts = np.arange(n - K + 1)
    prints = H.mix(H.window_hash(prefix, starts, starts + K)) | np.uint64(1)
    low = _slide(prints, SPAN, np.minimum)  # of the string that starts here
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(low)] - np.arange(len(low))
    low[room < LENGTH] = 0  # no string of its own text starts here
    pad = np.zeros(SPAN - 1, np.uint64)
    high = _slide(np.concatenate((pad, low, pad)), SPAN, np.maximum)  # over the strings that hold a position
    at = np.flatnonzero(high[: len(prints)] == prints)
    return at, prints[at]


def counted(chunk: int, batch, n: int) -> pa.RecordBatch:
    """Packed rows of a chunk's fingerprints and how often it holds them."""
    prints, times = np.unique(anchors(*H.column_bytes(batch.column("text")))[1], return_counts=True)
    both = np.empty(len(prints), COUNTED)
    both["print"], both["n"] = prints, times
    borders = np.searchsorted(prints, (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64))
    rows = [(i, chunk, part.tobytes()) for i, part in enumerate(np.split(both, borders)) if len(part)]
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "packed"])


def _return_marked(table: pa.Table) -> pa.Table:
    """Of each chunk's fingerprints those held twice or more; the last bit, which
    is set in a fingerprint, is cleared where it is held more than HOT times."""
    parts = [np.frombuffer(p, COUNTED) for p in table.column("packed").to_pylist()]
    every = np.concatenate([p["print"] for p in parts])
    order = np.argsort(every, kind="stable")
    values, first = np.unique(every[order], return_index=True)
    total = np.add.reduceat(np.concatenate([p["n"] for p in parts])[order].astype(np.int64), first)
    del every, order
    marked = values & ~(total > HOT).astype(np.uint64)
    values, marked = values[total > 1], marked[total > 1]
    chunks, packed = [], []
    for chunk, part in zip(table.column("chunk").to_pylist(), parts):
        mine = part["print"][C.in_sorted(part["print"], values)]
        if len(mine):
            chunks.append(chunk)
            packed.append(marked[np.searchsorted(values, mine)].tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(packed, pa.binary())})


class Contexts:
    """The returned anchors of a chunk: distinct contexts, first ones first, and
    the strings that hold a marked anchor."""

    def __init__(self, batch, returned: np.ndarray):
        self.data, self.offsets = H.column_bytes(batch.column("text"))
        at, prints = anchors(self.data, self.offsets)
        hot = np.sort(returned[returned & np.uint64(1) == 0] | np.uint64(1))
        keep = C.in_sorted(prints, np.sort(returned[returned & np.uint64(1) == 1]))
        hot_at = np.sort(at[C.in_sorted(prints, hot)])
        at, prints = at[keep], prints[keep]
        row = np.searchsorted(self.offsets, at, side="right") - 1
        ids = batch.column("doc_id").cast(pa.int64())
        null = np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((at, row, number[row], null[row]))
        self.at, self.prints, self.row = at[order], prints[order], row[order]
        self.number, self.null = number, null
        self.start = np.maximum(self.at - (LENGTH - K), self.offsets[self.row])
        self.stop = np.minimum(self.at + LENGTH, self.offsets[self.row + 1])
        raw = self.data.tobytes()
        first: dict = {}
        self.first = np.zeros(len(self.at), bool)
        for i, (a, s, e) in enumerate(zip(self.at.tolist(), self.start.tolist(), self.stop.tolist())):
            key = (raw[s:e], a - s)
            if key not in first:
                first[key] = i
                self.first[i] = True
        self.raw = raw
        self._strings(hot_at)

    def _strings(self, hot_at: np.ndarray) -> None:
        """``strings``: the first one of each in the chunk; ``again``: where the
        others start."""
        if not len(hot_at):
            self.strings, self.again = np.zeros(0, STRING), np.zeros(0, np.int64)
            return
        row = np.searchsorted(self.offsets, hot_at, side="right") - 1
        edge = np.zeros(len(self.data) + 2, np.int64)
        low = np.maximum(hot_at - (LENGTH - K), self.offsets[row])
        high = np.minimum(hot_at, self.offsets[row + 1] - LENGTH) + 1
        some = high > low
        np.add.at(edge, low[some], 1)
        np.add.at(edge, high[some], -1)
        starts = np.flatnonzero(np.cumsum(edge[: len(self.data)]) > 0)
        # only the bytes of these strings are hashed
        edge[:] = 0
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + LENGTH, -1)
        covered = np.cumsum(edge[: len(self.data)]) > 0
        held, moved = self.data[covered], (np.cumsum(covered) - 1)[starts]
        hashes = []
        for codes in (H.BYTE_CODE, CODE_2):
            prefix = H.prefix_hash(codes[held])
            hashes.append(H.mix(H.window_hash(prefix, moved, moved + LENGTH)))
        row = np.searchsorted(self.offsets, starts, side="right") - 1
        out = np.empty(len(starts), STRING)
        out["h1"], out["h2"], out["null"], out["number"] = *hashes, self.null[row], self.number[row]
        out["row"], out["start"], out["at"] = row, starts - self.offsets[row], starts
        out = out[np.lexsort((out["start"], out["row"], out["number"], out["null"], out["h2"], out["h1"]))]
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out["h1"][1:] != out["h1"][:-1]) | (out["h2"][1:] != out["h2"][:-1])
        self.strings, self.again = out[fresh], out["at"][~fresh].astype(np.int64)


def _send(chunk: int, batch, returned: np.ndarray, n: int) -> pa.RecordBatch:
    rows = []
    if len(returned):
        c = Contexts(batch, returned)
        pick = np.flatnonzero(c.first)
        pick = pick[np.argsort(c.prints[pick], kind="stable")]
        borders = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
        pack = zstandard.ZstdCompressor(level=1)
        for bucket, part in enumerate(np.split(pick, np.searchsorted(c.prints[pick], borders))):
            if len(part):
                head = np.empty((len(part), 8), np.int64)
                r = c.row[part]
                head[:, 0] = c.prints[part].view(np.int64)
                head[:, 1], head[:, 2], head[:, 3] = c.null[r], c.number[r], r
                head[:, 4] = c.start[part] - c.offsets[r]
                head[:, 5] = c.stop[part] - c.start[part]
                head[:, 6] = c.at[part]
                head[:, 7] = c.at[part] - c.start[part]
                body = b"".join(c.raw[s:e] for s, e in zip(c.start[part].tolist(), c.stop[part].tolist()))
                blob = len(part).to_bytes(8, "little") + np.ascontiguousarray(head.T).tobytes() + body
                rows.append((bucket, chunk, pack.compress(blob)))
        # strings around marked anchors have buckets of their own, by their hash
        for bucket, part in enumerate(np.split(c.strings, np.searchsorted(c.strings["h1"], borders))):
            if len(part):
                rows.append((n + bucket, chunk, pack.compress(part.tobytes())))
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "blob"]
    )


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by doubling, and the ranks by the first 7, 14, ... bytes.

    Bytes count from 1 and the end as 0, so a suffix is smaller than any that
    it begins, whatever bytes it ends with."""
    n = len(text)
    wide = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | wide[i:i + n]
    levels, depth = [], 7
    while True:
        order = np.argsort(key)  # what ties is told apart by a later round
        ordered = key[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh)  # from 1; 0 stands for the end
        levels.append((depth, rank))
        if fresh.all():
            return order, levels
        ahead = np.zeros(n, np.int32)
        if depth < n:
            ahead[:-depth] = rank[depth:]
        key = rank.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)
        depth *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, levels) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes a[i] and b[i]."""
    n = len(text)
    length = np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    for depth, rank in reversed(levels):
        live = (a + depth <= n) & (b + depth <= n)
        same = live & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        length[same] += depth
        a[same] += depth
        b[same] += depth
    for _ in range(6):
        live = (a < n) & (b < n)
        same = live & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        if not same.any():
            break
        # positions that differ stay where they are, and go on differing
        length[same] += 1
        a[same] += 1
        b[same] += 1
    return length


class RunIndex:
    """The run-compressed transform of a text: per run its first text position,
    the position before it in suffix order, and their common prefix."""

    def __init__(self, text: np.ndarray):
        self.length = len(text)
        order, levels = suffix_order(text)
        before = text[order - 1]  # the transform; the text's end wraps around
        run = np.concatenate(([True], before[1:] != before[:-1]))
        run[order == 0] = True
        after_first = np.flatnonzero(order == 0) + 1
        run[after_first[after_first < len(run)]] = True
        sampled = np.flatnonzero(run)[1:]  # the first suffix has none before it
        at, ahead = order[sampled], order[sampled - 1]
        prefix = common_prefix(text, at, ahead, levels)
        at, ahead, prefix = np.append(at, order[0]), np.append(ahead, order[0]), np.append(prefix, 0)
        by_text = np.argsort(at, kind="stable")
        self.at, self.ahead, self.prefix = at[by_text], ahead[by_text], prefix[by_text]

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics along the text: for each position the one before it
        in suffix order, and how many bytes both have in common."""
        where = np.arange(self.length)
        sample = np.searchsorted(self.at, where, side="right") - 1
        past = where - self.at[sample]
        return self.ahead[sample] + past, np.maximum(self.prefix[sample] - past, 0)


def match_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each position one that stands for all that agree with it on ``length``
    bytes."""
    ahead, common = RunIndex(text).stream()
    to = np.where(common >= length, ahead, np.arange(len(text)))
    while True:  # follow the links, twice as far each time
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _index(several, body, end, size, start, text_rank, masks) -> None:
    """Mark in ``masks`` the strings of these contexts that start earlier in
    another one."""
    parts = [np.frombuffer(body, np.uint8, size[i], end[i] - size[i]) for i in several]
    gap = np.array([SEPARATOR], np.uint8)
    text = np.concatenate([x for p in parts for x in (p, gap)])
    lengths = size[several] + 1
    offset = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(several)), lengths)
    inside = np.arange(len(text)) - offset[owner]
    valid = inside + LENGTH <= size[several][owner]
    place = (text_rank[several][owner] << 40) + start[several][owner] + inside
    place[~valid] = np.iinfo(np.int64).max
    of = match_classes(text, LENGTH)
    low = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(low, of, place)
    gone = np.flatnonzero(valid & (place > low[of]))
    masks[several[owner[gone]], inside[gone]] = True


def _decide_strings(table: pa.Table) -> pa.Table:
    """Which strings around marked anchors start earlier in another chunk."""
    unpack = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpack.decompress(b), STRING) for b in table.column("blob").to_pylist()]
    chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int64), [len(p) for p in parts])
    every = np.concatenate(parts)
    del parts
    order = np.lexsort((every["start"], every["row"], chunk, every["number"], every["null"], every["h2"], every["h1"]))
    h1, h2 = every["h1"][order], every["h2"][order]
    gone = order[1:][(h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]
    out_chunk = np.unique(chunk[gone])
    out = [every["at"][gone[chunk[gone] == c]].astype(np.int64).tobytes() for c in out_chunk]
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "kind": pa.array([2] * len(out), pa.int32()), "packed": pa.array(out, pa.binary())})


def _decide(table: pa.Table) -> pa.Table:
    """Which strings of a bucket's contexts start earlier elsewhere."""
    unpack = zstandard.ZstdDecompressor()
    heads, bodies, chunk_of = [], [], []
    for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()):
        raw = unpack.decompress(blob)
        m = int.from_bytes(raw[:8], "little")
        heads.append(np.frombuffer(raw, np.int64, 8 * m, 8).reshape(8, m))
        bodies.append(raw[8 + 64 * m:])
        chunk_of.append(np.full(m, chunk))
    prints, null, number, row, start, size, at, shift = np.concatenate(heads, axis=1)
    chunk = np.concatenate(chunk_of)
    body = b"".join(bodies)
    end = np.cumsum(size)
    # order of the texts, then of the contexts in a text
    order = np.lexsort((at, start, row, chunk, number, null))
    text_key = np.stack([null, number, chunk, row])[:, order]
    new_text = np.concatenate(([True], (text_key[:, 1:] != text_key[:, :-1]).any(axis=0)))
    text_rank = np.empty(len(order), np.int64)
    text_rank[order] = np.cumsum(new_text)

    masks = np.zeros((len(order), SPAN), bool)
    first: dict = {}
    groups: dict = {}
    for i in order.tolist():
        key = (int(prints[i]), body[end[i] - size[i]:end[i]], int(shift[i]))
        if key in first:
            masks[i] = True  # the same strings, all of them later
        else:
            first[key] = i
            groups.setdefault(key[0], []).append(i)
    # strings are compared within their anchor's group, so groups are indexed
    # some at a time
    some: list[int] = []
    held = 0
    for group in groups.values():
        if len(group) > 1:
            some += group
            held += int(size[group].sum())
            if held >= INDEX_BYTES:
                _index(np.array(some), body, end, size, start, text_rank, masks)
                some, held = [], 0
    if some:
        _index(np.array(some), body, end, size, start, text_rank, masks)
    hit = np.flatnonzero(masks.any(axis=1))
    bits = np.packbits(masks[hit], axis=1)
    out_chunk, out = [], []
    for c in np.unique(chunk[hit]):
        mine = chunk[hit] == c
        record = np.empty(int(mine.sum()), RECORD)
        record["at"], record["mask"] = at[hit][mine], bits[mine]
        out_chunk.append(int(c))
        out.append(record.tobytes())
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "kind": pa.array([1] * len(out), pa.int32()), "packed": pa.array(out, pa.binary())})


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text: the
    remaining bytes) per row."""
    chunks = C.chunked(docs)
    n = C.buckets(chunks)

    packed = C.each_chunk(chunks, lambda chunk, batch: counted(chunk, batch, n), C.PACKED)
    shared = C.materialize(packed.groupBy("bucket").applyInArrow(_return_marked, C.RETURNED), "anchors-shared")
    finer = FINER * n
    sent = C.with_returned(chunks, shared, lambda chunk, batch, table: _send(chunk, batch, C.joined(table), finer), SENT)
    decide = lambda table: (_decide if table.column("bucket")[0].as_py() < finer else _decide_strings)(table)
    decided = sent.groupBy("bucket").applyInArrow(decide, MARKS)
    back = decided.union(shared.select("chunk", F.lit(0).alias("kind"), "packed"))

    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long", False).add("n_removed", "long", False)
    schema = schema.add("n_spans", "long", False).add("kept_sha256", "string", False)
    if with_text:
        schema = schema.add("kept_text", "binary", False)

    def mark(chunk, batch, table):
        kind = np.asarray(table.column("kind").to_pylist(), int)
        packed = table.column("packed").to_pylist()
        returned = [np.frombuffer(p, np.uint64) for p, k in zip(packed, kind) if k == 0]
        data, offsets = H.column_bytes(batch.column("text"))
        gone = np.zeros(len(data), bool)
        if returned:
            c = Contexts(batch, np.sort(np.concatenate(returned)))
            edge = np.zeros(len(data) + 1, np.int64)
            again = ~c.first & (c.stop - c.start >= LENGTH)
            np.add.at(edge, c.start[again], 1)
            np.add.at(edge, c.stop[again], -1)
            records = [np.frombuffer(p, RECORD) for p, k in zip(packed, kind) if k == 1]
            if records:
                records = np.concatenate(records)
                by_at = np.argsort(c.at, kind="stable")
                i = by_at[np.searchsorted(c.at[by_at], records["at"])]
                mask = np.unpackbits(records["mask"], axis=1)[:, :SPAN].astype(bool)
                which, where = np.nonzero(mask)
                s = c.start[i[which]] + where
                s = s[s + LENGTH <= c.stop[i[which]]]
                np.add.at(edge, s, 1)
                np.add.at(edge, s + LENGTH, -1)
            strings = [c.again, *[np.frombuffer(p, np.int64) for p, k in zip(packed, kind) if k == 2]]
            strings = np.concatenate(strings)
            np.add.at(edge, strings, 1)
            np.add.at(edge, strings + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        opens[inner] = gone[inner]  # runs end with their text
        spans = np.concatenate(([0], np.cumsum(opens)))
        removed = before[offsets[1:]] - before[offsets[:-1]]
        digests, texts = [], []
        for i in range(len(removed)):
            kept = data[offsets[i]:offsets[i + 1]]
            if removed[i]:
                kept = kept[~gone[offsets[i]:offsets[i + 1]]]
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            if with_text:
                texts.append(kept.tobytes())
        cols = [
            batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()), pa.array(digests, pa.string()),
        ]
        if with_text:
            cols.append(pa.array(texts, pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    return C.with_returned(chunks, back, mark, schema)


def op6_run_index(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
