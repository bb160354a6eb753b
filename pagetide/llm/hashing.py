"""Vectorised word and shingle hashing over Arrow string columns (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

with np.errstate(over="ignore"):
    _rng = np.random.default_rng(20240501)
    BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = 1 << max(20, (n - 1).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if size <= 1 << 23:  # a huge text's table is not kept
            _powers[name] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a null-free Arrow string (or binary) column."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = BASE**i times the hash of codes[i:j] (mod 2**64)."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_table("up", BASE, max(1, len(codes)))[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the codes stand."""
    down = _power_table("down", BASE_INVERSE, max(1, len(prefix)))
    return (prefix[ends] - prefix[starts]) * down[starts]


PIECE = 1 << 20  # bytes hashed at a time


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Where ``data`` can be cut into pieces of about ``PIECE`` bytes: between
    texts and at white space (a longer word stays whole)."""
    cuts, at = [0], 0
    while len(data) - at > PIECE:
        ends = offsets[(offsets > at) & (offsets <= at + PIECE)]
        spaces = np.flatnonzero(_SPACE[data[at:at + PIECE]])
        best = max(int(ends[-1]) if len(ends) else 0, at + int(spaces[-1]) if len(spaces) else 0)
        if best <= at:  # inside a long word
            rest = np.flatnonzero(_SPACE[data[at + PIECE:]])
            after = offsets[offsets > at + PIECE]
            best = min(at + PIECE + int(rest[0]) if len(rest) else len(data), int(after[0]) if len(after) else len(data))
        cuts.append(best)
        at = best
    return [*cuts, len(data)] if cuts[-1] < len(data) or len(cuts) == 1 else cuts


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of consecutive texts.

    Returns word hashes, their byte starts and ends in ``data``, and for each
    text the index of its first word (one entry more than texts).
    """
    if len(data) > 2 * PIECE:  # bounds the memory, whatever a text's length
        cuts = _cuts(data, offsets)
        parts = [_words(data[a:b], np.unique(np.clip(offsets, a, b)) - a, lower) for a, b in zip(cuts, cuts[1:])]
        hashes = np.concatenate([p[0] for p in parts])
        starts, ends = (np.concatenate([p[k] + a for p, a in zip(parts, cuts)]) for k in (1, 2))
        return hashes, starts, ends, np.searchsorted(starts, offsets)
    return _words(data, offsets, lower)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]  # a text's first byte starts a word
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    prefix = prefix_hash(BYTE_CODE[data])
    hashes = mix(window_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive items (width at most 64)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * MULTIPLIERS[k]
    return mix(total)
