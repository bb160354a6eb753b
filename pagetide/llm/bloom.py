"""Bloom filters over 64-bit keys, built by tasks and merged slice by slice.

A join that needs few of a table's wide rows first asks a filter: rows that it
turns down cannot match, so only the others are shuffled. The filter has a fixed
largest size; a fuller one turns down less, and the join behind it stays exact.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import discard, materialize, python_ready

HASHES = 4
BITS_PER_KEY = 10
MAX_BITS = 1 << 27  # 16 MB
SLICE = 1 << 16  # bits
FAN_IN = 16
SLICES = "slice int, blob binary"


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each key; ``bits`` is a power of two."""
    x = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        y = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        step = (y ^ (y >> np.uint64(29))) | np.uint64(1)
        return [((y + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(bits) for i in range(HASHES)]


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in places(keys, len(table) * 8):
        found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def build(keys: DataFrame) -> np.ndarray:
    """The filter of ``keys`` (one long column, no nulls)."""
    python_ready(keys.sparkSession)
    name = keys.columns[0]
    wanted = max(SLICE, BITS_PER_KEY * keys.count())
    bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())

    def fill(batches):
        table = np.zeros(bits, bool)
        for b in batches:
            for at in places(b.column(name).to_numpy(), bits):
                table[at.astype(np.int64)] = True
        yield _slices(np.packbits(table, bitorder="little"))

    def merge(batches):
        table = np.zeros(bits // 8, np.uint8)
        for b in batches:
            _add(table, zip(b.column("slice").to_pylist(), b.column("blob").to_pylist()))
        yield _slices(table)

    tables = materialize(keys.mapInArrow(fill, SLICES), "bloom")
    # FAN_IN tasks' filters become one, until few are left
    while (parts := tables.rdd.getNumPartitions()) > FAN_IN:
        merged = materialize(tables.coalesce(-(-parts // FAN_IN)).mapInArrow(merge, SLICES), "bloom")
        discard(tables)
        tables = merged
    out = np.zeros(bits // 8, np.uint8)
    for row in tables.toLocalIterator():
        _add(out, [(row["slice"], bytes(row["blob"]))])
    discard(tables)
    return out


def _slices(table: np.ndarray) -> pa.RecordBatch:
    """The slices of a filter that hold a bit."""
    rows = table.reshape(-1, SLICE // 8)
    used = np.flatnonzero(rows.any(axis=1))
    pack = zstandard.ZstdCompressor(level=1)
    blobs = [pack.compress(rows[i].tobytes()) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])


def _add(table: np.ndarray, slices) -> None:
    unpack, rows = zstandard.ZstdDecompressor(), table.reshape(-1, SLICE // 8)
    for i, blob in slices:
        rows[i] |= np.frombuffer(unpack.decompress(blob), np.uint8)


def maybe(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` (a long, not null) can be in ``keys``."""
    table = keys.sparkSession.sparkContext.broadcast(build(keys))

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(contains(table.value, x.to_numpy(zero_copy_only=False)))

    return held(key)
