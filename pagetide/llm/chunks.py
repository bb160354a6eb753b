"""Chunks of documents, and counting of fingerprints across chunks.

The exact-substring operators need each text several times, next to what the
whole corpus knows about it. Both work on *chunks*: some megabytes of
consecutive rows of one input partition, compressed, with an id. A pass over
the chunks sends only fingerprints through the shuffle: per chunk and bucket
one row with a packed array of its distinct 64-bit values (a value that the
chunk holds twice or more is sent twice). A bucket finds the values held twice
or more and returns them to the chunks that sent them. A value that stands
everywhere costs a chunk one entry, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm import hashing as H
from pagetide.llm.common import materialize, python_ready, text_or_empty

CHUNK_BYTES = 2 << 20
#: Buckets per shuffle partition.
FAN_OUT = 4

CHUNK = T.StructType().add("chunk", "long", False).add("blob", "binary", False)
PACKED = T.StructType().add("bucket", "integer", False).add("chunk", "long", False).add("packed", "binary", False)
RETURNED = T.StructType().add("chunk", "long", False).add("packed", "binary", False)


def encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def decode(blob: bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return pa.ipc.open_stream(raw).read_next_batch()


def _cut(batches) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 33
    for b in batches:
        _, offsets = H.column_bytes(b.column("text"))
        for row, end in H.slices(offsets, CHUNK_BYTES):
            # a slice copied on its own: blobs hold only their rows
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(row, end - row)]) for c in b.columns], schema=b.schema)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([encode(part)], pa.binary())], names=["chunk", "blob"])
            chunk += 1


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, blob) of doc_id and text, written to the shared folder once."""
    python_ready(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty().alias("text"))
    return materialize(src.mapInArrow(_cut, CHUNK), "chunks")


def buckets(chunks: DataFrame) -> int:
    return FAN_OUT * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def distinct_twice(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, those that repeat twice."""
    values = np.sort(values)
    if len(values) == 0:
        return values
    first = np.concatenate(([True], values[1:] != values[:-1]))
    second = np.concatenate(([False, False], (values[2:] == values[1:-1]) & (values[1:-1] == values[:-2])))
    # keep the first of a value and the one after it
    return values[first | ~second]


def by_bucket(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted values cut at bucket borders (buckets are ranges of hashes)."""
    borders = (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)
    for bucket, part in enumerate(np.split(values, np.searchsorted(values, borders))):
        if len(part):
            yield bucket, part


def packed_rows(chunk: int, values: np.ndarray, n: int) -> pa.RecordBatch:
    rows = [(b, chunk, p.tobytes()) for b, p in by_bucket(distinct_twice(values), n)]
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "chunk", "packed"]
    )


def _return_shared(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(p, np.uint64) for p in table.column("packed").to_pylist()]
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    chunks, packed = [], []
    for chunk, part in zip(table.column("chunk").to_pylist(), parts):
        mine = np.unique(part)
        mine = mine[in_sorted(mine, shared)]
        if len(mine):
            chunks.append(chunk)
            packed.append(mine.tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(packed, pa.binary())})


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``table``."""
    if len(table) == 0 or len(values) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def shared_values(packed: DataFrame) -> DataFrame:
    """(chunk, packed): of each chunk's values, those that the corpus holds
    twice or more."""
    return packed.groupBy("bucket").applyInArrow(_return_shared, RETURNED)


def joined(table: pa.Table) -> np.ndarray:
    """All packed values of a chunk, sorted."""
    parts = [np.frombuffer(p, np.uint64) for p in table.column("packed").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def with_returned(chunks: DataFrame, returned: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``function(chunk, batch, table)`` on every chunk and what came back to it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [
            function(chunk, decode(blob), right)
            for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist())
        ]
        if not out:
            from pyspark.sql.pandas.types import to_arrow_schema

            return to_arrow_schema(schema).empty_table()
        return pa.Table.from_batches(out)

    return chunks.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(both, schema)


def each_chunk(chunks: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``function(chunk, batch)`` on every chunk, without a shuffle."""

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                yield function(chunk, decode(blob.as_buffer()))

    return chunks.mapInArrow(run, schema)
