"""Operator 11: conversation prefix trie with count-min screening.

A conversation's prefix of d turns is a node of the trie at depth d; equal
prefixes are one node. Texts stay where they are: a turn becomes a 128-bit digest
of its role and text and its text's bytes. A prefix is the exclusive or of its
turns' 2 x 64-bit hashes of (depth, digest), so prefixes of all depths come from
running aggregates.

1. Turns get their places by ``rank.positions``: a conversation of any length is
   sorted in many tasks. Conversations are rebuilt (the first h turns of the
   family's head, then their own).
2. Prefix hashes come from windows over ``STRETCH`` depths of a conversation; a
   longer one carries the totals of the stretches before.
3. A count-min sketch of all prefixes, ``ROWS`` rows of counters that stop at 2,
   is built per task and merged slice by slice in two rounds. Only "2 or more"
   is broadcast: one bit a counter, ``MAX_CELLS`` counters a row at most. An
   estimate of 1 proves a singleton: such a node is emitted where it stands, as
   its members, children, leaves and subtree are its conversation's tail.
4. All other prefixes are grouped exactly, with partial aggregation. A node's
   representative is its smallest member, and every ancestor of a node has this
   member too, so sums over subtrees are sums over members of sums along a
   conversation: a leaf counts 1 and a node its saved bytes at its representative,
   suffix sums along the conversation bring them to all its prefixes, and one more
   grouping adds them up. No step per depth.
5. Members that end at a node are sorted by range, written as pieces of text, and
   hashed piece by piece: SHA-256 is sequential, so the pieces of one node pass
   through one task as a stream.

Equal prefixes are those with equal 128-bit hashes. Beyond some ``MAX_CELLS``
prefixes the sketch screens less and more prefixes are grouped exactly; the
result is the same.

Defined cases: rows with a null conv_id belong to no conversation; null turns
come first; turns that tie go by role, then by digest; repeated rows are turns of
their own; null roles and texts are empty; a family's head is c - c % 5, the
remainder with the sign of c; texts are hashed whole, of any length; an empty
table has no node, not even a root; extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, python_ready
from pagetide.operators.rank import positions

FAMILY = 5
HEAD = 8  # the most turns that a head gives
STRETCH = 4096
ROWS = 3
CELLS_PER_PREFIX = 4
MAX_CELLS = 1 << 25
SLICE = 1 << 16
PIECE = 1000  # ids in a piece of a list of members
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

STATS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and bytes of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _item(salt: int, depth: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(salt), depth.cast("long"), digest)


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """The conversations (c, length) and their rebuilt turns (c, d, xa, xb,
    bytes); ``crc32(c) % heads`` turns come from the family's head."""
    ranked = positions(turns(conversations), ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")])
    ranked = materialize(ranked.select("conv_id", "pos", "digest", "bytes"), "trie-turns")
    first = F.when((F.col("pos") < heads) & (F.col("conv_id") % family == 0), F.struct("pos", "digest", "bytes"))
    convs = ranked.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("head"))
    convs = materialize(convs, "trie-convs")
    head = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.col("head").alias("given"))
    convs = convs.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % family).join(head, "head_id", "left")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    given = F.filter(F.coalesce("given", F.col("head")), lambda x: x["pos"] <= F.col("h"))
    # a family without its head gives none (only the head's own row holds turns)
    convs = convs.withColumn("h", h).withColumn("given", given).withColumn("k", F.size("given").cast("long"))
    convs = convs.select("conv_id", "h", "given", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "trie-rebuilt")
    own = ranked.join(convs.select("conv_id", "h", "k"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "digest", "bytes")
    given = convs.select("conv_id", F.inline("given")).select("conv_id", F.col("pos").alias("d"), "digest", "bytes")
    every = own.unionByName(given).select(
        F.col("conv_id").alias("c"), "d", _item(1, F.col("d"), F.col("digest")).alias("xa"), _item(2, F.col("d"), F.col("digest")).alias("xb"), "bytes"
    )
    return convs.select(F.col("conv_id").alias("c"), "length"), every


def running(df: DataFrame, values: dict[str, Column], combine, plus, backwards: bool = False) -> DataFrame:
    """``df`` (c, d, ...) with running aggregates of ``values`` along d (with
    ``backwards`` from the largest d on), rows of equal d together; ``plus`` adds
    two aggregates. Windows hold ``STRETCH`` depths at most."""
    df = df.select("*", *[v.alias(f"_{k}") for k, v in values.items()]).withColumn("stretch", F.floor(F.col("d") / STRETCH))
    way = F.desc if backwards else F.asc
    along = Window.partitionBy("c", "stretch").orderBy(way("d")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[combine(F.col(f"_{k}")).over(along).alias(k) for k in values]).drop(*[f"_{k}" for k in values])
    # conversations of several stretches: what the stretches before give
    long = df.filter("stretch > 0").select("c").distinct()
    totals = df.join(long, "c", "left_semi").groupBy("c", "stretch").agg(*[combine(F.col(f"_{k}")).alias(k) for k in values])
    before = Window.partitionBy("c").orderBy(way("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("c", "stretch", *[combine(F.col(k)).over(before).alias(f"_{k}") for k in values])
    carry = materialize(carry, "trie-carry")
    joined = local.join(carry, ["c", "stretch"], "left")
    done = {k: plus(F.col(k), F.coalesce(f"_{k}", F.lit(0).cast("long"))) for k in values}
    return joined.withColumns(done).drop("stretch", *[f"_{k}" for k in values])


def paths(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: c, d, its hash (pa, pb), its
    parent's (qa, qb), the bytes of its last turn, and whether c ends there."""
    convs, every = rebuilt(conversations)
    run = running(every, {"pa": F.col("xa"), "pb": F.col("xb")}, F.bit_xor, Column.bitwiseXOR).join(convs, "c")
    deep = run.select(
        "c", "d", "pa", "pb", F.col("pa").bitwiseXOR(F.col("xa")).alias("qa"), F.col("pb").bitwiseXOR(F.col("xb")).alias("qb"), "bytes",
        (F.col("d") == F.col("length")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    root = convs.select(
        "c", *[zero.alias(x) for x in ("d", "pa", "pb", "qa", "qb", "bytes")], (F.col("length") == 0).alias("ends")
    )
    return materialize(deep.unionByName(root), "trie-paths")


# ---- count-min screening -----------------------------------------------------


def cells(pa_: np.ndarray, pb: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each prefix in each row of the sketch."""
    a, b = pa_.view(np.uint64), pb.view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((a + np.uint64(j) * b) % np.uint64(width)).astype(np.int64) for j in range(ROWS)]


class Sketch:
    """Counters that stop at 2, as two bits: one or more, two or more."""

    def __init__(self, width: int):
        self.width = width
        self.count = np.zeros((ROWS, width), np.uint8)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for row, at in zip(self.count, cells(a, b, self.width)):
            at, n = np.unique(at, return_counts=True)
            row[at] = np.minimum(row[at] + np.minimum(n, 2), 2)

    def slices(self):
        flat = self.count.reshape(-1, min(SLICE, self.width))
        for i in np.flatnonzero(flat.any(axis=1)):
            yield int(i), np.packbits(flat[i] > 0).tobytes() + np.packbits(flat[i] > 1).tobytes()


def merge_slices(blobs: list[bytes]) -> bytes:
    once = np.zeros(len(blobs[0]) // 2, np.uint8)
    twice = once.copy()
    for blob in blobs:
        one, two = np.frombuffer(blob, np.uint8).reshape(2, -1)
        twice |= two | (once & one)
        once |= one
    return once.tobytes() + twice.tobytes()


def count_min(prefixes: DataFrame, width: int) -> np.ndarray:
    """Bits (rows x width): counters that are 2 or more."""
    pack, unpack = (lambda b: zstandard.ZstdCompressor(level=1).compress(b)), (lambda b: zstandard.ZstdDecompressor().decompress(b))

    def build(batches):
        from pyspark import TaskContext

        sketch, task = Sketch(width), TaskContext.get().partitionId()
        for b in batches:
            sketch.add(b.column("pa").to_numpy(), b.column("pb").to_numpy())
        found = list(sketch.slices())
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in found], pa.int32()), pa.array([task] * len(found), pa.int32()), pa.array([pack(b) for _, b in found], pa.binary())],
            names=["slice", "task", "blob"],
        )

    def merge(table: pa.Table) -> pa.Table:
        done = merge_slices([unpack(b) for b in table.column("blob").to_pylist()])
        return pa.table({"slice": table.column("slice")[:1], "blob": pa.array([pack(done)], pa.binary())})

    built = materialize(prefixes.mapInArrow(build, "slice int, task int, blob binary"), "trie-sketches")
    tasks = (built.agg(F.max("task")).first()[0] or 0) + 1
    fan = max(1, round(tasks**0.5))  # a group merges so many sketches at most
    some = built.withColumn("task", F.col("task") % fan).groupBy("slice", "task").applyInArrow(merge, "slice int, blob binary")
    merged = some.groupBy("slice").applyInArrow(merge, "slice int, blob binary")
    step = min(SLICE, width)
    bits = np.zeros((ROWS * width // step, step // 8), np.uint8)
    for row in merged.toLocalIterator():  # ROWS * width bits in all
        bits[row["slice"]] = np.frombuffer(unpack(bytes(row["blob"])), np.uint8).reshape(2, -1)[1]
    return bits.reshape(ROWS, width // 8)


def estimate_is_one(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Prefixes that some counter proves to be of one conversation."""
    one = np.zeros(len(a), bool)
    for row, at in zip(bits, cells(a, b, bits.shape[1] * 8)):
        one |= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
    return one


def screened(prefixes: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``prefixes`` with ``shared`` (false: a singleton for sure) and
    ``parent_shared``; the root is always shared."""
    python_ready(prefixes.sparkSession)
    wanted = CELLS_PER_PREFIX * max(1, prefixes.count())
    width = min(max_cells, max(8, 1 << (wanted - 1).bit_length()))
    bits = prefixes.sparkSession.sparkContext.broadcast(count_min(prefixes.filter("d > 0").select("pa", "pb"), width))

    def screen(batches):
        for b in batches:
            d = b.column("d").to_numpy()
            own, up = (~estimate_is_one(bits.value, b.column(x).to_numpy(), b.column(y).to_numpy()) for x, y in (("pa", "pb"), ("qa", "qb")))
            cols = [*b.columns, pa.array(own | (d == 0)), pa.array(up | (d == 1))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "shared", "parent_shared"])

    schema = T.StructType(list(prefixes.schema.fields)).add("shared", "boolean").add("parent_shared", "boolean")
    return materialize(prefixes.mapInArrow(screen, schema), "trie-screened")


# ---- members that end at a node ----------------------------------------------


def _pieces(batches):
    """Runs of ids of one node, ``PIECE`` at most, as text."""
    for b in batches:
        a, p, c = (b.column(x).to_numpy() for x in ("pa", "pb", "c"))
        if not len(c):
            continue
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))
        starts = np.flatnonzero(new)
        starts = np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, np.append(starts[1:], len(c)))])
        texts = [",".join(map(str, part.tolist())) for part in np.split(c, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(p[starts]), pa.array(c[starts]), pa.array(texts)], names=["pa", "pb", "first", "ids"])


def _hashes(batches):
    """One row per node from its pieces, which come in order."""
    node = state = None
    for b in batches:
        done = []
        for a, p, ids in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), b.column("ids").to_pylist()):
            if (a, p) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, p), hashlib.sha256()
            state.update(ids.encode())
        yield _hash_batch(done)
    if node is not None:
        yield _hash_batch([(*node, state.hexdigest())])


def _hash_batch(rows):
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["pa", "pb", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(pa, pb, ends_sha256) of the nodes at which ``members`` (pa, pb, c) end."""
    laid = members.select("pa", "pb", "c").repartitionByRange("pa", "pb", "c").sortWithinPartitions("pa", "pb", "c")
    pieces = laid.mapInArrow(_pieces, "pa long, pb long, first long, ids string")
    pieces = pieces.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "first")
    return pieces.mapInArrow(_hashes, "pa long, pb long, ends_sha256 string")


# ---- the trie ----------------------------------------------------------------


def trie(conversations: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's hash
    (prefix_a, prefix_b)."""
    rows = screened(paths(conversations), max_cells)
    shared, tails = rows.filter("shared"), rows.filter("not shared")
    nodes = shared.groupBy("pa", "pb").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.first(x).alias(x) for x in ("d", "qa", "qb", "bytes")]
    )
    nodes = materialize(nodes, "trie-nodes")
    below = nodes.filter("d > 0").groupBy("qa", "qb").count().union(tails.filter("parent_shared").groupBy("qa", "qb").count())
    below = below.groupBy(F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.sum("count").alias("n_children"))
    nodes = materialize(nodes.join(below, ["pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-inner")

    # sums over subtrees: weights at representatives, then along conversations, then over members
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    saved = nodes.filter("n_convs > 1 and bytes > 0").select(F.col("conv_id").alias("c"), "d", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), none.alias("leaf"))
    leaves = nodes.filter("n_children = 0").select(F.col("conv_id").alias("c"), "d", none.alias("saved"), one.alias("leaf"))
    leaves = leaves.union(tails.filter("ends").select("c", "d", none.alias("saved"), one.alias("leaf")))
    null = F.lit(None).cast("long")
    weights = saved.union(leaves).select("c", "d", null.alias("pa"), null.alias("pb"), "saved", "leaf")
    weights = shared.select("c", "d", "pa", "pb", none.alias("saved"), none.alias("leaf")).union(weights)
    below = running(weights, {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")}, F.sum, Column.__add__, backwards=True)
    sums = below.filter("pa is not null").groupBy("pa", "pb").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    up = nodes.select(F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("up"))
    inner = nodes.join(sums, ["pa", "pb"]).join(ends(shared.filter("ends")), ["pa", "pb"], "left").join(up, ["qa", "qb"], "left")
    # a node below a singleton has its parent's one member
    parent = F.when(F.col("d") > 0, F.coalesce("up", "conv_id"))
    inner = inner.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), F.col("pa").alias("prefix_a"), F.col("pb").alias("prefix_b"),
    )

    def tail(df: DataFrame, parent: Column) -> DataFrame:
        sha = F.when(F.col("ends"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256))
        return df.select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"),
            F.when(F.col("ends"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
            sha.alias("ends_sha256"), F.col("pa").alias("prefix_a"), F.col("pb").alias("prefix_b"),
        )

    # only the first node of a tail needs its parent's smallest member
    first = tail(tails.filter("parent_shared").join(up, ["qa", "qb"], "left"), F.coalesce("up", "c"))
    rest = tail(tails.filter("not parent_shared"), F.col("c"))
    return inner.unionByName(first).unionByName(rest)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    found = trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
    return found.select(*STATS, "ends_sha256")


#: The same trie in DuckDB: prefixes by hashes of all their turns, subtrees by
#: joining each node with the prefixes of its smallest member.
OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos
  FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
  )
), convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS head,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda a, x: list_reduce(
             list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda s, i: xor(s >> 1, 3988292384::BIGINT * (s & 1)))
         ), 4294967295::BIGINT) % 9 AS h
  FROM own GROUP BY conv_id
), head AS (
  SELECT c.conv_id AS c, o.pos AS d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.head AND o.pos <= c.h
), given AS (
  SELECT c, count(*) AS k FROM head GROUP BY c
), every AS (
  SELECT c, d, role, text FROM head
  UNION ALL
  SELECT o.conv_id, coalesce(k, 0) + o.pos - h, o.role, o.text
  FROM own o JOIN convs USING (conv_id) LEFT JOIN given ON given.c = o.conv_id WHERE o.pos > h
), hashed AS (
  SELECT c, d, strlen(text) AS bytes,
         sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '/') OVER (PARTITION BY c ORDER BY d)) AS p
  FROM every
), path AS (
  SELECT c, d, bytes, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS up FROM hashed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), last AS (
  SELECT c, max(d) AS d FROM path GROUP BY c
), node AS (
  SELECT p, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs FROM path GROUP BY p
), kids AS (
  SELECT up AS p, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT a.p, sum((m.n_convs - 1) * m.bytes) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM node m LEFT JOIN kids USING (p) JOIN path a ON a.c = m.conv_id AND a.d <= m.depth GROUP BY a.p
), fin AS (
  SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM path JOIN last USING (c, d) GROUP BY p
)
SELECT node.conv_id::BIGINT AS conv_id, node.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, node.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
       coalesce(fin.sha, sha256('')) AS ends_sha256
FROM node LEFT JOIN node up ON up.p = node.up LEFT JOIN kids ON kids.p = node.p JOIN below ON below.p = node.p LEFT JOIN fin ON fin.p = node.p
"""
