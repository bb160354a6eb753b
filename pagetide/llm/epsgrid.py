"""Operator 3: embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine >= t lie within eps = sqrt(2 - 2t) of each other, and an
orthonormal projection never moves two points apart. So:

* equal vectors of a label form one class (a row with a count);
* classes are sorted by label and by their cells (side eps) on the leading
  principal dimensions, lexicographically, over range partitions that a hot
  cell does not widen (the class id ends the sort key);
* each partition cuts its sequence into blocks with bounding boxes; boxes of
  partitions that meet in a cell of the first dimensions, then of blocks, select
  the pairs that may hold links;
* a block pair is joined by halving both sequences, skipping halves whose boxes
  are further apart than eps, and multiplying what is left in double precision.

A block pair returns, per class, how many vectors it links to and one edge to
the smallest class of its local component, so the output is linear in the rows
even where a third of the vectors are alike. The principal dimensions come from
``SAMPLE`` vectors (those of smallest hash); they only steer what is skipped,
never the result.

Defined cases: a null label, and vectors that are null, empty, zero or hold null
or non-finite components, link with nothing; vectors of unequal length do not
link; repeated rows are vectors of their own; a null vec_id takes part and counts
as larger than any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, python_ready
from pagetide.llm.components import components

THRESHOLD = 0.98
LEADING = 8
GRID_DIMS = 3  # leading dimensions of the grid on which partitions meet
CELL = 1 / 16  # least side of its cells
SAMPLE = 4096
BLOCK = 1024
LEAF = 128
#: Slack on distances, far above rounding in double precision.
SLACK = 1e-9


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors per label: cid, label, embedding, size, rep."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    usable = F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    grouped = vectors.filter(usable).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("rep"))
    return materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "eps-classes")


def principal_axes(cls: DataFrame) -> dict[int, np.ndarray]:
    """Leading axes per vector length, from a bounded sample."""
    rows = cls.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    axes = {}
    for n, vs in by_length.items():
        u = _unit(np.array(vs, np.float64))
        _, _, vt = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)
        q, _ = np.linalg.qr(vt[:LEADING].T)
        axes[n] = q
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    q = axes.get(u.shape[1])
    p = u[:, :LEADING] if q is None else u @ q
    return np.pad(p, ((0, 0), (0, LEADING - p.shape[1])))


def _cells(batches, axes, eps):
    for b in batches:
        vectors = b.column("embedding")
        lengths = np.diff(vectors.offsets.to_numpy())
        cells = np.zeros((len(vectors), LEADING), np.int64)
        units = [b""] * len(vectors)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            u = _unit(np.stack([flat[ends[i] - n:ends[i]] for i in rows]))
            cells[rows] = np.floor(_project(u, axes) / eps)
            for i, v in zip(rows, u):
                units[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column("cid"), b.column("label"), b.column("size"), pa.array(lengths, pa.int32()),
             pa.array(list(cells), pa.list_(pa.int64())), pa.array(units, pa.binary())],
            names=["cid", "label", "size", "dim", "cells", "unit"],
        )


def _blocks(batches, axes, schema):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, group, made = [], None, 0

    def flush():
        nonlocal made
        label, dim = group
        u = np.stack([np.frombuffer(r[2]) for r in held])
        p = _project(u, axes)
        out = pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(
                [label, dim, part, (part << 31) + made, list(p.min(axis=0)), list(p.max(axis=0)),
                 np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[1] for r in held], np.int64).tobytes(), u.tobytes()],
                schema)],
            schema=schema,
        )
        made += 1
        held.clear()
        return out

    for b in batches:
        for cid, label, size, dim, unit in zip(*(b.column(c).to_pylist() for c in ("cid", "label", "size", "dim", "unit"))):
            if held and ((label, dim) != group or len(held) == BLOCK):
                yield flush()
            group = (label, dim)
            held.append((cid, size, unit))
    if held:
        yield flush()


def _near(x_lo, x_hi, y_lo, y_hi, eps) -> bool:
    gap = np.maximum(0.0, np.maximum(x_lo - y_hi, y_lo - x_hi))
    return float((gap * gap).sum()) <= (eps + SLACK) ** 2


def _join_intervals(u, p, v, q, same, t, eps, out, a, b, c, d):
    """Links of u[a:b] and v[c:d] into ``out``, halving while boxes are near."""
    if same and c >= b:
        pass  # wholly above the diagonal: joined as it is
    elif same and d <= a:
        return  # below the diagonal: the mirror image is joined
    if not _near(p[a:b].min(axis=0), p[a:b].max(axis=0), q[c:d].min(axis=0), q[c:d].max(axis=0), eps):
        return
    if b - a <= LEAF and d - c <= LEAF:
        out[a:b, c:d] = u[a:b] @ v[c:d].T >= t
        return
    m, n = (a + b + 1) // 2, (c + d + 1) // 2
    for x, y in ((a, m), (m, b)):
        for z, w in ((c, n), (n, d)):
            if x < y and z < w:
                _join_intervals(u, p, v, q, same, t, eps, out, x, y, z, w)


def block_links(u, v, p, q, same: bool, t: float, eps: float) -> np.ndarray:
    out = np.zeros((len(u), len(v)), bool)
    _join_intervals(u, p, v, q, same, t, eps, out, 0, len(u), 0, len(v))
    if same:
        out |= out.T
        np.fill_diagonal(out, False)
    return out


def _join_blocks(batches, axes, t, eps, schema):
    for batch in batches:
        for r in batch.to_pylist():
            same = r["bid"] == r["bid2"]
            ids, ids2 = np.frombuffer(r["cids"], np.int64), np.frombuffer(r["cids2"], np.int64)
            n, n2 = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["sizes2"], np.int64)
            u, v = (np.frombuffer(r[k]).reshape(-1, r["dim"]) for k in ("units", "units2"))
            link = block_links(u, v, _project(u, axes), _project(v, axes), same, t, eps)
            if not link.any():
                continue
            big = np.iinfo(np.int64).max
            low, low2 = ids.copy(), ids2.copy()
            while True:  # smallest class id of each local component
                new2 = np.minimum(low2, np.where(link, low[:, None], big).min(axis=0))
                new = np.minimum(low, np.where(link, new2[None, :], big).min(axis=1))
                if same:
                    new = new2 = np.minimum(new, new2)
                if (new == low).all() and (new2 == low2).all():
                    break
                low, low2 = new, new2
            sides = [(ids, low, link @ n2)] if same else [(ids, low, link @ n2), (ids2, low2, link.T @ n)]
            cols = [np.concatenate([s[k][s[2] > 0] for s in sides]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    python_ready(spark)
    eps = math.sqrt(2 - 2 * threshold)
    vectors = vectors.select("vec_id", "label", "embedding")
    cls = classes(vectors)
    axes = principal_axes(cls)
    label = cls.schema["label"]
    celled = T.StructType([T.StructField("cid", T.LongType()), label, T.StructField("size", T.LongType())])
    celled = celled.add("dim", "integer").add("cells", T.ArrayType(T.LongType())).add("unit", "binary")
    rows = cls.select("cid", "label", "size", "embedding").mapInArrow(lambda it: _cells(it, axes, eps), celled)
    order = ["label", "dim", "cells", "cid"]
    rows = materialize(rows, "eps-cells")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    block = T.StructType([label]).add("dim", "integer").add("part", "long").add("bid", "long")
    block = block.add("lo", T.ArrayType(T.DoubleType())).add("hi", T.ArrayType(T.DoubleType()))
    block = block.add("cids", "binary").add("sizes", "binary").add("units", "binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    block_schema = to_arrow_schema(block)
    blocks = materialize(line.mapInArrow(lambda it: _blocks(it, axes, block_schema), block), "eps-blocks")

    def near(x, y):
        gaps = F.zip_with(
            F.zip_with(F.col(f"{x}lo"), F.col(f"{y}hi"), lambda a, b: a - b),
            F.zip_with(F.col(f"{y}lo"), F.col(f"{x}hi"), lambda a, b: a - b),
            lambda a, b: F.greatest(a, b, F.lit(0.0)),
        )
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2

    def named(df, prefix, keep=()):
        return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])

    # interval pairs: partitions of the sequence first, then their blocks
    each = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(LEADING)] + [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(LEADING)]
    nodes = blocks.groupBy("label", "dim", "part").agg(*each).select(
        "label", "dim", "part", F.array(*[f"l{i}" for i in range(LEADING)]).alias("lo"), F.array(*[f"h{i}" for i in range(LEADING)]).alias("hi")
    )
    nodes = materialize(nodes, "eps-nodes")

    def gridded(df, prefix, reach):
        """A row per grid cell of the first dimensions that a box meets; with
        ``reach`` also for the cells around."""
        for i in range(min(GRID_DIMS, LEADING)):
            low, high = (F.floor(F.coalesce(F.col(f"{prefix}{b}")[i], F.lit(0.0)) / max(eps + SLACK, CELL)) for b in ("lo", "hi"))
            df = df.withColumn(f"g{i}", F.explode(F.sequence(low - reach, high + reach)))
        return df

    # boxes within reach of each other meet in a cell: no partition is paired with all
    keys = ["label", "dim", *[f"g{i}" for i in range(min(GRID_DIMS, LEADING))]]
    x, y = gridded(named(nodes, "x_", ("label", "dim")), "x_", 0), gridded(named(nodes, "y_", ("label", "dim")), "y_", 1)
    met = x.join(y, keys).filter((F.col("x_part") <= F.col("y_part")) & near("x_", "y_"))
    part_pairs = met.select("label", "dim", "x_part", "y_part").distinct()
    boxes = blocks.select("label", "dim", "part", "bid", "lo", "hi")
    x, y = named(boxes, "x_", ("label", "dim")), named(boxes, "y_", ("label", "dim"))
    pairs = (
        part_pairs.join(x, ["label", "dim", "x_part"]).join(y, ["label", "dim", "y_part"])
        .filter((F.col("x_bid") <= F.col("y_bid")) & near("x_", "y_"))
        .select(F.col("x_bid").alias("bid"), F.col("y_bid").alias("bid2"))
    )
    data = blocks.select("bid", "dim", "cids", "sizes", "units")
    other = blocks.select(F.col("bid").alias("bid2"), F.col("cids").alias("cids2"), F.col("sizes").alias("sizes2"), F.col("units").alias("units2"))
    full = materialize(pairs, "eps-pairs").join(data, "bid").join(other, "bid2")
    found = T.StructType().add("cid", "long").add("root", "long").add("n", "long")
    found_schema = to_arrow_schema(found)
    links = materialize(full.mapInArrow(lambda it: _join_blocks(it, axes, threshold, eps, found_schema), found), "eps-links")

    parts_of = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    per = (
        cls.select("cid", "label", "embedding", "size", "rep")
        .join(counts, "cid", "left")
        .join(parts_of.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .select("label", "embedding", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("comp"))
    )
    per = materialize(per, "eps-per-class")
    least = materialize(per.groupBy("comp").agg(F.min("rep").alias("component_id")), "eps-least")
    per = materialize(per.join(least, "comp").select("label", "embedding", "n_links", "component_id"), "eps-result")
    out = vectors.join(per, ["label", "embedding"], "left")
    linked = F.col("n_links").isNotNull()
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_epsilon_grid(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
