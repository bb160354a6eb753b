"""Positions inside groups of any size, without a window over a whole group.

``positions`` sorts the table by range, so a group that holds a third of all
rows spans many partitions. Rows are counted inside their partition by a window
over (partition, group); a group that goes on from earlier partitions adds what
these hold of it. A partition begins in the middle of one group at most and ends
in the middle of one, so these sums are two a partition and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.session import written


def positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 1, bigint) in its group of ``keys`` by
    ``order``. Null keys form a group; rows that tie get different places.
    Column names ``_part``, ``_at``, ``_key``, ``_in`` and ``_carry`` are taken."""
    # rows that tie on everything else still spread over partitions
    by = [F.col(k).asc() for k in keys] + list(order) + [F.col("_at").asc()]
    laid = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    laid = laid.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    # written once: sampling anew could lay other ranges
    laid = written(laid, "positions").withColumn("_key", F.struct(*keys))
    carry = F.broadcast(_carried(laid.select("_part", "_at", "_key")))
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    placed = laid.withColumn("_in", F.row_number().over(inside).cast("long")).alias("l").join(
        carry.alias("c"), (F.col("l._part") == F.col("c._part")) & F.col("l._key").eqNullSafe(F.col("c._key")), "left"
    )
    return placed.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._in") + F.coalesce("c._carry", F.lit(0))).alias(out))


def _carried(laid: DataFrame) -> DataFrame:
    """(_part, _key, _carry): rows of the groups that span partitions in the
    partitions before."""
    parts = laid.groupBy("_part").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    ends = parts.select(F.inline(F.array(
        F.struct(F.col("first").alias("_key"), F.col("_part").alias("begins"), F.lit(None).cast("int").alias("ends")),
        F.struct(F.col("last").alias("_key"), F.lit(None).cast("int").alias("begins"), F.col("_part").alias("ends")),
    )))
    spanning = ends.groupBy("_key").agg(F.max("begins").alias("b"), F.min("ends").alias("e")).filter("e < b").select(F.col("_key").alias("_k"))
    held = laid.join(F.broadcast(spanning), F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    held = held.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("_part", "_key", F.sum("n").over(before).alias("_carry"))
