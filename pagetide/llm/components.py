"""Connected components of an edge table, by contraction, on Spark.

Each round every node takes the smallest node among itself and its neighbours,
and the edges are rewritten to these; edges inside a node vanish. Rounds go on
until no edge is left (each round at least halves the nodes of a component on
edges), and then the labels are followed back. Nothing is collected; every
round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (columns a, b, no nulls);
    ``component`` is one of its nodes."""
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        low = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to"))
        low = materialize(low, "cc-map")
        maps.append(low)
        edges = materialize(
            edges.join(low.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .select("a2", "b")
            .join(low.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "cc-edges",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # maps[k] covers the nodes of round k; a node absent from it keeps its label
    label = maps[-1].select("node", F.col("to").alias("component"))
    label = _follow(label, maps[-1])
    for low in reversed(maps[:-1]):
        up = low.join(label.withColumnRenamed("node", "to"), "to", "left")
        label = materialize(up.select("node", F.coalesce("component", "to").alias("component")), "cc-label")
    return label


def _follow(label: DataFrame, low: DataFrame) -> DataFrame:
    """Follow label -> label until it stands (the last map can hold chains)."""
    while True:
        step = low.select(F.col("node").alias("component"), F.col("to").alias("next"))
        moved = materialize(
            label.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"), (F.col("next") < F.col("component")).alias("moved")),
            "cc-label",
        )
        label = moved.select("node", "component")
        if moved.filter("moved").isEmpty():
            return label
