"""Connected components of a graph given as an edge table, without gathering any node's edges in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches):
    """Replaces the edges of each Arrow batch by a spanning forest of stars: at most one edge a node."""
    for rb in batches:
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        own = [(x, find(x)) for x in parent]
        own = [(x, y) for x, y in own if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())], schema=_EDGES)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) to ``(node, root)``: root is the smallest node of the component; a node
    without an edge to another one is left out.

    Alternates the large-star and the small-star step until the edges form stars. Each node's least neighbour is
    written before it is joined back, so both sides of the join are plain exchanges that Spark can split where one
    node has very many edges. Rounds grow with the logarithm of the number of nodes.
    """
    now = table(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = table(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = table(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(low, "a")
        after = table(
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .filter("a <> b").distinct()
        )
        state = _state(after)
        for x in (now, least, large, low):
            drop(x)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
