"""Connected components by alternating large and small stars, every round a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


FEW_EDGES = 1 << 18  # 4 MB: so many edges are joined up in one task, more by rounds of stars


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task, by union of trees whose roots are their smallest nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: 64-bit integers): root is the smallest node of its component.

    Loops and repeated edges are fine.  Up to ``few`` edges are joined up in one task of bounded size; beyond,
    each star joins the edges with one minimum a node, so that no neighbour list is ever gathered.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    state = _state(now)
    if state[0] <= few:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(small, "small-star")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
