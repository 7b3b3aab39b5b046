"""Connected components of an edge table, as joins and minima over edges.

Each partition first shrinks its own edges to a forest by union-find. Rounds of
large-star and small-star steps follow: neighbours are moved to the smallest
label around, never gathered, so no task holds a node's whole neighbourhood.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import save, ship


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    links = [(x, find(x)) for x in list(parent)]
    links = [(x, root) for x, root in links if x != root]
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that has an edge ``a, b`` (long); the component is its smallest node.

    Self-loops and repeated edges don't matter; no edges give no rows. Rounds
    follow the logarithm of the longest path.
    """
    ship(edges.sparkSession)
    edges = save(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = save(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(least, "a").select(F.explode(F.array(F.struct("a", "least"), F.struct(F.col("b").alias("a"), "least"))).alias("e"))
        edges = save(moved.select("e.a", F.col("e.least").alias("b")).where("a <> b").distinct(), "edges")
        previous, state = state, _state(edges)
        if state == previous:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
