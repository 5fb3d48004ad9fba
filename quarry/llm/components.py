"""Connected components: union-find in each partition, then stars between partitions.

No component and no list of links reaches the driver. A hub's links spread over tasks:
least neighbours are partial aggregates, and joins on hubs are split when skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch


class Forest:
    """Union-find with path halving; the least member is the root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) as links from each node of a partition to its root there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
        pairs = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([r for _, r in pairs], pa.binary())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def _large(links: DataFrame) -> tuple[DataFrame, str]:
    """Every larger neighbour of a node is linked to the node's least neighbour or itself; and a table to drop later."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low, path = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low")), "low")
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), path


def _small(links: DataFrame) -> tuple[DataFrame, str]:
    """The smaller neighbours of a node, and itself, are linked to the least of them; and a table to drop later."""
    low, path = scratch.keep(links.groupBy("a").agg(F.min("b").alias("low")), "low")
    others = links.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), path


def _done(links: DataFrame) -> bool:
    """Whether every node has one link, to a node without any: then all links lead to roots."""
    twice = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    inner = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node with a link, the root being the least of its component; and the table's path.

    Partitions are forests first; then stars until all links lead to roots.
    """
    spark = links.sparkSession
    now, path = scratch.keep(contracted(links), "links")
    while not _done(now):
        large, used = _large(now)
        large, large_path = scratch.keep(large, "links")
        new, also = _small(large)
        new, new_path = scratch.keep(new, "links")
        scratch.drop(spark, path, used, also, large_path)
        now, path = new, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), path
