"""Connected components by union-find inside partitions, then rounds over the roots that are left.

Every task unites the edges it holds and keeps one edge (node, root) per node. A node that several tasks have seen has
several roots; these become the edges of the next round, which has roots as its only nodes and so shrinks. Each round is
a written table: a lost executor repeats one round at most. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import written

#: A round with at most so many edges is united in one task.
ONE_TASK = 200_000


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for every node of the edges (a, b) of one task; the root is the smallest node of its component here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo:lo + 50_000]
        yield pa.RecordBatch.from_pydict({"node": pa.array(part, pa.int64()), "root": pa.array(map(root, part), pa.int64())})


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b), both long; label is the smallest node that can be reached.

    Edges with a null end are left out; repeated edges and loops are harmless; without edges the result is empty.
    """
    rounds = []
    left = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    while True:
        local = left.mapInArrow(unite, "node long, root long")
        seen = written(local, "roots")
        best = written(seen.groupBy("node").agg(F.min("root").alias("root")), "best")
        rounds.append(best)
        # a hot node has one row per task here, never one per edge
        again = written(seen.join(best.withColumnRenamed("root", "least"), "node").filter("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct(), "between")
        n = again.count()
        if not n:
            break
        left = again.coalesce(1) if n <= one_task else again.repartition(F.least("a", "b"))
    labels = rounds.pop()
    while rounds:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("label"))
        labels = rounds.pop().join(above, "root", "left").select("node", F.coalesce("label", "root").alias("root"))
    return labels.withColumnRenamed("root", "label")
