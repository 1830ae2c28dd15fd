"""Connected components by distributed union-find: local forests, merged hierarchically.

Every partition builds a union-find forest over the edges it happens to hold (no key is gathered, so a hub with a third
of all edges is spread over all partitions) and emits one row per vertex and local root. A vertex that has several local
roots links them: these links, between local roots only, are the edges of the next level. The number of partitions
follows the number of edges, so that no forest outgrows a task's memory. Vertices are ordered by a hash, so each level
shrinks the graph by a constant factor; when few edges are left, one partition ends it. Labels are then handed down level by level with joins. Each level is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

#: Edges that one partition may hold, at every level.
LAST_LEVEL = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def order(x: str) -> tuple[int, str]:
        return xxhash.xxh3_64_intdigest(x), x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                if order(b) < order(a):
                    a, b = b, a
                parent[b] = a
    nodes = list(parent)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([find(x) for x in part], pa.string())], names=["node", "root"])


def components(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(node string, root string) for every vertex of ``edges(a, b)``; equal roots mean the same component.

    Null ends are ignored, loops give a vertex of its own, repeated edges count once; no edges give an empty table.
    """
    edges = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a is not null and b is not null")
    if partitions is None:
        edges = stage(edges, "edges")
        partitions = max(1, -(-edges.count() // LAST_LEVEL))
    levels: list[DataFrame] = []
    while True:
        # a round-robin spread: no vertex decides where its edges go
        forest = stage(edges.repartition(partitions).mapInArrow(_forest, "node string, root string"), "forest")
        roots = forest.groupBy("node").agg(F.min(F.struct(F.xxhash64("root").alias("h"), "root")).alias("m"), F.countDistinct("root").alias("k"))
        level = roots.select("node", F.col("m.root").alias("root"), "k")
        if partitions == 1:
            levels.append(forest)
            break
        level = stage(level, "level")
        levels.append(level.select("node", "root"))
        edges = stage(
            forest.join(level.where("k > 1").select("node", F.col("root").alias("b")), "node")
            .where("root <> b")
            .select(F.col("root").alias("a"), "b")
            .distinct(),
            "links",
        )
        left = edges.count()
        if left == 0:
            break
        partitions = -(-left // LAST_LEVEL)
    labels = levels.pop()
    while levels:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = levels.pop().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return labels
