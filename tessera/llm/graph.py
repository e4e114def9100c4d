"""Connected components of a distributed edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, staged

#: Edges that one task may finish by itself (16 bytes each); more are contracted on all partitions first.
LAST = 400_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges (u, v) between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # a root is hooked onto a lesser one
        while (label[label] != label).any():
            label = label[label]


def _finish(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in parts]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = least_labels(at[: len(a)], at[len(a) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "to"])

    return arrow_map(edges.coalesce(1), rows, "node long, to long")


def connected_components(edges: DataFrame, last: int = LAST) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node that is reachable.

    Each round gives every node the node of least priority among itself and its neighbours, and
    nodes of one label become one node of the next round. Priorities are the ids themselves in the
    first round, since most edges lead to the least node of their component, and hashes drawn anew
    in each later round. The node of greatest priority is nobody's label, so every round shrinks
    every component that has an edge, whatever its shape: by half or more as a rule, so the number
    of rounds grows with the logarithm of the nodes. Once `last` edges or fewer are left, one task
    labels their ends. Then labels are resolved from the last round back. Hubs are summed with a
    partial aggregate; nothing is collected but the bounded count of edges left."""
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    nodes = None  # of this round, with the least node of the input in each
    while nodes is None or edges.limit(1).count():
        few = edges.limit(last + 1).count() <= last
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))) if levels else F.lit(0), F.col(c).alias("to"))  # noqa: B023, E731
        if few:
            labels = _finish(edges)
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
            labels = near.select(F.col("a").alias("node"), F.least(rank("a"), "near")["to"].alias("to"))
        labels = labels.withColumn("least", F.col("node")) if nodes is None else nodes.join(labels, "node", "left").select("node", "to", "least")
        labels = staged(labels, "labels")  # without a label: a whole component
        levels.append(labels)
        of = labels.where("to is not null")
        nodes = of.groupBy(F.col("to").alias("node")).agg(F.min("least").alias("least"))
        if few:
            break
        merged = edges.join(of.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        after = staged(merged.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges)
        edges = after
    roots = nodes.select(F.col("node").alias("to"), F.col("least").alias("root"))
    found = None
    for labels in reversed(levels):
        now = staged(labels.join(roots, "to", "left").select("node", F.coalesce("root", "least").alias("root")), "roots")
        discard(labels, found)
        found, roots = now, now.select(F.col("node").alias("to"), "root")
    discard(edges)
    return found
