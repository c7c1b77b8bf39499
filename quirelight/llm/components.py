"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.shared import drop, save

#: Links that a task joins up at once.
HELD = 1 << 20


def joined_up(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest one that the pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), undirected, repeats and loops allowed.

    Returns (node long, component long) for each node of a link between two different nodes;
    component is the smallest node reachable. Each task first joins up the links that it holds, so
    stars go on in place of webs. In each round every node hooks to its smallest smaller neighbour,
    chains are shortened by doubling, and links are moved to the roots; the rounds end when no link
    joins two roots. Minima per node are partial ones; a hub's links, which a move joins on the
    hub, are one key that AQE's skew join splits. Nothing is collected but counts."""
    edges = save(_contracted(_ordered(links, "a", "b")), "cc-edges")
    labels = None
    while edges.limit(1).count():
        up = save(edges.groupBy("hi").agg(F.min("lo").alias("up")), "cc-up")
        roots = _shortened(up)
        if labels is None:
            nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
            labels = nodes.withColumn("component", F.col("node"))
        labels = save(_moved(labels, roots, "component"), "cc-labels")
        moved = _moved(_moved(edges, roots, "hi"), roots, "lo")
        edges = save(_contracted(_ordered(moved, "hi", "lo")), "cc-edges")
        drop(up)
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels


def _ordered(links: DataFrame, a: str, b: str) -> DataFrame:
    hi, lo = F.greatest(a, b), F.least(a, b)
    return links.where(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars that connect what the edges connect: each task joins up to HELD links at a time."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        hi, lo = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        label = joined_up(len(nodes), iter([(at[: len(hi)], at[len(hi) :])]))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return edges.mapInArrow(run, "hi long, lo long")


def _moved(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """column replaced by its root, where it has one."""
    to = roots.select(F.col("hi").alias("__from"), F.col("up").alias("__to"))
    joined = df.join(to, F.col(column) == F.col("__from"), "left")
    return joined.withColumn(column, F.coalesce("__to", column)).select(*df.columns)


def _shortened(up: DataFrame) -> DataFrame:
    """Each node's root. A node's up is smaller than the node, so there are no cycles."""
    while True:
        heads = up.select(F.col("hi").alias("__hi"))
        if not up.join(heads, F.col("up") == F.col("__hi"), "left_semi").limit(1).count():
            return up
        up = save(_moved(_moved(up, up, "up"), up, "up"), "cc-up")
