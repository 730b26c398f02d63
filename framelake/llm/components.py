"""Connected components of a graph of links, by joining stars.

In each round the links of both directions meet by node, those of one node in up to ``SALTS`` tasks; each task unites what it holds,
in bounded lots, and gives each node the smallest node that it reaches there; then each node takes the least of what tasks gave
it, and what it was given is linked to that. Rounds end when nothing changes.

Defined results: links without a null, in either direction and repeated, of a node with itself, too (it is a component then);
without links there are no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Links that a task unites at once.
LOT = 1_000_000
#: Tasks that the links of one node are dealt to.
SALTS = 32


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def united() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, root = roots(t.column("a").to_numpy(), t.column("b").to_numpy())
        node, root = node[node != root], root[node != root]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LOT:
            yield united()
            held = []
    if held:
        yield united()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links (a, b), a written table, as it is read twice; a component's name is its smallest node."""
    links = links.select("a", "b")
    stars = links.filter("a <> b").mapInArrow(_stars, "node long, component long")
    state = None
    while True:
        # Each node is linked to the least it was given, and the other names it was given are, too: a link for a row.
        given = stars.withColumn("least", F.min("component").over(Window.partitionBy("node")))
        end = F.when(F.col("component") == F.col("least"), F.col("node")).otherwise(F.col("component"))
        edges = scratch.cut(given.select(end.alias("a"), F.col("least").alias("b")).distinct())
        r = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first())
        if r == state or not r[0]:
            break
        state = r
        both = edges.union(edges.select("b", "a"))
        stars = both.repartition("a", F.pmod(F.xxhash64("b"), F.lit(SALTS))).mapInArrow(_stars, "node long, component long")
    named = edges.union(edges.select("b", "b")).union(links.filter("a = b"))
    return named.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
