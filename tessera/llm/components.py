"""Connected components of a graph of 64-bit node ids by repeated contraction."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, materialize


#: Edges that a task holds at once to connect them.
_HELD = 1 << 18


def _stars(mask: int):
    """From edges (a, b): for each run of at most _HELD of a task, an edge from each node to the first node of its component within
    the run, in the order that the mask draws; no node is lost, and what is connected stays so."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]) ^ np.int64(mask), return_inverse=True)  # numbers in that order
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            before = root.copy()
            u, v = root[x], root[y]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root != root[root]).any():
                root = root[root]
            if (root == before).all():
                break
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        out = (np.minimum(nodes[leaf] ^ mask, nodes[root[leaf]] ^ mask), np.maximum(nodes[leaf] ^ mask, nodes[root[leaf]] ^ mask))
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in out], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for k in (0, 1):
                held[k].append(batch.column(k).to_numpy())
            size += batch.num_rows
            if size >= _HELD:
                yield stars(*map(np.concatenate, held))
                held, size = [[], []], 0
        if size:
            yield stars(*map(np.concatenate, held))

    return run


def connected_components(edges: DataFrame, *, seed: int = 5) -> DataFrame:
    """node and root (one node of its component) for each node of the edges (a, b), other than loops. Ids should be spread like hashes.

    Each round draws an order anew. Each task turns the edges it reads into stars about their first nodes, then every node points to
    the first of itself and its neighbours, edges are contracted along the pointers, and what becomes a loop goes; the number of edges
    falls by a share each round, whatever the shape of the graph, and few tasks' edges are done in a round or two.
    Tables between the rounds are written, so no join's input has an aggregate above its exchange and hot nodes can be split; each
    is deleted when the next round has been written. No edges: no rows.
    """
    draw = random.Random(seed)
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    labels = held = None
    while labels is None or not edges.isEmpty():
        drawn = draw.getrandbits(64) - 2**63
        mask, stars = F.lit(drawn), edges.mapInArrow(_stars(drawn), "a long, b long")
        both = stars.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        first = both.groupBy("node").agg(F.min(F.col("to").bitwiseXOR(mask)).alias("m"))
        first = materialize(first.select("node", F.least("m", F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")), "cc-pointers")
        one = stars.join(first.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        two = one.join(first.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        shrunk = materialize(two.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels, held = first.select("node", F.col("to").alias("root")), first  # read from the pointers, which stay
        else:
            step = first.select(F.col("node").alias("root"), F.col("to").alias("_to"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "cc-labels")
            forget(held, first)
            held = labels
        forget(edges)
        edges = shrunk
    forget(edges)
    if "_written" not in labels.__dict__:
        labels.__dict__["_written"] = held.__dict__.pop("_written", None)
    return labels


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node and root as connected_components of the links (a, b) and those that the labels (node, root) come from: only the roots that
    the links name are connected anew. Loops add no node. No links: the labels."""
    links = links.where("a <> b")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    named = materialize(labels.select("node", "root").unionByName(nodes.select("node", F.col("node").alias("root"))), "cc-named")
    one = links.join(named.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("x", "b")
    two = one.join(named.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = connected_components(two)
    step = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    out = materialize(named.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "cc-labels")
    forget(named, roots)
    return out
