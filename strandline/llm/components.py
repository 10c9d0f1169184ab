"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import dropped, join_counted, written

#: Edges that one task closes by itself; 16 bytes each.
FEW_EDGES = 1 << 20


def closed(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[a], label[b]
        if (one == two).all():
            return nodes, nodes[label]
        least = np.minimum(one, two)
        # Roots are hung below the lesser root of any edge, then all chains are shortened.
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
        while (label != label[label]).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
        nodes, roots = closed(*np.concatenate(held, axis=1))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(roots[at : at + (1 << 16)])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def _size(df: DataFrame) -> tuple[int, object]:
    """Rows, and a hash that tells whether two tables hold the same edges."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def _to_least(near: DataFrame, total: int, keep: Column) -> DataFrame:
    """From neighbours (u, v): each v that ``keep`` takes, with the least node at its u."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    found = join_counted(near.where(keep), least, "u", "n", total)
    return found.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b")


def components(edges: DataFrame, most_rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """Nodes of ``edges`` (columns a, b) with ``root``, the least node that each reaches.

    Up to ``few`` different edges, as counted, are closed in one task; more of them in
    rounds.  A round alternates two steps over the edges until neither changes them: every node
    ties its larger neighbours to the least of its neighbourhood, then every node
    ties itself and its smaller neighbours to the least of them.  The number of
    edges doesn't grow and the rounds are about the logarithm of the longest
    path.  Minima are pre-aggregated and hot nodes are broadcast (4,096 at most),
    so that a node with most of the edges isn't one task.  Each round is written
    to the shared folder.  No edges give no rows; a self-loop gives none either.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _size(now)
    if state[0] <= few:
        return _in_one_task(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        before, old = state, now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(_to_least(both, 2 * state[0], F.expr("v > u")).distinct(), "edges")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = join_counted(down, least, "u", "n", state[0]).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b")
        now = written(tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        state = _size(now)
        dropped(old)
        dropped(large)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
