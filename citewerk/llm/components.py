"""Connected components by randomised contraction: O(log n) rounds expected, whatever the graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import settle

#: The first rounds go by the nodes themselves, which ends stars (and stars of stars) at once.
ORDERED_ROUNDS = 2


def _priority(node: Column, number: int) -> Column:
    """Another random order of the nodes in each round; the node itself breaks ties."""
    return F.struct(F.xxhash64(F.lit(number), node).alias("p"), node.alias("node"))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) for the ends of edges (a, b): root is the smallest node of the component.

    A round sends each node to the one of itself and its neighbours that comes first in that
    round's order, and maps the edges along; only edges between different images are left. With a
    random order a round leaves three quarters of the nodes at most in expectation (half of them on
    a chain), so a chain of rising ids takes as few rounds as any other graph. The moves of all
    rounds are put together from the last to the first, so each is read once. Rows are narrow, a
    hub is a partial minimum, and no component is ever in one place. Edges to itself, repeated
    edges and edges with a null end count for nothing; no edges give no rows.

    `rounds`, where given, gets the number of edges left before each round.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    moves: list[DataFrame] = []
    while left := edges.count():
        if rounds is not None:
            rounds.append(left)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if len(moves) < ORDERED_ROUNDS:
            first = F.least(F.min("b"), F.first("a"))
        else:
            ahead = F.min(_priority(F.col("b"), len(moves)))
            first = F.least(ahead, F.first(_priority(F.col("a"), len(moves)))).getField("node")
        moved = settle(both.groupBy(F.col("a").alias("node")).agg(first.alias("root")))
        moves.append(moved)
        of_a = moved.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        apart = edges.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        edges = settle(apart.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        roots = settle(
            moves.pop().join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        )
    lowest = roots.groupBy("root").agg(F.min("node").alias("low"))
    return settle(roots.join(lowest, "root").select("node", F.col("low").alias("root")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its component; for links within a task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        if (la == lb).all():
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
