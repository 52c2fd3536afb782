"""Connected components of an undirected graph given as edges.

Alternating large-star and small-star steps: every edge is moved onto the
smallest neighbour known, until each component is one star around its smallest
node.  Both steps are a partial minimum by node and a join back, in which the
rows of a node with very many edges stay where they are.  The number of rounds
grows with the logarithm of the longest path, not with its length.  A graph of
few edges, or what is left of one, is finished by union-find in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from emberline.operators.skew import HOT_ROWS, join_unique
from emberline.plans.scratch import discard, materialize

#: Edges, 16 bytes each, that one task takes.
LOCAL_EDGES = 500_000


def _large_star(edges: DataFrame, n: int, hot: int) -> DataFrame:
    """For every node, its larger neighbours move to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u")
    met = join_unique(larger, least, "u", hot=hot) if n > hot else larger.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int, hot: int) -> DataFrame:
    """For every node, its smaller neighbours and itself move to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = join_unique(edges, least, "u", hot=hot) if n > hot else edges.join(least, "u")
    moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of a graph in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:  # every label points to a root
            up = label[label]
            if (up == label).all():
                break
            label = up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = smallest_reachable(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        far = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], ["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60, local: int = LOCAL_EDGES, hot: int = HOT_ROWS) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Loops, repeated edges and edges with a null end are allowed; null ends are
    ignored, and a node that has only a loop is its own component.  Node columns
    must be of one orderable type.  local: edges up to which one task finishes
    (only whole numbers); hot: edges of a node from which its rows aren't gathered.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    loops = pairs.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = materialize(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    whole = isinstance(now.schema["u"].dataType, (LongType, IntegerType)) and now.schema["u"].dataType == now.schema["v"].dataType
    mark = (now.count(),)
    for _ in range(most_rounds):
        if whole and mark[0] <= local:
            then, now = now, materialize(now.repartition(1).mapInArrow(_in_one_task, now.schema), "edges")
            discard(then)
            break
        large = materialize(_large_star(now, mark[0], hot), "edges") if mark[0] > hot else _large_star(now, mark[0], hot)
        then, now = now, materialize(_small_star(large, mark[0], hot), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(then)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionAll(roots).unionAll(loops.distinct().join(found.unionAll(roots), "node", "left_anti"))
