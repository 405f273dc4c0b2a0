"""Connected components on DataFrames: alternating large and small stars.

Every round is written to shared storage, so no lineage grows and a lost
executor costs one round at most. Nothing but counts reaches the driver. Once
at most ONE_TASK edges are left, which are counted after each round, one task
finishes them in place of the rounds that would follow; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.storage import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each larger neighbour of a node goes to the least node of its neighbourhood; with the table of least nodes.

    The least nodes are written before they are joined: so both sides of the join are shuffled on their own, and
    adaptive execution can split the edges of a node that most others hang on."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved, least


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select("u", F.col("m").alias("v"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return kept.unionAll(moved)


#: Edges that one task takes: about 100 MB of its worker.
ONE_TASK = 200_000


def labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with: least labels of neighbours, with jumps over labels."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        np.minimum.at(low, label, low.copy())  # what a node has found holds for the node that its label names
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0), b.column(1)) for b in batches if b.num_rows]
        if not parts:
            return
        ends = pa.concat_arrays([u for u, _ in parts] + [v for _, v in parts]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        code = rank[ends.indices.to_numpy()]
        nodes = ends.dictionary.take(order)
        found = labels(code[: len(code) // 2], code[len(code) // 2 :], len(nodes))
        for a in range(0, len(nodes), 1 << 15):
            b = min(a + (1 << 15), len(nodes))
            yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), nodes.take(pa.array(found[a:b]))], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def _print(edges: DataFrame) -> tuple:
    """What a set of edges is recognised by, whatever the order of its rows."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    edges: columns u and v of any ordered type; loops and repeats are ignored.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    for _ in range(most):
        if not seen[0]:
            break
        if seen[0] <= ONE_TASK:
            return _in_one_task(now)
        moved, least = _large_star(now, scratch)
        nxt = scratch.table(_small_star(moved).distinct(), "edges")
        scratch.drop(now, least)
        now, was, seen = nxt, seen, _print(nxt)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
