"""Connected components by hooking and pointer jumping, for graphs of any size and any degrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import discard, trim, written

#: Edges that a task gathers before it reduces them to one a node.
EDGES = 1_000_000


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of ``n`` numbers that edges between ``i`` and ``j`` connect each with."""
    root = np.arange(n)
    while True:
        after, low = root.copy(), np.minimum(root[i], root[j])
        for at in (i, j, root[i], root[j]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def stars(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each node to the least one that the pairs connect it with."""
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[roots(len(nodes), place[: len(a)], place[len(a) :])]


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (``a``, ``b``, bigint) with the same components: all of a node ``a`` meet in one task, which keeps one for
    each of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            total += batch.num_rows
            if total > EDGES:
                held = [stars(held)]
                total = len(held[0][0])
        a, b = stars(held)
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])
        trim()

    return edges.where("a <> b").select("a", "b").repartition("a").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node`` and ``root``.

    Edges are undirected pairs of ids (bigint); loops, repeats and rows with a null are no harm. No edges give no rows.
    Each round hooks trees onto the smallest root seen across an edge and halves the paths (the FastSV scheme), so the
    number of rounds grows with the logarithm of the longest path. Only minima are aggregated, which combine before
    the shuffle; the one join whose key can be hot (a node's parent) has a single row on its other side, so adaptive
    execution splits it. Labels are written to the shared folder after each round, which cuts the lineage.
    """
    both = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    both = written(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("f")), "labels")
    while True:
        parent = label.select(F.col("u").alias("f"), F.col("f").alias("g"))
        state = written(label.join(parent, "f").select("u", "f", "g"), "state")
        seen = both.join(state.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v").select("u", "gv")
        seen = written(seen.groupBy("u").agg(F.min("gv").alias("m")).join(state, "u"), "seen")
        offers = seen.select("u", F.least("m", "g").alias("f")).union(seen.select(F.col("f").alias("u"), F.least("m", "g").alias("f")))
        after = written(offers.groupBy("u").agg(F.min("f").alias("f")), "labels")
        moved = after.join(state.select("u", F.col("f").alias("f0"), "g"), "u").where((F.col("f") != F.col("f0")) | (F.col("g") != F.col("f0")))
        done = moved.isEmpty()
        discard(label, state, seen)
        label = after
        if done:
            discard(both)
            return label.select(F.col("u").alias("node"), F.col("f").alias("root"))
