"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint

#: Edges that a task merges at once before the stars begin.
LOCAL_EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node of its component among these edges (the node itself left out)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        u, v = forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) >= LOCAL_EDGES:
            yield flushed()
            held = []
    if held:
        yield flushed()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two long columns); component: its smallest node.

    Tasks first merge the edges they hold into forests, which have fewer edges than nodes.  Each
    round then joins the edges with their ends' smallest neighbours; minima are summed up before
    they are shuffled and written before they are joined, so a node of very many edges makes no
    task larger (its edges may be dealt to several).  Rounds grow with the logarithm of the size.
    """
    u, v = edges.columns
    plain = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).where("u != v")
    now = checkpoint(plain.mapInArrow(_merged, "u long, v long"))
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        now = checkpoint(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpoint(now.groupBy("u").agg(F.min("v").alias("m")))
        lower = now.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(lower.union(least).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
