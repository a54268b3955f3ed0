"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Up to so many edges (16 MB) one task settles them all; more are settled by rounds of joins.
ONE_TASK = 1_000_000


def _forest(batches):
    """node and component of all edges of a partition, by union of the smaller roots."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root to the smaller, then shorten all paths
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(nodes[root[i : i + 50_000]])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and component, the smallest node that it reaches, of every node of edges(a, b).

    Small graphs are settled in one task behind a count of their edges; larger ones by alternating large
    and small stars, each an aggregate with map-side combine and a join, written out after each round.
    Loops (a = b) and repeated edges change nothing; null ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    if edges.count() <= one_task:
        return edges.repartition(1).mapInArrow(_forest, "node long, component long")
    everyone = edges.select("a").union(edges.select("b")).distinct()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    roots = now.groupBy("a").agg(F.min("b").alias("m"))
    return everyone.join(roots, "a", "left").select(F.col("a").alias("node"), F.coalesce("m", "a").alias("component"))
