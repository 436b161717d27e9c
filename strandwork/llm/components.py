"""Connected components by alternating large-star and small-star contraction.

Each round is two grouped minimums and their joins; no link, label or component leaves the executors. Every
round's links are written to the shared folder, which cuts lineage, and the previous round's are deleted. At most SMALL
links, which are counted first, are joined by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.shared import forget, kept

#: Links that one task joins.
SMALL = 200_000


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, m): the smallest of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    onward = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(least.select("u", F.col("m").alias("v")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of at most SMALL links by union-find."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))  # names ascend, so the smaller place is the smaller node

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(names))])
    other = roots != np.arange(len(names))
    yield pa.record_batch([pa.array(names[other]), pa.array(names[roots[other]])], names=["node", "root"])


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, root) for each node that reaches a smaller one; root is the smallest node it reaches.

    Few links are joined in one task; more are contracted round by round. Both give the same rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    edges, before = kept(edges, "links"), None
    if edges.count() <= small:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    while True:
        after = kept(_small(_large(edges).where("u != v").distinct()).where("u != v").distinct(), "links")
        state = after.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        forget(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
