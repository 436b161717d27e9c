"""Block mappings between paths, differences of samples, and annotations carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.ranges import contains, merged_mappings, rng, translated
from strandwork.operators.joins import overlap_join


def mappings(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """(key, s0, s1, t0, t1): ranges of our path that lie in the same slices of the same nodes as ranges of theirs.

    Both: (key, node_id, start, end, path_start). Contiguous mappings are one.
    """
    a = ours.select(*key, "node_id", F.col("start").alias("a0"), F.col("end").alias("a1"), F.col("path_start").alias("ap"))
    b = theirs.select(*key, "node_id", F.col("start").alias("b0"), F.col("end").alias("b1"), F.col("path_start").alias("bp"))
    met = overlap_join(a, b, [*key, "node_id"], ("a0", "a1"), ("b0", "b1"))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    found = met.select(
        *key,
        (F.col("ap") + lo - F.col("a0")).alias("s0"),
        (F.col("ap") + hi - F.col("a0")).alias("s1"),
        (F.col("bp") + lo - F.col("b0")).alias("t0"),
        (F.col("bp") + hi - F.col("b0")).alias("t1"),
    )
    return merged_mappings(found, key)


def carried(annotations: DataFrame, maps: DataFrame, key: list[str]) -> DataFrame:
    """Annotations (key, name, start, end) on the other path: from the first overlapping mapping to the last.

    A bound inside its mapping is translated; one outside takes the mapping's own bound. Without a mapping there is no row.
    """
    met = overlap_join(annotations, maps, key, ("start", "end"), ("s0", "s1"))
    m = F.struct("s0", "s1", "t0", "t1")
    ends = met.groupBy(*key, "name", "start", "end").agg(F.min(m).alias("first"), F.max(m).alias("last"))
    side = lambda which, at, fall: F.coalesce(
        translated(F.col(at), rng(f"{which}.s0", f"{which}.s1"), rng(f"{which}.t0", f"{which}.t1")), F.col(f"{which}.{fall}")
    )
    return ends.select(*key, "name", side("first", "start", "t0").alias("start"), side("last", "end", "t1").alias("end"))


def regions(maps: DataFrame, lengths: DataFrame, key: list[str], side: str = "s") -> DataFrame:
    """(key, start, end, shared): a path as its mapped stretches and the gaps between them."""
    a, b = f"{side}0", f"{side}1"
    order = W.partitionBy(*key).orderBy(a)
    m = maps.join(lengths, key).select(*key, F.col(a).alias("start"), F.col(b).alias("end"), "length")
    order = W.partitionBy(*key).orderBy("start")
    gap = m.select(*key, F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")).alias("start"), F.col("start").alias("end"))
    last = m.groupBy(*key).agg(F.max("end").alias("start"), F.first("length").alias("end"))
    alone = lengths.join(maps.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    gaps = gap.unionByName(last).unionByName(alone).where("start < `end`").withColumn("shared", F.lit(False))
    return gaps.unionByName(m.select(*key, "start", "end").withColumn("shared", F.lit(True)))


def translate(annotations: DataFrame, placed: DataFrame, key: str, gff: bool = False) -> DataFrame:
    """Annotations cut to the blocks of a path: (key, name, node_id, start, end) in path coordinates.

    GFF bounds are one-based and inclusive; its blocks are keyed from one on.
    """
    shift = 1 if gff else 0
    b = placed.select(key, "node_id", (F.col("path_start") + shift).alias("p0"), F.col("path_end").alias("p1"))
    met = overlap_join(annotations, b, [key], ("start", "end"), ("p0", "p1"))
    return met.select(key, "name", "node_id", F.greatest("start", "p0").alias("start"), F.least("end", "p1").alias("end"))


__all__ = ["carried", "contains", "mappings", "regions", "translate"]
