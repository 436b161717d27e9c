"""Blocks (node slices without an edge end inside) and the graph of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.scalars import is_terminal
from strandwork.schema import END_NODE, START_NODE


def edges_of_groups(block_group_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each membership: an edge on two layers is two rows."""
    bge = block_group_edges.select("block_group_id", "edge_id", "chromosome_index", "phased")
    return bge.join(edges.withColumnRenamed("id", "edge_id"), "edge_id")


def latest_layer(memberships: DataFrame) -> DataFrame:
    """One row for each edge of a group: that of the last membership."""
    order = W.partitionBy("block_group_id", "edge_id").orderBy(F.desc("id"))
    return memberships.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def boundaries(edges: DataFrame, group: str = "block_group_id") -> DataFrame:
    """(group, node_id, at): each distinct coordinate at which an edge leaves or enters a node."""
    ends = F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.col("source_coordinate").alias("at")),
        F.struct(F.col("target_node_id").alias("node_id"), F.col("target_coordinate").alias("at")),
    )
    return edges.select(group, F.inline(ends)).distinct()


def split(edges: DataFrame, group: str = "block_group_id") -> DataFrame:
    """(group, node_id, start, end): the stretches between neighbouring boundaries, and the two virtual blocks.

    A node with one boundary has no block.
    """
    nxt = F.lead("at").over(W.partitionBy(group, "node_id").orderBy("at"))
    inner = (
        boundaries(edges, group)
        .where(~is_terminal("node_id"))
        .select(group, "node_id", F.col("at").alias("start"), nxt.alias("end"))
        .where("end is not null")
    )
    zero = F.lit(0).cast("long")
    ends = F.array(*[F.struct(F.lit(n).cast("long").alias("node_id"), zero.alias("start"), zero.alias("end")) for n in (START_NODE, END_NODE)])
    return inner.unionByName(edges.select(group).distinct().select(group, F.inline(ends)))


def assemble(edges: DataFrame, blocks: DataFrame, group: str = "block_group_id") -> DataFrame:
    """(group, source node and start and end, target node and start and end, layers).

    An edge joins the block that ends where it leaves to the block that starts where it enters; an edge without
    such blocks is left out. The layers of one pair are a sorted array of (edge_id, strands, chromosome_index, phased).
    """
    src = blocks.select(group, F.col("node_id").alias("source_node_id"), F.col("start").alias("source_start"), F.col("end").alias("source_coordinate"))
    tgt = blocks.select(group, F.col("node_id").alias("target_node_id"), F.col("start").alias("target_coordinate"), F.col("end").alias("target_end"))
    layer = F.struct("edge_id", "source_strand", "target_strand", "chromosome_index", "phased")
    pair = [group, "source_node_id", "source_start", "source_coordinate", "target_node_id", "target_coordinate", "target_end"]
    return (
        edges.join(src, [group, "source_node_id", "source_coordinate"])
        .join(tgt, [group, "target_node_id", "target_coordinate"])
        .groupBy(*pair)
        .agg(F.sort_array(F.collect_list(layer)).alias("layers"))
        .withColumnRenamed("source_coordinate", "source_end")
        .withColumnRenamed("target_coordinate", "target_start")
    )


def graph(edges: DataFrame, group: str = "block_group_id") -> DataFrame:
    """assemble(edges, split(edges)) in two shuffles and without joins.

    The ends of all edges meet by node, where a running maximum gives each the boundary before or after it; then the two
    ends of an edge meet by the place where it leaves, and so do the edges of a pair, and of a block.
    """
    own = ["edge_id", "source_node_id", "source_coordinate", "source_strand", "target_node_id", "target_coordinate", "target_strand", "chromosome_index", "phased"]
    end = lambda side: F.struct(F.lit(side == "source").alias("_out"), F.col(f"{side}_node_id").alias("_node"), F.col(f"{side}_coordinate").alias("_at"))
    ends = edges.select(group, *own, F.inline(F.array(end("source"), end("target"))))
    node = W.partitionBy(group, "_node")
    before = F.max("_at").over(node.orderBy("_at").rangeBetween(W.unboundedPreceding, -1))
    after = F.min("_at").over(node.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, -1))
    terminal = is_terminal("_node")
    virtual = F.when(F.col("_at") == 0, F.lit(0).cast("long"))  # the blocks of the virtual nodes have no length
    far = F.when(F.col("_out"), F.when(terminal, virtual).otherwise(before)).otherwise(F.when(terminal, virtual).otherwise(after))
    placed = ends.withColumn("_far", far).where("_far is not null")
    whole = (
        placed.repartition(group, "source_node_id", "source_coordinate")
        .groupBy(group, *own)
        .agg(F.max(F.when(F.col("_out"), F.col("_far"))).alias("source_start"), F.max(F.when(~F.col("_out"), F.col("_far"))).alias("target_end"))
        .where("source_start is not null and target_end is not null")
    )
    pair = [group, "source_node_id", "source_start", "source_coordinate", "target_node_id", "target_coordinate", "target_end"]
    layer = F.struct("edge_id", "source_strand", "target_strand", "chromosome_index", "phased")
    return (
        whole.groupBy(*pair)
        .agg(F.sort_array(F.collect_list(layer)).alias("layers"))
        .withColumnRenamed("source_coordinate", "source_end")
        .withColumnRenamed("target_coordinate", "target_start")
    )


def pruned(pairs: DataFrame, group: str = "block_group_id") -> DataFrame:
    """Of a source block's edges on one layer (but -1) the newest stays; the others' node pairs go, with all their layers."""
    source = [group, "source_node_id", "source_start", "source_end"]
    pair = [*source, "target_node_id", "target_start", "target_end"]
    each = pairs.select(*pair, F.explode("layers").alias("x"))
    best = F.max("x.edge_id").over(W.partitionBy(*source, "x.chromosome_index"))
    lost = (F.col("x.chromosome_index") != -1) & (F.col("x.edge_id") < best)
    kept = each.withColumn("_lost", lost).groupBy(*pair).agg(F.sort_array(F.collect_list("x")).alias("layers"), F.max("_lost").alias("_lost"))
    return kept.where("not _lost").drop("_lost")


def boundary_links(pairs: DataFrame, blocks: DataFrame, group: str = "block_group_id") -> DataFrame:
    """Links that a block without an edge on one side has to the neighbouring block of its node."""
    inner = blocks.where(~is_terminal("node_id"))
    out = pairs.select(group, F.col("source_node_id").alias("node_id"), F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    into = pairs.select(group, F.col("target_node_id").alias("node_id"), F.col("target_start").alias("start"), F.col("target_end").alias("end"))
    key = [group, "node_id", "start", "end"]
    no_out, no_in = inner.join(out, key, "left_anti"), inner.join(into, key, "left_anti")
    right = inner.select(group, "node_id", F.col("start").alias("end"), F.col("end").alias("next_end"))
    left = inner.select(group, "node_id", F.col("end").alias("start"), F.col("start").alias("last_start"))
    after = no_out.join(right, [group, "node_id", "end"]).select(group, "node_id", "start", F.col("end").alias("at"), F.col("next_end").alias("end"))
    before = no_in.join(left, [group, "node_id", "start"]).select(group, "node_id", F.col("last_start").alias("start"), F.col("start").alias("at"), "end")
    return after.unionByName(before).distinct()
