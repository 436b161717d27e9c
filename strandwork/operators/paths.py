"""Paths: their blocks, offsets, sequences and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.scalars import is_terminal, slice_of, spelled
from strandwork.operators.joins import overlap_join

BEFORE, AFTER = -(1 << 63), (1 << 63) - 1


def ordered_edges(path_edges: DataFrame, edges: DataFrame) -> DataFrame:
    return path_edges.select("path_id", "index_in_path", "edge_id").join(edges.withColumnRenamed("id", "edge_id"), "edge_id")


def path_blocks(path_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, block, node_id, start, end, strand, path_start, path_end) from each two neighbouring edges."""
    order = W.partitionBy("path_id").orderBy("index_in_path")
    e = ordered_edges(path_edges, edges)
    block = e.select(
        "path_id",
        F.col("index_in_path").alias("block"),
        F.col("target_node_id").alias("node_id"),
        F.col("target_coordinate").alias("start"),
        F.lead("source_coordinate").over(order).alias("end"),
        F.col("target_strand").alias("strand"),
    ).where("end is not null")
    past = F.sum(F.col("end") - F.col("start")).over(W.partitionBy("path_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    return block.withColumn("path_end", past).withColumn("path_start", F.col("path_end") - (F.col("end") - F.col("start")))


def with_sentinels(blocks: DataFrame) -> DataFrame:
    """The blocks, one of node -1 before the path and one of node -2 from its end on."""
    ends = blocks.groupBy("path_id").agg(F.max("path_end").alias("n"), F.max("block").alias("last"))
    far = F.array(
        F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("node_id"), F.lit(BEFORE).alias("path_start"), F.lit(0).cast("long").alias("path_end")),
        F.struct((F.col("last") + 1).alias("block"), F.lit(-2).cast("long").alias("node_id"), F.col("n").alias("path_start"), F.lit(AFTER).alias("path_end")),
    )
    zero = F.lit(0).cast("long")
    extra = ends.select("path_id", F.inline(far)).select(
        "path_id", F.col("block").cast("long").alias("block"), "node_id", zero.alias("start"), zero.alias("end"), F.lit("+").alias("strand"), "path_end", "path_start"
    )
    return blocks.withColumn("block", F.col("block").cast("long")).unionByName(extra)


def joined_in_order(order: str, text: str) -> Column:
    """The texts of a group, one after the other."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "")


def path_sequences(blocks: DataFrame, node_sequences: DataFrame) -> DataFrame:
    """(path_id, sequence): the slices of all blocks, those of the minus strand as their reverse complement."""
    spelled_blocks = blocks.join(node_sequences.select("node_id", "sequence"), "node_id").select(
        "path_id", "block", spelled(slice_of("sequence", "start", "end"), "strand").alias("piece")
    )
    return spelled_blocks.groupBy("path_id").agg(joined_in_order("block", "piece").alias("sequence"))


def path_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path_id").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def problems(path_edges: DataFrame, edges: DataFrame, block_group_edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Number of faults of each path, by kind; a path is valid if all but ``repeated`` are zero."""
    order = W.partitionBy("path_id").orderBy("index_in_path")
    e = ordered_edges(path_edges, edges)
    nxt = lambda c: F.lead(c).over(order)
    step = e.select(
        "path_id",
        "edge_id",
        (nxt("source_node_id") != F.col("target_node_id")).alias("node"),
        ((nxt("source_node_id") == F.col("target_node_id")) & (F.col("target_coordinate") >= nxt("source_coordinate"))).alias("coordinate"),
        (nxt("source_strand") != F.col("target_strand")).alias("strand"),
        ((F.col("source_node_id") == F.col("target_node_id")) & (F.col("source_coordinate") == F.col("target_coordinate"))).alias("loop"),
    )
    member = paths.select(F.col("id").alias("path_id"), "block_group_id").join(block_group_edges.select("block_group_id", "edge_id").distinct(), "block_group_id")
    known = step.join(member.select("path_id", "edge_id", F.lit(1).alias("known")), ["path_id", "edge_id"], "left")
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"bad_{c}")
    return known.groupBy("path_id").agg(
        (F.count("edge_id") - F.count_distinct("edge_id")).alias("repeated"),
        F.sum(F.col("known").isNull().cast("long")).alias("outside"),
        *[total(c) for c in ("node", "coordinate", "strand", "loop")],
    )


def current_paths(paths: DataFrame) -> DataFrame:
    """The path of the highest id of each block group."""
    return paths.groupBy("block_group_id").agg(F.max_by(F.struct("id", "name"), "id").alias("p")).select("block_group_id", "p.id", "p.name")


def clipped(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range (path_id, range_id, from, to): the overlapping blocks' slices, neighbours of one node that adjoin as one."""
    pieces = overlap_join(blocks, ranges, ["path_id"], ("path_start", "path_end"), ("from", "to"))
    cut = pieces.select(
        "path_id",
        "range_id",
        "block",
        "node_id",
        "strand",
        (F.col("start") + F.greatest(F.col("from") - F.col("path_start"), F.lit(0))).alias("start"),
        (F.col("end") - F.greatest(F.col("path_end") - F.col("to"), F.lit(0))).alias("end"),
    )
    order = W.partitionBy("path_id", "range_id").orderBy("block")
    joins = (F.lag("node_id").over(order) == F.col("node_id")) & (F.lag("end").over(order) == F.col("start"))
    island = F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        cut.withColumn("piece", island)
        .groupBy("path_id", "range_id", "piece", "node_id", "strand")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


def replaced_span(path_edges: DataFrame, edges: DataFrame, blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Edges of each path with [from, to) leading through a new node: (path_id, index_in_path, edge_id).

    spans: (path_id, from, to, edge_in, edge_out). What comes before the block at ``from`` and after the one at ``to`` stays.
    """
    inside = blocks.join(spans, "path_id")
    first = inside.where("path_start <= `from` and `from` < path_end").select("path_id", F.col("block").alias("b0"))
    last = inside.where("path_start < `to` and `to` <= path_end").select("path_id", F.col("block").alias("b1"))
    held = path_edges.select("path_id", "index_in_path", "edge_id").join(spans, "path_id").join(first, "path_id").join(last, "path_id")
    keep = held.where("index_in_path <= b0 or index_in_path > b1").select("path_id", F.col("index_in_path").cast("double").alias("o"), "edge_id")
    new = F.array(
        F.struct((F.col("b0") + 0.25).cast("double").alias("o"), F.col("edge_in").alias("edge_id")),
        F.struct((F.col("b0") + 0.5).cast("double").alias("o"), F.col("edge_out").alias("edge_id")),
    )
    added = spans.join(first, "path_id").select("path_id", F.inline(new))
    order = W.partitionBy("path_id").orderBy("o")
    return keep.unionByName(added).select("path_id", (F.row_number().over(order) - 1).cast("long").alias("index_in_path"), "edge_id")


def terminal_free(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_terminal("node_id"))
