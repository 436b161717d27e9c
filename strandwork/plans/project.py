"""Projection of the star-schema test tables onto the graph model, as DataFrames and as SQL.

Orders are block groups with one path each; line items are the path's steps; parts are sequences. Ids are made of the
row's own keys, so no numbering meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.scalars import sequence_hash
from strandwork.schema import END_NODE, START_NODE

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"


class Projected:
    """Model tables of one data directory; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sequences(self) -> DataFrame:
        """(p_partkey, sequence, hash)"""
        seq = F.translate(F.sha2("p_name", 256), HEX, DNA)
        return self.raw("part").select("p_partkey", "p_name", seq.alias("sequence"), sequence_hash(F.lit("DNA"), seq).alias("hash"))

    def block_groups(self) -> DataFrame:
        sample = F.when(F.col("o_orderstatus") != "O", F.col("o_custkey").cast("string"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("collection_name"), sample.alias("sample_name"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("name")
        )

    def steps(self) -> DataFrame:
        """(path_id, idx, node_id, part, length, strand, line, status)"""
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        li = self.raw("lineitem").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
        return li.select(
            F.col("l_orderkey").alias("path_id"),
            "idx",
            (F.col("l_orderkey") * 1000 + F.col("idx") + 3).alias("node_id"),
            F.col("l_partkey").alias("part"),
            F.col("l_quantity").cast("long").alias("length"),
            F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
            F.col("l_linenumber").cast("long").alias("line"),
            F.col("l_linestatus").alias("status"),
        )

    def node_sequences(self) -> DataFrame:
        return self.steps().join(self.sequences(), F.col("part") == F.col("p_partkey")).select("path_id", "node_id", "sequence", "hash")

    def edges(self, skips: bool = True) -> DataFrame:
        """Edges with their group and layer: the path's own (layer 0), and for lines of status F one that leaves the node at half its
        length for the node after the next, on a layer of their own unless their number is divisible by 3, with a healing edge there."""
        order = W.partitionBy("path_id").orderBy("idx")
        s = self.steps().withColumn("nxt", F.lead(F.struct("node_id", "strand")).over(order)).withColumn("after", F.lead(F.struct("node_id", "strand"), 2).over(order))
        half = F.greatest(F.lit(1).cast("long"), F.floor(F.col("length") / 2))
        z = F.lit(0).cast("long")

        def row(number, sn, sc, ss, tn, tc, ts, layer):
            values = {"edge_id": F.col("path_id") * 10000 + number, "index_in_path": F.when(number < 2000, number), "source_node_id": sn, "source_coordinate": sc, "source_strand": ss, "target_node_id": tn, "target_coordinate": tc, "target_strand": ts, "chromosome_index": layer, "phased": z}
            return F.struct(*[v.alias(k) for k, v in values.items()])

        plus, idx = F.lit("+"), F.col("idx")
        own = (F.col("node_id"), F.col("strand"))
        first = row(z, F.lit(START_NODE).cast("long"), z, plus, own[0], z, own[1], z)
        on = row(idx + 1, own[0], F.col("length"), own[1], F.coalesce("nxt.node_id", F.lit(END_NODE).cast("long")), z, F.coalesce("nxt.strand", plus), z)
        skip = row(idx + 2000, own[0], half, own[1], F.col("after.node_id"), z, F.col("after.strand"), F.when(F.col("line") % 3 == 0, z).otherwise(F.col("line")))
        heal = row(idx + 4000, own[0], half, own[1], own[0], half, own[1], z)
        has = (F.col("status") == "F") & F.col("after").isNotNull()
        if not skips:
            has = F.lit(False)
        every = F.array(F.when(idx == 0, first), on, F.when(has, skip), F.when(has & (half < F.col("length")), heal))
        # no edge lacks phased; filtering the array would keep its rows out of generated code
        return s.select(F.col("path_id").alias("block_group_id"), F.inline(every)).where("phased is not null")

    def path_edges(self) -> tuple[DataFrame, DataFrame]:
        """(path_edges, edges) of the paths alone."""
        e = self.edges(skips=False)
        return e.select(F.col("block_group_id").alias("path_id"), "index_in_path", "edge_id"), e.drop("index_in_path", "block_group_id").withColumnRenamed("edge_id", "id")

    def path_blocks(self) -> DataFrame:
        """Blocks of every path with their offsets, from the steps alone: one shuffle by path."""
        past = F.sum("length").over(W.partitionBy("path_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
        return self.steps().select(
            "path_id", F.col("idx").alias("block"), "node_id", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), "strand", "part", "line", "status",
            (past - F.col("length")).alias("path_start"), past.alias("path_end"),
        )

    def operations(self) -> DataFrame:
        """(hash, parent_hash, branch): a user's events in order are a chain of operations."""
        parent = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
        return self.raw("events").select(F.col("event_id").alias("hash"), parent.alias("parent_hash"), "user_id", F.col("event_type").alias("branch"))


#: The same tables as common table expressions.
SQL = f"""
seqs as (select p_partkey, p_name, translate(sha256(p_name), '{HEX}', '{DNA}') as sequence from part),
bgs as (select o_orderkey as id, o_orderpriority as collection_name,
  case when o_orderstatus <> 'O' then cast(o_custkey as varchar) end as sample_name, 'g' || o_orderkey as name from orders),
steps as (select l_orderkey as path_id, idx, l_orderkey * 1000 + idx + 3 as node_id, l_partkey as part, cast(l_quantity as bigint) as length,
  case when l_returnflag = 'R' then '-' else '+' end as strand, cast(l_linenumber as bigint) as line, l_linestatus as status
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as idx from lineitem)),
w as (select *, lead(node_id) over o as n1, lead(strand) over o as s1, lead(node_id, 2) over o as n2, lead(strand, 2) over o as s2, greatest(1, length // 2) as half
  from steps window o as (partition by path_id order by idx)),
backbone as (
  select path_id as block_group_id, path_id * 10000 as edge_id, 0 as index_in_path, 1 as source_node_id, 0 as source_coordinate, '+' as source_strand,
    node_id as target_node_id, 0 as target_coordinate, strand as target_strand, 0 as chromosome_index, 0 as phased from w where idx = 0
  union all select path_id, path_id * 10000 + idx + 1, idx + 1, node_id, length, strand, coalesce(n1, 2), 0, coalesce(s1, '+'), 0, 0 from w),
edges as (select * from backbone
  union all select path_id, path_id * 10000 + idx + 2000, null, node_id, half, strand, n2, 0, s2, case when line % 3 = 0 then 0 else line end, 0 from w where status = 'F' and n2 is not null
  union all select path_id, path_id * 10000 + idx + 4000, null, node_id, half, strand, node_id, half, strand, 0, 0 from w where status = 'F' and n2 is not null and half < length),
pblocks as (select path_id, idx as block, node_id, 0 as start, length as "end", strand, part, line, status,
  cast(sum(length) over (partition by path_id order by idx) as bigint) - length as path_start, cast(sum(length) over (partition by path_id order by idx) as bigint) as path_end from steps),
bounds as (select block_group_id, source_node_id as node_id, source_coordinate as pos from edges union select block_group_id, target_node_id, target_coordinate from edges),
blocks as (select block_group_id, node_id, pos as start, "end" from (select *, lead(pos) over (partition by block_group_id, node_id order by pos) as "end" from bounds where node_id not in (1, 2)) where "end" is not null
  union all select distinct block_group_id, n, 0, 0 from edges, (values (1), (2)) as v(n)),
pairs as (select e.block_group_id, e.source_node_id, s.start as source_start, e.source_coordinate as source_end, e.target_node_id, e.target_coordinate as target_start, t."end" as target_end,
    e.edge_id, e.chromosome_index, e.source_strand, e.target_strand
  from edges e join blocks s on s.block_group_id = e.block_group_id and s.node_id = e.source_node_id and s."end" = e.source_coordinate
  join blocks t on t.block_group_id = e.block_group_id and t.node_id = e.target_node_id and t.start = e.target_coordinate),
losers as (select distinct block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end
  from (select *, max(edge_id) over (partition by block_group_id, source_node_id, source_start, source_end, chromosome_index) as best from pairs where chromosome_index <> -1) where edge_id < best),
kept as (select p.* from pairs p anti join losers using (block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end)),
ops as (select event_id as hash, lag(event_id) over (partition by user_id order by ts, event_id) as parent_hash, user_id, event_type as branch from events)
"""


def needs(sql: str) -> str:
    """``with`` the common table expressions that a query uses, directly or not."""
    import re

    parts = dict(re.findall(r"^(\w+) as (\(.*?)(?=^\w+ as \(|\Z)", SQL.strip() + "\n", re.S | re.M))
    used, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in parts.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(body)
    own = [f"{n} as {b.strip().rstrip(',')}" for n, b in parts.items() if n in used]
    if not own:
        return sql
    recursive = re.match(r"\s*with recursive\s", sql, re.I)
    if recursive:
        return "with recursive " + ",\n".join(own) + ",\n" + sql[recursive.end() :]
    if re.match(r"\s*with\s", sql, re.I):
        return "with " + ",\n".join(own) + ",\n" + re.sub(r"^\s*with\s", "", sql, flags=re.I)
    return "with " + ",\n".join(own) + "\n" + sql
