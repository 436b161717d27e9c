"""Queries of differences, annotations, exports and the operation log."""

from pyspark.sql import functions as F

from strandwork.operators import diffs as D
from strandwork.operators import versions as V
from strandwork.plans.graph_queries import _SPELL, sequences_of_paths
from strandwork.plans.project import Projected
from strandwork.plans.register import query
from strandwork.sources import sinks


def _two(p: Projected):
    """Our paths, and theirs: the same without each line whose part is divisible by 5, cut short where its number is even."""
    ours = p.path_blocks().select("path_id", "block", "node_id", "start", "end", "part", "path_start", "path_end")
    cut = p.steps().where("part % 5 <> 0").withColumn("length", F.when(F.col("line") % 2 == 0, F.greatest(F.lit(1).cast("long"), F.col("length") - 3)).otherwise(F.col("length")))
    from pyspark.sql import Window as W

    past = F.sum("length").over(W.partitionBy("path_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    theirs = cut.select("path_id", F.col("idx").alias("block"), "node_id", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), (past - F.col("length")).alias("path_start"), past.alias("path_end"))
    return ours, theirs


_TWO = """theirs as (select path_id, block, node_id, 0 as start, n as "end", cast(sum(n) over (partition by path_id order by block) as bigint) - n as path_start, cast(sum(n) over (partition by path_id order by block) as bigint) as path_end
  from (select path_id, idx as block, node_id, case when line % 2 = 0 then greatest(1, length - 3) else length end as n from steps where part % 5 <> 0)),
 raw_maps as (select a.path_id, a.path_start + greatest(a.start, b.start) - a.start as s0, a.path_start + least(a."end", b."end") - a.start as s1, b.path_start + greatest(a.start, b.start) - b.start as t0, b.path_start + least(a."end", b."end") - b.start as t1
  from pblocks a join theirs b on a.path_id = b.path_id and a.node_id = b.node_id and a.start < b."end" and b.start < a."end"),
 maps as (select path_id, min(s0) as s0, max(s1) as s1, min(t0) as t0, max(t1) as t1 from (select *, sum(new) over (partition by path_id order by s0) as island from (
  select *, case when lag(s1) over o = s0 and lag(t1) over o = t0 then 0 else 1 end as new from raw_maps window o as (partition by path_id order by s0))) group by path_id, island)"""


@query(f"with {_TWO} select * from maps")
def block_mappings(p: Projected):
    return D.mappings(*_two(p), ["path_id"])


@query(f"""with {_TWO}, lens as (select path_id, max(path_end) as length from pblocks group by 1)
 select path_id, s0 as start, s1 as "end", true as shared from maps
 union all select * from (select path_id, coalesce(lag(s1) over (partition by path_id order by s0), 0) as start, s0 as "end", false from maps) where start < "end"
 union all select * from (select l.path_id, coalesce(max(s1), 0) as start, length as "end", false from lens l left join maps m on l.path_id = m.path_id group by l.path_id, length) where start < "end" """)
def sample_diff(p: Projected):
    ours, theirs = _two(p)
    lengths = ours.groupBy("path_id").agg(F.max("path_end").alias("length"))
    return D.regions(D.mappings(ours, theirs, ["path_id"]), lengths, ["path_id"])


@query(f"""with {_TWO}, a as (select path_id, block as name, path_start + 2 as s, path_start + 2 + 13 * line as e from pblocks),
 m as (select a.*, arg_min(struct_pack(s0 := s0, s1 := s1, t0 := t0, t1 := t1), s0) as f, arg_max(struct_pack(s0 := s0, s1 := s1, t0 := t0, t1 := t1), s0) as l from a join maps on a.path_id = maps.path_id and s < s1 and s0 < e group by a.path_id, a.name, a.s, a.e)
 select path_id, name, case when s between f.s0 and f.s1 then f.t0 + s - f.s0 else f.t0 end as start, case when e between l.s0 and l.s1 then l.t0 + e - l.s0 else l.t1 end as "end" from m""")
def propagate_annotations(p: Projected):
    ours, theirs = _two(p)
    line = p.steps().select("path_id", F.col("idx").alias("name"), "line")
    a = ours.select("path_id", F.col("block").alias("name"), (F.col("path_start") + 2).alias("start")).join(line, ["path_id", "name"]).withColumn("end", F.col("start") + 13 * F.col("line")).drop("line")
    return D.carried(a, D.mappings(ours, theirs, ["path_id"]), ["path_id"])


def _marks(p: Projected):
    return p.path_blocks().select("path_id", F.col("block").alias("name"), (F.col("path_start") + F.col("line")).alias("start"), (F.col("path_start") + F.col("line") + 30).alias("end"))


@query("""select a.path_id, a.name, b.node_id, greatest(s, path_start) as start, least(e, path_end) as "end" from (select path_id, block as name, path_start + line as s, path_start + line + 30 as e from pblocks) a join pblocks b on a.path_id = b.path_id and s < path_end and path_start < e""")
def translate_bed(p: Projected):
    return D.translate(_marks(p), p.path_blocks(), "path_id")


@query("""select a.path_id, a.name, b.node_id, greatest(s, path_start + 1) as start, least(e, path_end) as "end" from (select path_id, block as name, path_start + line as s, path_start + line + 30 as e from pblocks) a join pblocks b on a.path_id = b.path_id and s < path_end and path_start + 1 < e""")
def translate_gff(p: Projected):
    return D.translate(_marks(p), p.path_blocks(), "path_id", gff=True)


@query(f"select path_id, '>p' || path_id || chr(10) || sequence as record from ({_SPELL})")
def fasta_lines(p: Projected):
    s = sequences_of_paths(p).select("path_id", F.concat(F.lit("p"), F.col("path_id").cast("string")).alias("name"), "sequence")
    return s.select("path_id", sinks.fasta_record("name", "sequence").alias("record"))


@query("""select distinct 'S' || chr(9) || b.node_id || '.' || b.start || '.' || b."end" || chr(9) || substr(sequence, b.start + 1, b."end" - b.start) as line from blocks b join steps s using (node_id) join seqs on part = p_partkey
 union all select distinct 'L' || chr(9) || source_node_id || '.' || source_start || '.' || source_end || chr(9) || source_strand || chr(9) || target_node_id || '.' || target_start || '.' || target_end || chr(9) || target_strand || chr(9) || '0M' from pairs where source_node_id > 2 and target_node_id > 2""")
def gfa_lines(p: Projected):
    from strandwork.operators import blocks as B

    e = p.edges()
    blocks = B.split(e)
    segments = sinks.segment_lines(blocks, p.node_sequences().select("node_id", "sequence"))
    return segments.unionByName(sinks.link_lines(B.graph(e)))


@query("""select path_id, 'P' || chr(9) || 'P-' || path_id || chr(9) || string_agg(node_id || '.0.' || length || strand, ',' order by idx) || chr(9) || '*' as line from steps group by path_id""")
def gfa_paths(p: Projected):
    b = p.path_blocks().withColumn("name", F.concat(F.lit("p"), F.col("path_id").cast("string")))
    return sinks.path_lines(b, ["path_id"], "name", "block")


@query("""select path_id, chunk, node_id || '.' || chunk * 7 || '.' || least(length, chunk * 7 + 7) as segment from steps, unnest(range(0, (length + 6) // 7)) as u(chunk)""")
def gfa_chunks(p: Projected):
    got = sinks.chunked(p.path_blocks().select("path_id", "node_id", "start", "end"), 7)
    return got.select("path_id", "chunk", F.concat_ws(".", F.col("node_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")).alias("segment"))


@query("""select p_partkey, side, '>' || p_partkey || '_' || side || chr(10) || flank as record from (select p_partkey, unnest(['left', 'right']) as side, unnest([case when p_size % 4 = 0 then '' else substr(sequence, 1, 9) end, substr(sequence, 20, 9)]) as flank from seqs join part using (p_partkey)) where flank <> ''""")
def csv_to_fasta(p: Projected):
    rows = p.sequences().join(p.raw("part").select("p_partkey", "p_size"), "p_partkey")
    left = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.substring("sequence", 1, 9))
    flanks = rows.select("p_partkey", F.col("p_partkey").cast("string").alias("id"), left.alias("left"), F.substring("sequence", 20, 9).alias("right"))
    return sinks.flank_records(flanks, ["p_partkey"])


@query("""select path_id, '"' || node_id || '" [label="' || (case when length <= 7 then s else substr(s, 1, 3) || '...' || right(s, 3) end) || '"]' as line from (select path_id, node_id, length, substr(sequence, 1, length) as s from steps join seqs on part = p_partkey)""")
def dot_lines(p: Projected):
    b = p.path_blocks().select("path_id", "node_id", "start", "end").join(p.node_sequences().select("node_id", "sequence"), "node_id")
    return sinks.dot_nodes(b, ["path_id"])


@query("""with recursive up as (select hash as start, hash, parent_hash, 0 as depth from ops union all select u.start, o.hash, o.parent_hash, u.depth + 1 from up u join ops o on o.hash = u.parent_hash) select start, hash, depth from up""")
def op_upstream(p: Projected):
    ops = p.operations()
    return V.upstream(ops, ops.select("hash"))


def _heads(ops):
    return ops.groupBy("user_id").agg(F.max("hash").alias("source"), F.min("hash").alias("target"))


@query("""with recursive pr as (select user_id, max(hash) as source, min(hash) as target from ops group by 1),
 up as (select hash as start, hash, parent_hash, 0 as depth from ops where hash in (select source from pr union select target from pr) union all select u.start, o.hash, o.parent_hash, u.depth + 1 from up u join ops o on o.hash = u.parent_hash),
 c as (select source, target, min(s.depth) as ds0, min(t.depth) as dt0 from pr join up s on s.start = source join up t on t.start = target and t.hash = s.hash group by 1, 2)
 select c.source, target, depth as step, hash, 'incoming' as direction from c join up on start = c.source and depth < ds0
 union all select source, c.target, ds0 + dt0 - 1 - depth, hash, 'outgoing' from c join up on start = c.target and depth < dt0""")
def op_path_between(p: Projected):
    ops = p.operations()
    return V.path_between(ops, _heads(ops).select("source", "target"))


@query("""with recursive h as (select user_id as branch_id, max(hash) as hash from ops group by 1), up as (select h.branch_id, o.hash, o.parent_hash, 0 as depth from h join ops o on o.hash = h.hash
 union all select u.branch_id, o.hash, o.parent_hash, u.depth + 1 from up u join ops o on o.hash = u.parent_hash) select branch_id, hash, depth from up where hash % 7 <> 3""")
def branch_operations(p: Projected):
    ops = p.operations()
    heads = ops.groupBy(F.col("user_id").alias("branch_id")).agg(F.max("hash").alias("hash"))
    masked = ops.where("hash % 7 = 3").select(F.col("user_id").alias("branch_id"), F.col("hash").alias("operation_hash"))
    return V.visible(ops, heads, masked)


@query("select hash, user_id as position from ops where hash % 2 = 1 and user_id >= (select min(user_id) from ops where hash % 2 = 1 and branch = 'click')")
def merge_ops(p: Projected):
    ops = p.operations()
    theirs = ops.where("hash % 2 = 1").select("hash", F.col("user_id").alias("position"))
    return V.to_merge(ops.where("branch <> 'click'").select("hash"), theirs)


_CREATED = "block_group_id % 3 = 0"


@query("""select 'nodes' as kind, cast(n as varchar) as id from (select source_node_id as n from edges where block_group_id % 3 = 0 union select target_node_id from edges where block_group_id % 3 = 0) where n not in (select node_id from steps where path_id % 3 = 0 and idx % 2 = 0)
 union all select 'sequences', h from (select distinct sha256('DNA;' || sequence || ';;;') as h from steps join seqs on part = p_partkey where path_id % 3 = 0 and idx % 2 = 0)
 union all select 'block_groups', cast(block_group_id as varchar) from (select distinct block_group_id from edges where block_group_id % 3 = 0 and block_group_id not in (select id from bgs where sample_name is null))""")
def changeset_dependencies(p: Projected):
    e = p.edges().where(_CREATED).withColumn("id", F.col("edge_id"))
    nodes = p.node_sequences().join(p.steps().where("path_id % 3 = 0 and idx % 2 = 0").select("node_id"), "node_id").select(F.col("node_id").alias("id"), F.col("hash").alias("sequence_hash"))
    created = {"edges": e, "nodes": nodes, "block_group_edges": e.select("block_group_id", "edge_id"), "block_groups": p.block_groups().where("sample_name is null").select("id")}
    found = V.dependencies(created)
    rows = [found["nodes"].select(F.lit("nodes").alias("kind"), F.col("id").cast("string").alias("id")), found["sequences"].select(F.lit("sequences").alias("kind"), F.col("hash").alias("id"))]
    rows.append(found["block_groups"].select(F.lit("block_groups").alias("kind"), F.col("id").cast("string").alias("id")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("select block_group_id, edge_id, case when source_node_id > 2 and source_node_id % 2 = 0 then -source_node_id else source_node_id end as source_node_id, case when target_node_id > 2 and target_node_id % 2 = 0 then -target_node_id else target_node_id end as target_node_id from edges")
def apply_remap(p: Projected):
    ids = p.steps().where("node_id % 2 = 0").select(F.col("node_id").alias("old_id"), (-F.col("node_id")).alias("new_id"))
    return V.replayed(p.edges().select("block_group_id", "edge_id", "source_node_id", "target_node_id"), ids)


@query("select block_group_id, edge_id from edges where edge_id % 10000 < 2000")
def revert(p: Projected):
    e = p.edges().select("block_group_id", "edge_id")
    return V.reverted(e, e.where("edge_id % 10000 >= 2000"), ["block_group_id", "edge_id"])


@query("select distinct 'f' || o_custkey as file_path from orders where o_custkey % 4 <> 1 union select unnest(['graph.db', 'default.db'])")
def manifest_diff(p: Projected):
    files = p.raw("orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_path"), "o_custkey")
    return V.new_files(files, files.where("o_custkey % 4 = 1"), ["graph.db", "default.db"])


@query("select count(*) as children from ops where parent_hash = 5 and hash not in (select hash from ops where hash % 7 = 3)")
def bifurcation_guard(p: Projected):
    ops = p.operations()
    return ops.where("parent_hash = 5").join(ops.where("hash % 7 = 3").select("hash"), "hash", "left_anti").agg(F.count(F.lit(1)).alias("children"))
