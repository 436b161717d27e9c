"""Queries of blocks, paths, graph walks and updates."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.scalars import segment_id
from strandwork.operators import blocks as B
from strandwork.operators import graphs as G
from strandwork.operators import paths as P
from strandwork.operators import updates as U
from strandwork.plans.project import Projected
from strandwork.plans.register import query

PAIR = "block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end"
PAIR_NAMES = PAIR.split(", ")


@query('select block_group_id, node_id, start, "end" from blocks')
def block_split(p: Projected):
    return B.split(p.edges())


@query('select block_group_id, node_id, start, row_number() over (partition by block_group_id order by sha256(cast(node_id as varchar)), node_id, start) - 1 as number from blocks where node_id > 2')
def block_numbers(p: Projected):
    order = W.partitionBy("block_group_id").orderBy(F.sha2(F.col("node_id").cast("string"), 256), "node_id", "start")
    return B.split(p.edges()).where("node_id > 2").select("block_group_id", "node_id", "start", (F.row_number().over(order) - 1).cast("long").alias("number"))


@query(f"select {PAIR}, count(*) as layers, max(edge_id) as newest from pairs group by all")
def graph_assemble(p: Projected):
    got = B.graph(p.edges())
    return got.select(*PAIR_NAMES, F.size("layers").cast("long").alias("layers"), F.array_max("layers.edge_id").alias("newest"))


@query("""select coalesce(sample_name, '') as sample, collection_name, count(*) as links, cast(sum(n) as bigint) as layers from (select block_group_id, source_node_id, source_start, target_node_id, target_start, count(*) as n from pairs group by all) x
 join bgs b on b.id = x.block_group_id group by sample_name, collection_name""")
def sample_graph(p: Projected):
    g = B.graph(p.edges()).select("block_group_id", F.size("layers").alias("n")).join(p.block_groups().withColumnRenamed("id", "block_group_id"), "block_group_id")
    return g.groupBy("sample_name", "collection_name").agg(F.count(F.lit(1)).alias("links"), F.sum("n").alias("layers")).select(F.coalesce("sample_name", F.lit("")).alias("sample"), "collection_name", "links", "layers")


@query('select path_id, block, node_id, start, "end", strand, path_start, path_end from pblocks')
def path_blocks(p: Projected):
    return P.path_blocks(*p.path_edges()).select("path_id", "block", "node_id", "start", "end", "strand", "path_start", "path_end")


@query(f"select path_id, node_id, path_start, path_end from pblocks union all select distinct path_id, -1, {P.BEFORE}, 0 from pblocks union all select path_id, -2, max(path_end), {P.AFTER} from pblocks group by path_id")
def path_sentinels(p: Projected):
    return P.with_sentinels(p.path_blocks().select("path_id", "block", "node_id", "start", "end", "strand", "path_end", "path_start")).select("path_id", "node_id", "path_start", "path_end")


_SPELL = """select path_id, string_agg(case when strand = '-' then reverse(translate(substr(sequence, 1, length), 'ACGT', 'TGCA')) else substr(sequence, 1, length) end, '' order by idx) as sequence
 from steps join seqs on part = p_partkey group by path_id"""


def sequences_of_paths(p: Projected):
    b = p.path_blocks().join(p.sequences().select(F.col("p_partkey").alias("part"), "sequence"), "part")
    piece = P.spelled(P.slice_of("sequence", "start", "end"), "strand")
    return b.select("path_id", "block", piece.alias("piece")).groupBy("path_id").agg(P.joined_in_order("block", "piece").alias("sequence"))


@query(_SPELL)
def path_sequence(p: Projected):
    return sequences_of_paths(p)


@query("select path_id, cast(sum(length) as bigint) as length from steps group by 1")
def path_length(p: Projected):
    return P.path_lengths(p.path_blocks())


@query(f"select path_id, substr(sequence, 8, 25) as part, length(sequence) as length from ({_SPELL})")
def get_sequence(p: Projected):
    return sequences_of_paths(p).select("path_id", P.slice_of("sequence", F.lit(7), F.lit(32)).alias("part"), F.length("sequence").cast("long").alias("length"))


@query("""select path_id, count(*) - count(distinct edge_id) as repeated, count(*) filter (where edge_id % 11 = 0) as outside, coalesce(sum(cast(nn <> target_node_id as int)), 0)::bigint as bad_node,
 coalesce(sum(cast(nn = target_node_id and target_coordinate >= nc as int)), 0)::bigint as bad_coordinate, coalesce(sum(cast(ns <> target_strand as int)), 0)::bigint as bad_strand, 0::bigint as bad_loop
 from (select block_group_id as path_id, edge_id, target_node_id, target_coordinate, target_strand, lead(source_node_id) over o as nn, lead(source_coordinate) over o as nc, lead(source_strand) over o as ns
  from (select * from backbone where edge_id % 13 <> 5) window o as (partition by block_group_id order by index_in_path)) group by path_id""")
def path_validate(p: Projected):
    pe, e = p.path_edges()
    broken = pe.where("edge_id % 13 <> 5")
    member = pe.where("edge_id % 11 <> 0").select(F.col("path_id").alias("block_group_id"), "edge_id")
    paths = pe.select(F.col("path_id").alias("id")).distinct().withColumn("block_group_id", F.col("id"))
    return P.problems(broken, e, member, paths)


@query("select o_custkey as block_group_id, max(o_orderkey) as id, 'p' || max(o_orderkey) as name from orders group by 1")
def current_path(p: Projected):
    paths = p.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("block_group_id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"))
    return P.current_paths(paths)


@query("""select path_id, line as range_id, node_id, min(s) as start, max(e) as "end" from (select b.path_id, r.line, b.node_id, greatest(f - path_start, 0) as s, b."end" - greatest(path_end - t, 0) as e from pblocks b
 join (select distinct path_id, line, line * 9 as f, line * 9 + 70 as t from pblocks) r on b.path_id = r.path_id and b.path_start < r.t and r.f < b.path_end) group by all""")
def path_partition(p: Projected):
    b = p.path_blocks()
    r = b.select("path_id", F.col("line").alias("range_id"), (F.col("line") * 9).alias("from"), (F.col("line") * 9 + 70).alias("to")).distinct()
    return P.clipped(b.select("path_id", "block", "node_id", "start", "end", "strand", "path_start", "path_end"), r).select("path_id", "range_id", "node_id", "start", "end")


@query("""with sp as (select path_id, max(path_end) // 4 as f, max(path_end) * 3 // 4 as t from pblocks group by 1 having max(path_end) >= 20),
 hit as (select s.path_id, max(block) filter (where path_start <= f and f < path_end) as b0, max(block) filter (where path_start < t and t <= path_end) as b1 from sp s join pblocks b on s.path_id = b.path_id group by 1)
 select path_id, row_number() over (partition by path_id order by o) - 1 as index_in_path, edge_id from (select block_group_id as path_id, cast(index_in_path as double) as o, edge_id from backbone join hit on path_id = block_group_id where index_in_path <= b0 or index_in_path > b1
 union all select path_id, b0 + 0.25, -1 from hit union all select path_id, b0 + 0.5, -2 from hit)""")
def path_replace_span(p: Projected):
    b = p.path_blocks().select("path_id", "block", "node_id", "start", "end", "strand", "path_start", "path_end")
    n = b.groupBy("path_id").agg(F.max("path_end").alias("n")).where("n >= 20")
    lit = lambda v: F.lit(v).cast("long")
    spans = n.select("path_id", F.floor(F.col("n") / 4).alias("from"), F.floor(F.col("n") * 3 / 4).alias("to"), lit(-1).alias("edge_in"), lit(-2).alias("edge_out"))
    return P.replaced_span(*p.path_edges(), b, spans)


def _pruned(p: Projected):
    return B.pruned(B.graph(p.edges()))


@query(f"select distinct {PAIR} from kept")
def prune_edges(p: Projected):
    return _pruned(p).select(*PAIR_NAMES)


@query("""with recursive walk as (select distinct block_group_id, 1::bigint as node_id, 0::bigint as start, 0::bigint as "end" from kept
 union select k.block_group_id, k.target_node_id, k.target_start, k.target_end from walk w join kept k on k.block_group_id = w.block_group_id and k.source_node_id = w.node_id and k.source_start = w.start and k.source_end = w."end")
 select * from walk""")
def reachable(p: Projected):
    return G.reachable_blocks(_pruned(p))


_LINKS = "lk as (select distinct block_group_id as g, source_node_id as a, source_start as a0, source_end as a1, target_node_id as b, target_start as b0, target_end as b1 from pairs)"
_WALKS = """paths as (select block_group_id, ['1.0.0'] as seen, 1::bigint as node_id, 0::bigint as start, 0::bigint as "end", 0::bigint as pos, '' as spelled from (select distinct block_group_id from {t})
 union all select k.block_group_id, list_append(seen, k.target_node_id || '.' || k.target_start || '.' || k.target_end), k.target_node_id, k.target_start, k.target_end, pos + k.target_end - k.target_start, '' from paths w
 join (select distinct block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end from {t}) k on k.block_group_id = w.block_group_id and k.source_node_id = w.node_id and k.source_start = w.start and k.source_end = w."end"
 and not list_contains(seen, k.target_node_id || '.' || k.target_start || '.' || k.target_end))"""


def _named(block):
    return segment_id(block["node_id"], block["start"], block["end"])


@query(f"""with recursive {_WALKS.format(t='pairs')} select block_group_id, array_to_string(seen, ' ') as walk from paths where node_id = 2""")
def simple_paths(p: Projected):
    return G.walks(B.graph(p.edges())).select("block_group_id", F.array_join(F.transform("blocks", _named), " ").alias("walk"))


@query(f"""with recursive {_WALKS.format(t='pairs')} select block_group_id, array_to_string([seen[i] || '>' || seen[i + 1] for i in range(1, len(seen))], ' ') as links from paths where node_id = 2""")
def simple_paths_by_link(p: Projected):
    link = lambda x: F.concat(_named(x["a"]), F.lit(">"), _named(x["b"]))
    return G.walks(B.graph(p.edges())).select("block_group_id", F.array_join(F.transform(G.links_of_walk(), link), " ").alias("links"))


@query(f"""with recursive {_LINKS}, apart as (select * from lk where (a, a0) <> (b, b0)), every as (select g, a as n, a0 as n0, a1 as n1 from lk union select g, b, b0, b1 from lk),
 depth as (select g, n, n0, 0 as d from every where not exists (select 1 from apart x where x.g = every.g and x.b = every.n and x.b0 = every.n0)
 union select x.g, x.b, x.b0, d + 1 from depth join apart x on x.g = depth.g and x.a = depth.n and x.a0 = depth.n0),
 longest as (select g, n, n0, max(d) as layer from depth group by 1, 2, 3)
 select e.g as block_group_id, e.n as node_id, e.n0 as start, e.n1 as "end", layer, row_number() over (partition by e.g, layer order by e.n, e.n0, e.n1) - 1 as row from every e join longest l on l.g = e.g and l.n = e.n and l.n0 = e.n0""")
def graph_layout(p: Projected):
    return G.layout(B.graph(p.edges()))


@query(f"""with recursive fwd as (select distinct block_group_id, 1::bigint as node_id, 0::bigint as start from pairs union select k.block_group_id, k.target_node_id, k.target_start from fwd w join pairs k on k.block_group_id = w.block_group_id and k.source_node_id = w.node_id and k.source_start = w.start),
 back as (select distinct block_group_id, 2::bigint as node_id, 0::bigint as start from pairs union select k.block_group_id, k.source_node_id, k.source_start from back w join pairs k on k.block_group_id = w.block_group_id and k.target_node_id = w.node_id and k.target_start = w.start),
 inn as (select * from fwd intersect select * from back)
 select distinct p.block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end from pairs p join inn a on a.block_group_id = p.block_group_id and a.node_id = source_node_id and a.start = source_start
 join inn b on b.block_group_id = p.block_group_id and b.node_id = target_node_id and b.start = target_start""")
def intermediate_edges(p: Projected):
    return G.links_between(B.graph(p.edges()))


_PLACED = """steps2 as (select distinct block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end from pairs),
 walk as (select distinct block_group_id, 1::bigint as node_id, 0::bigint as start, 0::bigint as "end", 0::bigint as pos from steps2
 union select k.block_group_id, k.target_node_id, k.target_start, k.target_end, w.pos + k.target_end - k.target_start from walk w join steps2 k on k.block_group_id = w.block_group_id and k.source_node_id = w.node_id and k.source_start = w.start and k.source_end = w."end"),
 placed as (select block_group_id, node_id, start, "end", pos - ("end" - start) as path_start, pos as path_end from walk where node_id > 2)"""


@query(f"with recursive {_PLACED} select * from placed")
def flatten_intervals(p: Projected):
    return G.placements(B.graph(p.edges()))


@query(f"""with recursive {_PLACED} select * from placed p where not exists (select 1 from placed x join placed y on x.block_group_id = y.block_group_id and x.node_id = y.node_id
 where x.block_group_id = p.block_group_id and x.node_id = p.node_id and (x.start, x."end", x.path_start, x.path_end) <> (y.start, y."end", y.path_start, y.path_end)
 and (x.start < y."end" and y.start < x."end" or x.path_start < y.path_end and y.path_start < x.path_end))""")
def flatten_unambiguous(p: Projected):
    return G.placements_of_edges(p.edges(), drop_ambiguous=True)


@query("""with inner_blocks as (select p.path_id, row_number() over (partition by p.path_id order by p.block, case when p.strand = '-' then -b.start else b.start end) as step, b.node_id, b.start, b."end", p.strand
  from pblocks p join blocks b on b.block_group_id = p.path_id and b.node_id = p.node_id),
 walks as (select * from inner_blocks union all select distinct path_id, 0, 1, 0, 0, '+' from pblocks union all select path_id, count(*) + 1, 2, 0, 0, '+' from inner_blocks group by path_id),
 linked as (select *, lead(node_id) over o as next_node, lead(start) over o as next_start from walks window o as (partition by path_id order by step)),
 broken as (select path_id from linked l where next_node is not null and not exists (select 1 from pairs k where k.block_group_id = l.path_id and k.source_node_id = l.node_id and k.source_start = l.start and k.target_node_id = l.next_node and k.target_start = l.next_start))
 select path_id as block_group_id, path_id, step, node_id, start, "end", strand from walks where path_id not in (select path_id from broken)""")
def project_path(p: Projected):
    """All paths; one that the split graph has no walk for has no rows."""
    b = p.path_blocks().select(F.col("path_id").alias("block_group_id"), "path_id", "block", "node_id", "start", "end", "strand")
    return G.projected_paths(B.graph(p.edges()), b)


@query("""with recursive e as (select block_group_id as g, source_node_id as a, target_node_id as b from pairs where source_node_id <> 1 and target_node_id <> 2 and edge_id % 10 <> 3),
 walk as (select distinct g, a as root, a as node from (select g, a from e union select g, b from e) union select w.g, w.root, x.b from walk w join (select g, a, b from e union select g, b, a from e) x on x.g = w.g and x.a = w.node)
 select g as block_group_id, node, min(root) as component from walk group by 1, 2""")
def components(p: Projected):
    every = B.graph(p.edges()).select("block_group_id", "source_node_id", "target_node_id", F.explode("layers.edge_id").alias("edge_id"))
    e = every.where("source_node_id <> 1 and target_node_id <> 2 and edge_id % 10 <> 3").select(
        "block_group_id", "source_node_id", F.lit(0).cast("long").alias("source_start"), F.lit(0).cast("long").alias("source_end"), "target_node_id", F.lit(0).cast("long").alias("target_start"), F.lit(0).cast("long").alias("target_end")
    )
    return G.component_blocks(e).select("block_group_id", F.col("node_id").alias("node"), "component")


@query("""with r as (select path_id, min(node_id) as first, arg_max(node_id, idx) as last, count(distinct node_id) as n from steps group by 1)
 select path_id as block_group_id, unnest([1, last, last]) as source, unnest([first, 2, first]) as target from r where n >= 3""")
def cycle_breaks(p: Projected):
    """Links that would tie each order's inner blocks, taken without the virtual nodes and closed to a ring."""
    s = p.steps()
    order = W.partitionBy("path_id").orderBy("idx")
    z = F.lit(0).cast("long")
    ring = F.coalesce(F.lead("node_id").over(order), F.min("node_id").over(W.partitionBy("path_id")))
    pairs = s.select(F.col("path_id").alias("block_group_id"), F.col("node_id").alias("source_node_id"), z.alias("source_start"), z.alias("source_end"), ring.alias("target_node_id"), z.alias("target_start"), z.alias("target_end"))
    return G.cycle_links(pairs)


@query(f"""with recursive {_LINKS}, und as (select distinct g, a || '.' || a0 as x, a as xn, a0 as x0, a1 as x1, b || '.' || b0 as y from lk where (a, a0) <> (b, b0) union select g, b || '.' || b0, b, b0, b1, a || '.' || a0 from lk where (a, a0) <> (b, b0)),
 cut as (select g, x as v, xn, x0, x1, min(y) as y from und group by 1, 2, 3, 4, 5),
 walk as (select g, v, y as node from cut union select w.g, w.v, u.y from walk w join und u on u.g = w.g and u.x = w.node and u.y <> w.v)
 select distinct c.g as block_group_id, c.xn as node_id, c.x0 as start, c.x1 as "end" from cut c join und u on u.g = c.g and u.x = c.v where not exists (select 1 from walk w where w.g = c.g and w.v = c.v and w.node = u.y)""")
def articulation(p: Projected):
    return G.cut_blocks(B.graph(p.edges()))


@query()
def partition_parts(p: Projected):
    return G.partitioned(B.graph(p.edges()), 3, 6)


@query("""with cut as (select * from pairs where edge_id % 10000 < 4000 and edge_id % 10 <> 1), b as (select * from blocks where node_id > 2),
 no_out as (select b.* from b where not exists (select 1 from cut c where c.block_group_id = b.block_group_id and c.source_node_id = b.node_id and c.source_start = b.start)),
 no_in as (select b.* from b where not exists (select 1 from cut c where c.block_group_id = b.block_group_id and c.target_node_id = b.node_id and c.target_start = b.start))
 select distinct * from (select n.block_group_id, n.node_id, n.start, n."end" as at, r."end" from no_out n join b r on r.block_group_id = n.block_group_id and r.node_id = n.node_id and r.start = n."end"
 union all select n.block_group_id, n.node_id, l.start, n.start, n."end" from no_in n join b l on l.block_group_id = n.block_group_id and l.node_id = n.node_id and l."end" = n.start)""")
def boundary_edges(p: Projected):
    e = p.edges()
    blocks = B.split(e)
    cut = B.assemble(e.where("edge_id % 10000 < 4000 and edge_id % 10 <> 1"), blocks)
    return B.boundary_links(cut, blocks)


@query("""with recursive w2 as (select distinct block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end, target_strand from kept),
 txt as (select w2.*, case when target_node_id = 2 then '' when target_strand = '-' then reverse(translate(substr(sequence, target_start + 1, target_end - target_start), 'ACGT', 'TGCA')) else substr(sequence, target_start + 1, target_end - target_start) end as piece
  from w2 left join steps s on s.node_id = target_node_id left join seqs on part = p_partkey),
 walk as (select distinct block_group_id, 1::bigint as node_id, 0::bigint as start, 0::bigint as "end", '' as sequence from txt
 union all select k.block_group_id, k.target_node_id, k.target_start, k.target_end, w.sequence || k.piece from walk w join txt k on k.block_group_id = w.block_group_id and k.source_node_id = w.node_id and k.source_start = w.start and k.source_end = w."end")
 select distinct block_group_id, sequence from walk where node_id = 2""")
def all_sequences(p: Projected):
    return G.spelled_paths(_pruned(p), p.node_sequences())


def _changes(p: Projected):
    n = p.path_blocks().groupBy("path_id").agg(F.max("path_end").alias("n"))
    kind = F.col("path_id") % 4
    new = F.col("path_id") * 1000 + 999
    return n.select(
        "path_id", F.lit(1).cast("long").alias("change_id"),
        F.when(kind == 0, F.lit(0)).otherwise(F.floor(F.col("n") / 3)).cast("long").alias("from"),
        F.when(kind == 1, F.col("n")).otherwise(F.floor(F.col("n") * 2 / 3)).cast("long").alias("to"),
        new.alias("node_id"), F.when(kind == 2, F.lit(0)).otherwise(F.lit(4)).cast("long").alias("length"), F.lit("+").alias("strand"),
        F.lit(1).cast("long").alias("chromosome_index"), F.lit(0).cast("long").alias("phased"), (F.col("path_id") % 3 != 0).alias("preserve"),
    )


@query("""with n as (select path_id, max(path_end) as n from pblocks group by 1),
 c as (select path_id, case when path_id % 4 = 0 then 0 else n // 3 end as f, case when path_id % 4 = 1 then n else n * 2 // 3 end as t, n, path_id * 1000 + 999 as nn, case when path_id % 4 = 2 then 0 else 4 end as len, path_id % 3 <> 0 as keep from n),
 x as (select c.*, case when f = 0 then 1 else s.node_id end as sn, case when f = 0 then 0 else f - 1 - s.path_start + 1 end as sc, case when f = 0 then '+' else s.strand end as ss,
  case when t = n then 2 else e.node_id end as tn, case when t = n then 0 else t - e.path_start end as tc, case when t = n then '+' else e.strand end as ts
  from c left join pblocks s on s.path_id = c.path_id and s.path_start <= f - 1 and f - 1 < s.path_end left join pblocks e on e.path_id = c.path_id and e.path_start <= t and t < e.path_end)
 select distinct * from (select path_id, sn as source_node_id, sc as source_coordinate, ss as source_strand, nn as target_node_id, 0 as target_coordinate, '+' as target_strand, 1 as chromosome_index from x where len > 0
 union all select path_id, nn, len, '+', tn, tc, ts, 1 from x where len > 0 union all select path_id, sn, sc, ss, tn, tc, ts, 1 from x where len = 0
 union all select path_id, sn, sc, ss, sn, sc, ss, 0 from x where keep and f > 0 union all select path_id, tn, tc, ts, tn, tc, ts, 0 from x where keep and t < n)""")
def change_to_edges(p: Projected):
    got = U.change_edges(_changes(p), p.path_blocks().select("path_id", "node_id", "start", "end", "strand", "path_start", "path_end"), "path_id")
    return got.drop("change_id", "phased")


@query("""select path_id, "from", "to" from (select path_id, path_id % 90 - 3 as "from", path_id % 77 + 20 as "to", max(path_end) as n from pblocks group by 1, 2, 3) where "from" < 0 or "to" > n or "from" > "to" """)
def changes_out_of_range(p: Projected):
    b = p.path_blocks()
    c = b.select("path_id", (F.col("path_id") % 90 - 3).alias("from"), (F.col("path_id") % 77 + 20).alias("to")).distinct()
    return U.out_of_range(c, b, "path_id").select("path_id", "from", "to")


@query("""with r as (select path_id, max(path_end) // 5 as f, max(path_end) * 4 // 5 as t from pblocks group by 1 having max(path_end) >= 10),
 h as (select r.path_id, node_id, strand, greatest(f - path_start, 0) as s, least(t, path_end) - path_start as e, row_number() over (partition by r.path_id order by path_start) - 1 as k from r join pblocks b on b.path_id = r.path_id and path_start < t and f < path_end),
 x as (select *, lead(node_id) over o as nn, lead(s) over o as ns from h window o as (partition by path_id order by k))
 select path_id, 0 as index_in_path, 1 as source_node_id, -1 as source_coordinate, node_id as target_node_id, s as target_coordinate from x where k = 0
 union all select path_id, k + 1, node_id, e, coalesce(nn, 2), coalesce(ns, -1) from x""")
def accession_edges(p: Projected):
    b = p.path_blocks().select("path_id", "node_id", "start", "end", "strand", "path_start", "path_end")
    n = b.groupBy("path_id").agg(F.max("path_end").alias("n")).where("n >= 10")
    r = n.select("path_id", F.lit("a").alias("name"), F.floor(F.col("n") / 5).alias("from"), F.floor(F.col("n") * 4 / 5).alias("to"))
    return U.accession_edges(r, b, "path_id").select("path_id", "index_in_path", "source_node_id", "source_coordinate", "target_node_id", "target_coordinate")


@query("""select path_id, step, length - (past - m) as position from (select *, row_number() over (partition by path_id order by step) as r from (select path_id, idx as step, length, path_id % 60 + 5 as m, sum(length) over (partition by path_id order by idx) as past from steps) where past >= m) where r = 1""")
def anchor_consume(p: Projected):
    s = p.steps().select("path_id", F.col("idx").alias("step"), "length", (F.col("path_id") % 60 + 5).alias("matches"))
    return U.consumed(s, ["path_id"], "matches").select("path_id", "step", "position")


@query(f"""with recursive {_LINKS}, n as (select path_id as g, count(*) as n from steps group by 1),
 f as (select g, node_id, length, strand from steps join n on path_id = g where idx = n // 4), l as (select g, node_id, length, strand from steps join n on path_id = g where idx = n * 3 // 4),
 fb as (select f.g, f.node_id, b.start from f join blocks b on b.block_group_id = f.g and b.node_id = f.node_id and b.start = 0 where exists (select 1 from lk where lk.g = f.g and (lk.a = f.node_id and lk.a0 = 0 or lk.b = f.node_id and lk.b0 = 0))),
 lb as (select l.g, l.node_id, b.start from l join blocks b on b.block_group_id = l.g and b.node_id = l.node_id and b."end" = l.length where exists (select 1 from lk where lk.g = l.g and (lk.a = l.node_id and lk.a1 = l.length or lk.b = l.node_id and lk.b1 = l.length))),
 fw as (select * from fb union select k.g, k.b, k.b0 from fw join lk k on k.g = fw.g and k.a = fw.node_id and k.a0 = fw.start),
 bw as (select * from lb union select k.g, k.a, k.a0 from bw join lk k on k.g = bw.g and k.b = bw.node_id and k.b0 = bw.start),
 both_ways as (select * from fw intersect select * from bw),
 firsts as (select * from (select *, row_number() over (partition by block_group_id, source_node_id, source_start, source_end, target_node_id, target_start, target_end order by edge_id) as r from pairs) where r = 1),
 made as (select p.block_group_id, p.edge_id, source_node_id, source_end as source_coordinate, source_strand, target_node_id, target_start as target_coordinate, target_strand, chromosome_index, 0 as phased from firsts p
  join both_ways s on s.g = p.block_group_id and s.node_id = source_node_id and s.start = source_start join both_ways t on t.g = p.block_group_id and t.node_id = target_node_id and t.start = target_start
  union all select g, null, 1, 0, '+', node_id, 0, strand, 0, 0 from f union all select g, null, node_id, length, strand, 2, 0, '+', 0, 0 from l)
 select * replace (case when source_node_id > 2 then source_node_id + 500000000 else source_node_id end as source_node_id, case when target_node_id > 2 then target_node_id + 500000000 else target_node_id end as target_node_id) from made""")
def derive_subgraph(p: Projected):
    """The subgraph of every order between the lines at a quarter and at three quarters, on copied nodes."""
    s = p.steps().withColumnRenamed("path_id", "block_group_id")
    n = s.groupBy("block_group_id").agg(F.count(F.lit(1)).alias("n"))
    placed = s.join(n, "block_group_id")
    zero = F.lit(0).cast("long")
    first = placed.where("idx = floor(n / 4)").select("block_group_id", F.col("node_id").alias("start_node"), zero.alias("start_at"), F.col("strand").alias("start_strand"))
    last = placed.where("idx = floor(n * 3 / 4)").select("block_group_id", F.col("node_id").alias("end_node"), F.col("length").alias("end_at"), F.col("strand").alias("end_strand"))
    ids = s.select("block_group_id", F.col("node_id").alias("old_id"), (F.col("node_id") + 500000000).alias("new_id"))
    return U.derived_edges(B.graph(p.edges()), first.join(last, "block_group_id"), ids)


@query("""select path_id, chunk, node_id, greatest(chunk * 60 - path_start, 0) as start, least(chunk * 60 + 60, path_end) - path_start as "end" from pblocks, unnest(range(path_start // 60, (path_end - 1) // 60 + 1)) as u(chunk)""")
def derive_chunks(p: Projected):
    b = p.path_blocks().select("path_id", "block", "node_id", "start", "end", "strand", "path_start", "path_end")
    n = b.groupBy("path_id").agg(F.max("path_end").alias("n"))
    r = n.select("path_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 60))).alias("range_id")).withColumn("from", F.col("range_id") * 60).withColumn("to", F.col("range_id") * 60 + 60)
    return P.clipped(b, r).select("path_id", F.col("range_id").alias("chunk"), "node_id", "start", "end")
