"""Queries of filters, joins, upserts and listings over the model tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.operators import blocks as B
from strandwork.operators import joins as J
from strandwork.operators import updates as U
from strandwork.operators import versions as V
from strandwork.plans.project import Projected
from strandwork.plans.register import query
from strandwork.schema import EDGE_KEY


@query("select id, name from bgs where sample_name is null and collection_name = '1-URGENT'")
def scan_filter_null_sample(p: Projected):
    g = p.block_groups()
    return g.where(F.col("sample_name").eqNullSafe(F.lit(None)) & (F.col("collection_name") == "1-URGENT")).select("id", "name")


@query("select id, sample_name from bgs where id in (select o_orderkey from orders where o_custkey % 10 = 3)")
def id_list_lookup(p: Projected):
    ids = p.raw("orders").where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("id"))
    return p.block_groups().join(ids, "id", "left_semi").select("id", "sample_name")


@query("select collection_name, count(*) as graphs, count(distinct sample_name) as samples, count(*) filter (where sample_name is null) as of_reference from bgs group by 1")
def collection_listing(p: Projected):
    return p.block_groups().groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("graphs"), F.count_distinct("sample_name").alias("samples"), F.count_if(F.col("sample_name").isNull()).alias("of_reference")
    )


@query("select coalesce(sample_name, '') as sample, array_to_string(list(name order by name), ',') as graphs from bgs group by sample_name")
def sample_graphs(p: Projected):
    g = p.block_groups().groupBy("sample_name").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("graphs"))
    return g.select(F.coalesce("sample_name", F.lit("")).alias("sample"), "graphs")


@query("select distinct n_name || '/' || left(n_name, 1) as child from nation where starts_with(n_name || '/' || left(n_name, 1), 'NATION_1') and not contains(substr(n_name || '/' || left(n_name, 1), 10), '//')")
def collection_children(p: Projected):
    c = p.raw("nation").select(F.concat("n_name", F.lit("/"), F.left("n_name", F.lit(1))).alias("child"))
    return c.where(F.col("child").startswith("NATION_1") & ~F.contains(F.col("child").substr(F.lit(10), F.length("child")), F.lit("//"))).distinct()


@query("select s.path_id, b.collection_name, b.sample_name, count(*) as steps from steps s join bgs b on s.path_id = b.id group by 1, 2, 3")
def path_join_collection(p: Projected):
    return p.steps().join(p.block_groups(), F.col("path_id") == F.col("id")).groupBy("path_id", "collection_name", "sample_name").agg(F.count(F.lit(1)).alias("steps"))


@query("select s.node_id, q.p_partkey as part, length(q.sequence) as length from steps s left join (select * from seqs where p_partkey % 3 = 0) q on s.part = q.p_partkey")
def node_length_left_join(p: Projected):
    q = p.sequences().where("p_partkey % 3 = 0")
    return p.steps().select("node_id", "part").join(q, F.col("part") == F.col("p_partkey"), "left").select("node_id", F.col("p_partkey").alias("part"), F.length("sequence").cast("long").alias("length"))


@query("""select distinct b.id, b.name from bgs b left join edges x on x.block_group_id = b.id and (x.source_node_id % 2 = 0 or x.target_node_id % 5 = 0) where b.sample_name is null""")
def theta_left_distinct(p: Projected):
    e = p.edges().select(F.col("block_group_id").alias("g"), "source_node_id", "target_node_id")
    g = p.block_groups().where("sample_name is null")
    on = (F.col("g") == F.col("id")) & ((F.col("source_node_id") % 2 == 0) | (F.col("target_node_id") % 5 == 0))
    return g.join(e, on, "left").select("id", "name").distinct()


def _memberships(p: Projected):
    """Each edge on layer 0, and every third also on layer 1, later."""
    e = p.edges()
    first = e.select(F.col("edge_id").alias("id"), "block_group_id", "edge_id", "chromosome_index", "phased")
    more = e.where("edge_id % 3 = 0").select((F.col("edge_id") + 10**12).alias("id"), "block_group_id", "edge_id", F.lit(1).cast("long").alias("chromosome_index"), "phased")
    return first.unionByName(more), e.drop("block_group_id", "chromosome_index", "phased", "index_in_path").withColumnRenamed("edge_id", "id")


_MEMBERS = """m as (select edge_id as id, block_group_id, edge_id, chromosome_index from edges union all select edge_id + 1000000000000, block_group_id, edge_id, 1 from edges where edge_id % 3 = 0)"""


@query(f"with {_MEMBERS} select m.block_group_id, m.edge_id, m.chromosome_index, e.source_node_id, e.target_node_id from m join edges e on m.edge_id = e.edge_id")
def bridge_join(p: Projected):
    m, e = _memberships(p)
    return B.edges_of_groups(m, e).select("block_group_id", "edge_id", "chromosome_index", "source_node_id", "target_node_id")


@query(f"with {_MEMBERS} select block_group_id, edge_id, arg_max(chromosome_index, id) as chromosome_index from m group by 1, 2")
def bridge_latest(p: Projected):
    return B.latest_layer(_memberships(p)[0]).select("block_group_id", "edge_id", F.col("chromosome_index").cast("long").alias("chromosome_index"))


@query("select block_group_id as path_id, array_to_string(list(source_node_id || '>' || target_node_id order by index_in_path), ' ') as walk from backbone group by 1")
def ordered_path_edges(p: Projected):
    from strandwork.operators.paths import joined_in_order, ordered_edges

    step = F.concat(F.col("source_node_id").cast("string"), F.lit(">"), F.col("target_node_id").cast("string"), F.lit(" "))
    return ordered_edges(*p.path_edges()).withColumn("t", step).groupBy("path_id").agg(F.rtrim(joined_in_order("index_in_path", "t")).alias("walk"))


@query("select s.node_id, sha256('DNA;' || q.sequence || ';;;') as sequence_hash, substr(q.sequence, 1, 10) as head from steps s join seqs q on s.part = q.p_partkey")
def node_sequence_lookup(p: Projected):
    return p.node_sequences().select("node_id", F.col("hash").alias("sequence_hash"), F.substring("sequence", 1, 10).alias("head"))


@query("select x.path_id, x.at, b.node_id, x.at - b.path_start as within from (select path_id, path_start + 3 * line as at from pblocks) x join pblocks b on x.path_id = b.path_id and b.path_start <= x.at and x.at < b.path_end")
def point_in_block(p: Projected):
    b = p.path_blocks()
    points = b.select("path_id", (F.col("path_start") + 3 * F.col("line")).alias("at"))
    return J.point_join(points, b.select("path_id", "node_id", "path_start", "path_end"), ["path_id"], "at", ("path_start", "path_end"), 64).select(
        "path_id", "at", "node_id", (F.col("at") - F.col("path_start")).alias("within")
    )


@query("""select a.path_id, a.name, b.node_id, greatest(a.f, b.path_start) as start, least(a.t, b.path_end) as "end" from (select path_id, block as name, path_start + 4 as f, path_start + 4 + 11 * line as t from pblocks) a
 join pblocks b on a.path_id = b.path_id and a.f < b.path_end and b.path_start < a.t""")
def overlap_blocks(p: Projected):
    b = p.path_blocks()
    a = b.select("path_id", F.col("block").alias("name"), (F.col("path_start") + 4).alias("f"), (F.col("path_start") + 4 + 11 * F.col("line")).alias("t"))
    met = J.overlap_join(a, b.select("path_id", "node_id", "path_start", "path_end"), ["path_id"], ("f", "t"), ("path_start", "path_end"), 128)
    return met.select("path_id", "name", "node_id", F.greatest("f", "path_start").alias("start"), F.least("t", "path_end").alias("end"))


@query("""with old as (select distinct source_node_id, source_coordinate, source_strand, target_node_id, target_coordinate, target_strand from edges where block_group_id % 2 = 0)
 select e.block_group_id, e.edge_id, o.source_node_id is not null as existed from edges e left join old o on e.source_node_id = o.source_node_id and e.source_coordinate = o.source_coordinate
 and e.source_strand = o.source_strand and e.target_node_id = o.target_node_id and e.target_coordinate = o.target_coordinate and e.target_strand = o.target_strand""")
def upsert_edges_ordered(p: Projected):
    e = p.edges()
    table = V.written(p.spark, J.numbered(e.where("block_group_id % 2 = 0").select(*EDGE_KEY).distinct(), EDGE_KEY).select("id", *EDGE_KEY))
    return J.resolved(table, e.select("block_group_id", "edge_id", *EDGE_KEY), EDGE_KEY).select("block_group_id", "edge_id", "existed")


@query("select block_group_id, edge_id % 7 as edge_id from edges where block_group_id % 4 <> 1 group by 1, 2 except select distinct block_group_id, edge_id % 7 from edges where chromosome_index = 1")
def insert_or_ignore_bridge(p: Projected):
    e = p.edges().select("block_group_id", (F.col("edge_id") % 7).alias("edge_id"), "chromosome_index")
    return J.missing_from(e.where("block_group_id % 4 <> 1").drop("chromosome_index"), e.where("chromosome_index = 1"), ["block_group_id", "edge_id"])


@query("""select count(*) as n, count(distinct id) as ids, min(id) as first, max(id) as last from (select row_number() over (order by o_orderkey) + 99 as id from orders)""")
def numbered_rows(p: Projected):
    got = J.numbered(p.block_groups().select("name"), ["name"], "id", 100)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


def _parts(p: Projected):
    """A library for each order of at most four columns: lines are columns by their number modulo 4."""
    col = F.dense_rank().over(W.partitionBy("path_id").orderBy(F.col("line") % 4)) - 1
    return p.steps().select("path_id", col.cast("long").alias("column"), "node_id", "length")


_PARTS = "lib as (select path_id, dense_rank() over (partition by path_id order by line % 4) - 1 as col, node_id, length from steps)"


@query(f"""with {_PARTS} select a.path_id, a.node_id as source_node_id, a.length as source_coordinate, b.node_id as target_node_id, 0 as target_coordinate from lib a join lib b on a.path_id = b.path_id and b.col = a.col + 1
 union all select path_id, 1, 0, node_id, 0 from lib where col = 0 union all select l.path_id, node_id, length, 2, 0 from lib l join (select path_id, max(col) as m from lib group by 1) x on l.path_id = x.path_id and col = m""")
def library_edges(p: Projected):
    return U.layered(_parts(p), ["path_id"])


@query(f"with {_PARTS} select path_id, cast(product(n) as bigint) as combinations from (select path_id, col, count(distinct node_id) as n from lib group by 1, 2) group by 1")
def library_size(p: Projected):
    return U.library_size(_parts(p), ["path_id"])


@query("""select g.o_custkey, g.position, a.source_node_id, a.source_coordinate, b.target_node_id, b.target_coordinate, 1 + row_number() over (partition by g.o_custkey order by g.position, a.source_node_id, b.target_node_id) as chromosome_index
 from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as position from orders) g
 join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as position from orders) h on g.o_custkey = h.o_custkey and h.position = g.position + 1
 join backbone a on a.block_group_id = g.o_orderkey and a.target_node_id = 2 join backbone b on b.block_group_id = h.o_orderkey and b.source_node_id = 1""")
def stitch_edges(p: Projected):
    e = p.edges(skips=False)
    order = p.raw("orders").select("o_custkey", F.col("o_orderkey").alias("region")).withColumn("position", F.row_number().over(W.partitionBy("o_custkey").orderBy("region")).cast("long"))
    ends = e.where("target_node_id = 2").select(F.col("block_group_id").alias("region"), "source_node_id", "source_coordinate", "source_strand")
    starts = e.where("source_node_id = 1").select(F.col("block_group_id").alias("region"), "target_node_id", "target_coordinate", "target_strand")
    cust = order.select("o_custkey", "region")
    got = U.stitched(ends.join(cust, "region"), starts.join(cust, "region"), order, ["o_custkey"])
    layer = 1 + F.row_number().over(W.partitionBy("o_custkey").orderBy("position", "source_node_id", "target_node_id"))
    return got.select("o_custkey", "position", "source_node_id", "source_coordinate", "target_node_id", "target_coordinate", layer.cast("long").alias("chromosome_index"))


@query("select node_id, 'source' as kind from steps s where not exists (select 1 from edges e where e.target_node_id = s.node_id and e.source_node_id <> 1) union all select node_id, 'sink' from steps s where not exists (select 1 from edges e where e.source_node_id = s.node_id and e.target_node_id <> 2)")
def anti_pure_sources(p: Projected):
    e, s = p.edges(), p.steps().select("node_id")
    into = e.where("source_node_id <> 1").select(F.col("target_node_id").alias("node_id"))
    out = e.where("target_node_id <> 2").select(F.col("source_node_id").alias("node_id"))
    return s.join(into, "node_id", "left_anti").withColumn("kind", F.lit("source")).unionByName(s.join(out, "node_id", "left_anti").withColumn("kind", F.lit("sink")))


@query("select coalesce(sample_name, '') as sample, collection_name, count(*) as changes, count(distinct node_id) as nodes from steps s join bgs b on s.path_id = b.id where status = 'F' group by sample_name, collection_name")
def summary_counts(p: Projected):
    rows = p.steps().where("status = 'F'").join(p.block_groups(), F.col("path_id") == F.col("id"))
    return rows.groupBy("sample_name", "collection_name").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("node_id").alias("nodes")).select(
        F.coalesce("sample_name", F.lit("")).alias("sample"), "collection_name", "changes", "nodes"
    )


@query("select a.id, b.o_orderkey as other from (select id, name from bgs where id % 3 = 0) a full outer join (select o_orderkey, 'g' || o_orderkey as name from orders where o_orderkey % 2 = 0) b on a.name = b.name")
def match_by_name(p: Projected):
    g = p.block_groups()
    other = g.where("id % 2 = 0").select(F.col("id").alias("other"), "name")
    return g.where("id % 3 = 0").select("id", "name").join(other, "name", "full_outer").select("id", "other")


@query("select * from (select hash, count(*) as uses from (select sha256(sequence) as hash from seqs join steps on part = p_partkey) group by 1) order by uses desc, hash limit 20")
def raw_sql(p: Projected):
    """Plain SQL over registered views is a feature of the library; this is one such statement."""
    p.sequences().createOrReplaceTempView("sw_sequences")
    p.steps().createOrReplaceTempView("sw_steps")
    return p.spark.sql("select hash, count(*) as uses from (select sha2(sequence, 256) as hash from sw_sequences join sw_steps on part = p_partkey) group by hash order by uses desc, hash limit 20")
