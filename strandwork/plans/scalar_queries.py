"""Queries of scalar functions and range algebra."""

from pyspark.sql import functions as F

from strandwork.functions import ranges as R
from strandwork.functions import scalars as S
from strandwork.plans.project import Projected
from strandwork.plans.register import query


@query("select p_partkey, sequence, sha256('DNA;' || sequence || ';;;') as hash, sha256(sequence) as text_hash from seqs")
def seq_identity_hash(p: Projected):
    return p.sequences().select("p_partkey", "sequence", "hash", S.text_hash("sequence").alias("text_hash"))


@query("select sha256('DNA;' || sequence || ';;;') as hash, min(p_partkey) as first_part, count(*) as parts from seqs group by 1")
def seq_dedupe(p: Projected):
    return p.sequences().groupBy("hash").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("parts"))


@query("""select p_partkey, sha256(c || '.' || n || ':' || h) as import_hash, sha256('7:3-9->' || h) as variant_hash, sha256('7:0-64->' || h || '-column-2') as library_hash,
 'c.s.' || h || '.bg-9' as derived_hash from (select p_partkey, 'c' as c, p_name as n, sha256('DNA;' || sequence || ';;;') as h from seqs)""")
def node_hashes(p: Projected):
    lit = lambda x: F.lit(x)
    return p.sequences().select(
        "p_partkey",
        S.node_hash("import", collection=lit("c"), name="p_name", hash="hash").alias("import_hash"),
        S.node_hash("variant", path=lit(7), start=lit(3), end=lit(9), hash="hash").alias("variant_hash"),
        S.node_hash("library", path=lit(7), start=lit(0), end=lit(64), hash="hash", column=lit(2)).alias("library_hash"),
        S.derived_node_hash(lit("c"), lit("s"), "hash", lit(9)).alias("derived_hash"),
    )


@query("select p_partkey, reverse(translate(sequence || 'nN' || lower(sequence), 'ACGTacgt', 'TGCAtgca')) as revcomp from seqs")
def revcomp_seq(p: Projected):
    return p.sequences().select("p_partkey", S.reverse_complement(F.concat("sequence", F.lit("nN"), F.lower("sequence"))).alias("revcomp"))


@query("select p_partkey, substr(sequence, p_size + 1, 13) as slice, substr(sequence, 11) as rest from (select s.*, p_size from seqs s join part using (p_partkey))")
def subseq_slice(p: Projected):
    size = p.raw("part").select("p_partkey", "p_size")
    return p.sequences().join(size, "p_partkey").select(
        "p_partkey", S.slice_of("sequence", F.col("p_size"), F.col("p_size") + 13).alias("slice"), S.slice_of("sequence", F.lit(10)).alias("rest")
    )


#: Unicode's White_Space property, as a character class.
_WHITE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"select doc_id, sha256(regexp_replace(text, '{_WHITE}', '', 'g')) as hash, length(regexp_replace(text, '{_WHITE}', '', 'g')) as n from documents")
def strip_ws(p: Projected):
    """All documents, by Unicode's white space. A null text gives nulls."""
    text = S.without_whitespace("text")
    return p.raw("documents").select("doc_id", F.sha2(text, 256).alias("hash"), F.char_length(text).cast("long").alias("n"))


_GT = "case o_orderkey % 6 when 0 then '0/1' when 1 then '1|0' when 2 then './.' when 3 then '1|2/0' when 4 then '3' else '0|.' end"


@query(f"""select o_orderkey, i - 1 as place, try_cast(a[i] as bigint) as allele,
 case when try_cast(a[i] as bigint) is null then null when i = 1 then (case when contains(g, '/') then 0 else 1 end) else (case when s[i - 1] = '|' then 1 else 0 end) end as phased
 from (select o_orderkey, g, regexp_split_to_array(g, '[/|]') as a, regexp_extract_all(g, '[/|]') as s from (select o_orderkey, {_GT} as g from orders)), unnest(range(1, len(a) + 1)) as u(i)""")
def genotype_parse(p: Projected):
    got = p.raw("orders").select("o_orderkey", F.posexplode(S.genotype(F.expr(_GT))).alias("place", "x"))
    return got.select("o_orderkey", F.col("place").cast("long").alias("place"), "x.allele", "x.phased")


@query("""select l_orderkey, l_linenumber, a <= x and x < b as contains_start, a <= y and y < b as contains_end, a < y and x < b as overlap
 from (select l_orderkey, l_linenumber, l_partkey % 40 as a, l_partkey % 40 + cast(l_quantity as bigint) as b, l_suppkey % 30 as x, l_suppkey % 30 + 12 as y from lineitem)""")
def interval_overlap_flags(p: Projected):
    a, x = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    flags = S.overlap_flags(a, a + F.col("l_quantity").cast("long"), x, x + 12)
    return p.raw("lineitem").select("l_orderkey", "l_linenumber", flags.alias("f")).select("l_orderkey", "l_linenumber", "f.*")


@query("""select p_partkey, case when p_size % 3 = 0 then repeat(substr(sequence, 1, 4), p_size % 5) else substr(sequence, 5, 3) end as allele from seqs join part using (p_partkey)""")
def cnv_expand(p: Projected):
    alt = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<CN"), (F.col("p_size") % 5).cast("string"), F.lit(">"))).otherwise(F.substring("sequence", 5, 3))
    rows = p.sequences().join(p.raw("part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", S.copy_number_allele(alt, F.substring("sequence", 1, 4)).alias("allele"))


@query("""select p_partkey, case when cut then p_size + 1 else p_size end as start, case when cut then substr(alt, 2) else alt end as alt from
 (select p_partkey, p_size, alt, alt <> '' and alt <> '*' and length(alt) <> 3 as cut from (select p_partkey, p_size, case p_size % 4 when 0 then '' when 1 then '*' when 2 then substr(sequence, 1, 3) else substr(sequence, 1, p_size % 7 + 1) end as alt from seqs join part using (p_partkey)))""")
def allele_trim(p: Projected):
    kind, s = F.col("p_size") % 4, F.col("sequence")
    alt = F.when(kind == 0, "").when(kind == 1, "*").when(kind == 2, s.substr(1, 3)).otherwise(s.substr(F.lit(1), (F.col("p_size") % 7 + 1).cast("int")))
    rows = p.sequences().join(p.raw("part").select("p_partkey", "p_size"), "p_partkey")
    return rows.select("p_partkey", S.trimmed_allele("p_size", s.substr(1, 3), alt).alias("x")).select("p_partkey", "x.start", "x.alt")


@query("select path_id, idx, a in ('.', '?') or b in ('.', '?') or a = b as fits, case when length % 2 = 0 then '+' else '-' end as strand from (select path_id, idx, length, case when line = 3 then '.' else strand end as a, case when part % 7 = 0 then '?' when part % 2 = 0 then '-' else '+' end as b from steps)")
def strand_compat(p: Projected):
    a = F.when(F.col("line") == 3, ".").otherwise(F.col("strand"))
    b = F.when(F.col("part") % 7 == 0, "?").when(F.col("part") % 2 == 0, "-").otherwise("+")
    return p.steps().select("path_id", "idx", S.strands_fit(a, b).alias("fits"), S.strand_of(F.col("length") % 2 == 0).alias("strand"))


@query("select path_id, idx, node_id || '.0.' || length as segment from steps")
def segment_ids(p: Projected):
    return p.steps().select("path_id", "idx", S.segment_id("node_id", F.lit(0), "length").alias("segment"))


@query("select s_suppkey, replace(s_name, '#', '-') as train, substr(s_name, 1, 3) || '...' || right(s_name, 3) as short, substr(s_name, 1, 5) || '…' || right(s_name, 4) as inner_cut from supplier")
def name_labels(p: Projected):
    return p.raw("supplier").select("s_suppkey", S.train_case("s_name").alias("train"), S.short_label("s_name").alias("short"), S.inner_truncation("s_name", 10).alias("inner_cut"))


@query("select p_partkey, sequence_hash as hash from (select p_partkey, sha256(sequence) as sequence_hash from seqs) where starts_with(sequence_hash, 'a')")
def hash_prefix(p: Projected):
    return p.sequences().select("p_partkey", S.text_hash("sequence").alias("hash")).where(F.col("hash").startswith("a"))


_COLL = "'/' || r_name || '//' || n_name || '/' || substr(n_name, 1, 2) || '/'"


@query("select n_nationkey, r_name || '/' || n_name || '/' || substr(n_name, 1, 2) as collection, substr(n_name, 1, 2) as base, r_name || '/' || n_name as parent, n_nationkey in (1, 2) as terminal from nation join region on n_regionkey = r_regionkey")
def collection_names(p: Projected):
    rows = p.raw("nation").join(p.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("c", F.expr(_COLL))
    return rows.select("n_nationkey", S.normal_collection("c").alias("collection"), S.collection_basename("c").alias("base"), S.collection_parent("c").alias("parent"), S.is_terminal("n_nationkey").alias("terminal"))


_RANGES = "select l_orderkey, l_linenumber, l_partkey, l_suppkey % 50 as a0, l_partkey % 50 as a1, l_partkey % 37 as b0, (l_suppkey * 3) % 41 as b1 from lineitem"


def _ranges(p: Projected):
    rows = p.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", R.rng(F.col("l_suppkey") % 50, F.col("l_partkey") % 50).alias("a"), R.rng(F.col("l_partkey") % 37, (F.col("l_suppkey") * 3) % 41).alias("b")
    )
    return rows


@query(f"select l_orderkey, l_linenumber, l_partkey, a0 as start, b1 as \"end\", a1 = b0 as adjoins, a1 % 7 = b0 % 7 as adjoins_mod, a0 > a1 as wraps from ({_RANGES})")
def range_extend(p: Projected):
    return _ranges(p).select(
        "l_orderkey", "l_linenumber", "l_partkey", R.extend("a", "b").alias("x"), R.left_adjoins("a", "b").alias("adjoins"), R.left_adjoins("a", "b", F.lit(7)).alias("adjoins_mod"), R.wraps("a").alias("wraps")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "x.start", "x.end", "adjoins", "adjoins_mod", "wraps")


_FAR = (1 << 63) - 1
_PIECES = f"case when {{0}}0 > {{0}}1 then [{{{{'s': cast({{0}}0 as bigint), 'e': {_FAR}}}}}, {{{{'s': cast(0 as bigint), 'e': cast({{0}}1 as bigint)}}}}] else [{{{{'s': cast({{0}}0 as bigint), 'e': cast({{0}}1 as bigint)}}}}] end"


@query(f"""select distinct l_orderkey, l_linenumber, l_partkey, greatest(x.s, y.s) as start, least(x.e, y.e) as "end" from (select *, {_PIECES.format('a')} as pa, {_PIECES.format('b')} as pb from ({_RANGES})),
 unnest(pa) as u(x), unnest(pb) as v(y) where greatest(x.s, y.s) < least(x.e, y.e)""")
def range_overlap_wrap(p: Projected):
    got = _ranges(p).select("l_orderkey", "l_linenumber", "l_partkey", F.inline(R.about_the_origin(R.overlaps("a", "b"), 1)))
    return got.distinct()


@query(f"""select l_orderkey, l_linenumber, l_partkey, (case when a0 > a1 then i >= a0 or i <= a1 else i >= a0 and i <= a1 end) as inside,
 case when (case when a0 > a1 then i >= a0 or i <= a1 else i >= a0 and i <= a1 end) then b0 + i - a0 end as moved, ((i - 30) % 11 + 11) % 11 as circular from (select *, l_linenumber * 7 as i from ({_RANGES}))""")
def range_translate(p: Projected):
    i = (F.col("l_linenumber") * 7).cast("long")
    return _ranges(p).select(
        "l_orderkey", "l_linenumber", "l_partkey", R.contains("a", i).alias("inside"), R.translated(i, "a", "b").alias("moved"), R.circular(i - 30, F.lit(11), F.lit(True)).alias("circular")
    )


@query("""select l.path_id, l.block, r.block as other, greatest(l.path_start, r.path_start + 5) as start, least(l.path_end, r.path_end + 5) as "end" from pblocks l join pblocks r on l.path_id = r.path_id
 where l.path_end > r.path_start + 5 and l.path_start <= r.path_end + 5""")
def range_pairwise(p: Projected):
    b = p.path_blocks()
    left = b.select("path_id", "block", R.rng("path_start", "path_end").alias("a"))
    right = b.select("path_id", F.col("block").alias("other"), R.rng(F.col("path_start") + 5, F.col("path_end") + 5).alias("b"))
    return R.pairwise(left, right, ["path_id"]).select("path_id", "block", "other", "overlap.start", "overlap.end")


_MAPS = "select path_id, path_start as s0, path_end as s1, path_start + 3 + 9 * (line // 3) as t0, path_end + 3 + 9 * (line // 3) as t1 from pblocks"


@query(f"""select path_id, min(s0) as s0, max(s1) as s1, min(t0) as t0, max(t1) as t1 from (select *, sum(new) over (partition by path_id order by s0, s1) as island from (
 select *, case when lag(s1) over o = s0 and lag(t1) over o = t0 then 0 else 1 end as new from ({_MAPS}) window o as (partition by path_id order by s0, s1))) group by path_id, island""")
def merge_contiguous(p: Projected):
    shift = 3 + 9 * F.floor(F.col("line") / 3)
    m = p.path_blocks().select("path_id", F.col("path_start").alias("s0"), F.col("path_end").alias("s1"), (F.col("path_start") + shift).alias("t0"), (F.col("path_end") + shift).alias("t1"))
    return R.merged_mappings(m, ["path_id"])
