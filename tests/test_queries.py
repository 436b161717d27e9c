"""Registered queries against their SQL, and small cases of scalar functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandwork import catalog
from strandwork.functions import ranges as R
from strandwork.functions import scalars as S
from strandwork.operators import graphs as G
from strandwork.operators import versions as V

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
CHOSEN = [
    "path_sequence", "seq_identity_hash", "genotype_parse", "range_overlap_wrap", "merge_contiguous", "upsert_edges_ordered", "block_split", "prune_edges", "path_replace_span",
    "block_mappings", "propagate_annotations", "op_upstream", "changeset_dependencies", "simple_paths", "flatten_intervals", "flatten_unambiguous", "all_sequences",
    "library_edges", "library_size", "project_path", "derive_subgraph", "simple_paths_by_link", "graph_layout", "articulation", "cycle_breaks", "strip_ws", "accession_edges", "change_to_edges",
]


def plain(value):
    if value is None or value != value:
        return "None"
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine = catalog.QUERIES[name](spark, sf)
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(mine.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in mine.collect()) == want


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    got = lambda t: value(spark, S.reverse_complement(F.lit(t)))
    assert [got(t) for t in ("ATCCGG", "CNNNNA", "cNNgnAt", "AU")] == ["CCGGAT", "TNNNNG", "aTncNNg", None]
    assert value(spark, S.train_case(F.lit("m123"))) == "M-123"
    phased = [tuple(x) if x else None for x in value(spark, S.genotype(F.lit("0|1/2")))]
    assert phased == [(0, 0), (1, 1), (2, 0)]
    assert [x and tuple(x) for x in value(spark, S.genotype(F.lit("1|.")))] == [(1, 1), None]


def test_ranges(spark):
    r = lambda a, b: R.rng(F.lit(a), F.lit(b))
    assert [tuple(x) for x in value(spark, R.overlaps(r(8, 3), r(2, 9)))] == [(2, 3), (8, 9)]
    assert value(spark, R.translated(F.lit(5), r(3, 5), r(10, 12))) == 12
    assert value(spark, R.translated(F.lit(6), r(3, 5), r(10, 12))) is None


def test_walks():
    links = [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (5, 7), (6, 8), (7, 8), (9, 9)]
    assert list(G.simple_paths(links, 1, 8)) == [[1, 2, 3, 5, 6, 8], [1, 2, 3, 5, 7, 8], [1, 2, 4, 5, 6, 8], [1, 2, 4, 5, 7, 8]]
    assert G.articulation_points(links) == [2, 5]
    assert G.between(links, 2, 5) == [(2, 3), (2, 4), (3, 5), (4, 5)]
    assert G.reachable(links, [5]) == {5, 6, 7, 8}
    assert [len(p) for p in G.components(links)] == [8, 1]
    assert list(G.simple_paths([(1, 2), (2, 1)], 1, 1)) == [[1, 2, 1]]
    with pytest.raises(ValueError):
        list(G.simple_paths(links, 1, 8, 3))


def test_operation_spec():
    ops = ["aa1", "ab2", "b3", "c4"]
    assert V.parse_spec(ops, "ab..HEAD,aa") == ["ab2", "b3", "c4", "aa1"]
    assert V.parse_spec(ops, "HEAD~2") == ["ab2"]
    with pytest.raises(ValueError):
        V.parse_spec(ops, "a")
