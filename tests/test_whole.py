"""Registered queries against brute force."""

import hashlib

from strandwork import catalog
from strandwork.operators import blocks as B
from strandwork.plans.project import Projected

def rows_of(spark, sf, name):
    return catalog.QUERIES[name](spark, sf).collect()


def test_unambiguous_placements_of_all_orders(spark, sf):
    place = lambda r: (r.start, r.end, r.path_start, r.path_end)
    by = {}
    for r in rows_of(spark, sf, "flatten_intervals"):
        by.setdefault((r.block_group_id, r.node_id), []).append(place(r))
    meet = lambda a, b: a[0] < b[1] and b[0] < a[1] or a[2] < b[3] and b[2] < a[3]
    want = {(k, x) for k, v in by.items() if not any(x != y and meet(x, y) for x in v for y in v) for x in v}
    got = rows_of(spark, sf, "flatten_unambiguous")
    assert {((r.block_group_id, r.node_id), place(r)) for r in got} == want and len(got) == len(want)
    assert {r.block_group_id % 5 for r in got} == set(range(5))


def test_projection_of_all_paths(spark, sf):
    """A path's walk is each node's blocks in the direction of its strand, if the graph links them all."""
    p = Projected(spark, sf)
    links, inner = set(), {}
    for r in B.graph(p.edges()).drop("layers").collect():
        s, t = (r.source_node_id, r.source_start, r.source_end), (r.target_node_id, r.target_start, r.target_end)
        links.add((r.block_group_id, s, t))
        for b in (s, t):
            inner.setdefault((r.block_group_id, b[0]), set()).add(b)
    paths = {}
    for r in p.steps().orderBy("path_id", "idx").collect():
        own = sorted(inner.get((r.path_id, r.node_id), ()), reverse=r.strand == "-")
        paths.setdefault(r.path_id, []).extend((b, r.strand) for b in own)
    want = {}
    for k, blocks in paths.items():
        walk = [((1, 0, 0), "+"), *blocks, ((2, 0, 0), "+")]
        if all((k, a[0], b[0]) in links for a, b in zip(walk, walk[1:])):
            want[k] = walk
    got = {}
    for r in sorted(rows_of(spark, sf, "project_path"), key=lambda r: (r.path_id, r.step)):
        got.setdefault(r.path_id, []).append(((r.node_id, r.start, r.end), r.strand))
    assert got == want
    assert any(s == "-" for walk in got.values() for _, s in walk)


def test_derived_subgraphs(spark, sf):
    """By block: links whose two ends a walk from the start block reaches, and from which the end block is reached."""
    p = Projected(spark, sf)
    links, steps = {}, {}
    for r in B.graph(p.edges()).collect():
        links.setdefault(r.block_group_id, []).append(((r.source_node_id, r.source_start, r.source_end), (r.target_node_id, r.target_start, r.target_end), r.layers[0]))
    for r in p.steps().orderBy("path_id", "idx").collect():
        steps.setdefault(r.path_id, []).append(r)
    new = lambda n: n + 500000000 if n > 2 else n
    want = set()
    for k, own in steps.items():
        a, b = own[len(own) // 4], own[len(own) * 3 // 4]
        blocks = sorted({x for s, t, _ in links[k] for x in (s, t)})
        first = [x for x in blocks if x[0] == a.node_id and x[1] == 0]
        last = [x for x in blocks if x[0] == b.node_id and x[2] == b.length]
        near = {(x, x) for x in blocks} | {(s, t) for s, t, _ in links[k]}
        while len(more := near | {(x, z) for x, y in near for w, z in near if w == y}) > len(near):
            near = more
        for s, t, e in links[k]:
            if first and last and {(first[0], s), (first[0], t), (s, last[0]), (t, last[0])} <= near:
                want.add((k, e.edge_id, new(s[0]), s[2], e.source_strand, new(t[0]), t[1], e.target_strand, e.chromosome_index, e.phased))
        want.add((k, None, 1, 0, "+", new(a.node_id), 0, a.strand, 0, 0))
        want.add((k, None, new(b.node_id), b.length, b.strand, 2, 0, "+", 0, 0))
    got = [tuple(r) for r in rows_of(spark, sf, "derive_subgraph")]
    assert set(got) == want and len(got) == len(want)
    assert {r[0] for r in got} == set(steps)


#: Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def test_white_space_of_all_documents(spark, sf, tmp_path):
    texts = ["a" + c + "b" for c in WHITE + "\x1c\u200b\ufeff\u180e"] + ["", None, WHITE, "Gr\u00fc\u00dfe \u00a0an\u3000alle \U0001f600"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), sf):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = set()
        for r in docs:
            bare = None if r.text is None else r.text.translate({ord(c): None for c in WHITE})
            want.add((r.doc_id, *((None, None) if bare is None else (hashlib.sha256(bare.encode()).hexdigest(), len(bare)))))
        got = rows_of(spark, folder, "strip_ws")
        assert {(r.doc_id, r.hash, r.n) for r in got} == want and len(got) == len(docs)


def test_parts_of_all_orders(spark, sf):
    """Parts are runs of a topological order that end at an articulation point, of three to six blocks but the last."""
    p = Projected(spark, sf)
    links = {}
    for r in B.graph(p.edges()).drop("layers").collect():
        links.setdefault(r.block_group_id, set()).add(((r.source_node_id, r.source_start, r.source_end), (r.target_node_id, r.target_start, r.target_end)))
    parts = {}
    for r in rows_of(spark, sf, "partition_parts"):
        parts.setdefault(r.block_group_id, {}).setdefault(r.part, []).append((r.node_id, r.start, r.end))
    cut = {}
    for r in rows_of(spark, sf, "articulation"):
        cut.setdefault(r.block_group_id, set()).add((r.node_id, r.start, r.end))
    assert set(parts) == set(links)
    for k, own in links.items():
        place = {b: n for n, part in parts[k].items() for b in part}
        assert sorted(place) == sorted({b for link in own for b in link})
        assert all(place[a] <= place[b] for a, b in own if a != b)
        for n, part in parts[k].items():
            points = [b for b in part if b in cut.get(k, ())]
            assert len(part) <= 6 and (n == max(parts[k]) or len(part) == 6 or (len(part) >= 3 and part[-1] in points))
            assert not any(b in points for b in part[2:-1])


def test_ring_breaks(spark, sf):
    steps = {}
    for r in Projected(spark, sf).steps().orderBy("path_id", "idx").collect():
        steps.setdefault(r.path_id, []).append(r.node_id)
    want = {(k, *link) for k, n in steps.items() if len(n) > 2 for link in ((1, n[0]), (n[-1], 2), (n[-1], n[0]))}
    assert {(r.block_group_id, r.source, r.target) for r in rows_of(spark, sf, "cycle_breaks")} == want
