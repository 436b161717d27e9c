"""Graph operators over many groups in one call, against plain versions of one group at a time."""

import random

import pyarrow as pa
import pytest

from strandwork import catalog
from strandwork.operators import graphs as G
from strandwork.operators.batches import whole_groups

S, T = G.START, G.END
SCHEMA = "block_group_id long, " + ", ".join(f"{c} long" for c in [*G.SOURCE, *G.TARGET])


def frame(spark, graphs):
    return spark.createDataFrame([(k, *a, *b) for k, links in graphs.items() for a, b in links], SCHEMA)


def random_graphs(n=80):
    """Small graphs, with cycles, loops, links into the start and out of the end, and without a way to the end."""
    rng, out = random.Random(5), {}
    for k in range(n):
        blocks = [S, T, *[(3 + i // 2, 10 * (i % 2), 10 * (i % 2) + rng.randrange(4)) for i in range(rng.randrange(1, 7))]]
        out[k * 7 - 50] = sorted({(rng.choice(blocks), rng.choice(blocks)) for _ in range(rng.randrange(1, 14))})
    return out


def ladder(n):
    """n bubbles in a row, 2 ** n walks."""
    at, out = S, []
    for i in range(n):
        a, b, c = (10 + 3 * i, 0, 2), (11 + 3 * i, 0, 3), (12 + 3 * i, 0, 1)
        out += [(at, a), (at, b), (a, c), (b, c)]
        at = c
    return [*out, (at, T)]


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def plan(spark, name):
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def no_call_a_group(spark, name):
    text = plan(spark, name)
    assert "MapInArrow" in text and "FlatMap" not in text


def placed(links):
    found = set()
    for path in G.simple_paths(links, S, T):
        at = 0
        for b in path:
            found.add((*b, at, at + b[2] - b[1]))
            at += b[2] - b[1]
    return {f for f in found if f[0] > 2}


def test_tables_hold_whole_groups():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5, 5, 6]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 2]}) for i in range(0, len(keys), 2)]
    for most in range(1, 20):
        got = [t.column("k").to_pylist() for t in whole_groups([batches[0].slice(0, 0), *batches], "k", most)]
        assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
        assert all(len(t) >= most for t in got[:-1])
    assert list(whole_groups([], "k")) == []


def test_flatten_intervals(spark):
    no_call_a_group(spark, "flatten_intervals")
    graphs = random_graphs()
    assert rows(G.placements(frame(spark, graphs))) == {(k, *f) for k, links in graphs.items() for f in placed(links)}
    many = rows(G.placements(frame(spark, {1: ladder(40)})))  # 2 ** 40 walks
    last = sorted(r[4] for r in many if r[1] == 12 + 3 * 39)
    assert last == list(range(40 * 2 + 39, 40 * 3 + 40))


def test_flatten_unambiguous(spark):
    no_call_a_group(spark, "flatten_unambiguous")
    graphs, want = random_graphs(300), set()
    for k, links in graphs.items():
        by = {}
        for f in placed(links):
            by.setdefault(f[0], []).append(f)
        for v in by.values():
            if not any(x != y and (x[1] < y[2] and y[1] < x[2] or x[3] < y[4] and y[3] < x[4]) for x in v for y in v):
                want |= {(k, *f) for f in v}
    assert want and rows(G.placements(frame(spark, graphs), drop_ambiguous=True)) == want


def test_flatten_unambiguous_in_one_shuffle(spark):
    text = plan(spark, "flatten_unambiguous").split("== Physical Plan ==")[1]
    assert text.count("Exchange ") == 1 and text.count("Window ") == 3 and "lambdafunction" not in text


def test_placements_of_edges(spark):
    rng, out = random.Random(8), []
    for k in range(300):
        nodes = [1, 2, *range(3, 3 + rng.randrange(1, 5))]
        ends = [(n, at) for n in nodes for at in ((0, 0, 0, 4) if n < 3 else (0, 2, 5))] + [(3, None)] * (k % 4 == 0)
        if k % 2:  # no cycles: from smaller ends to larger ones, over the whole nodes as well
            ends = sorted((n if n != 2 else 99, at) for n, at in ends if at is not None)
            chosen = [tuple(sorted(rng.sample(ends, 2))) for _ in range(rng.randrange(2, 14))] + [(e, e) for e in ends if rng.random() < 0.3]
            chosen = [[(2 if n == 99 else n, at) for n, at in pair] for pair in chosen]
        else:
            chosen = [(rng.choice(ends), rng.choice(ends)) for _ in range(rng.randrange(1, 14))]
        out += [(k - 9 if k else None, *a, *b) for a, b in chosen]
    out += out[::5]  # an edge on two layers
    names = ["block_group_id", "source_node_id", "source_coordinate", "target_node_id", "target_coordinate"]
    edges = spark.createDataFrame(out, ", ".join(f"{c} long" for c in names))
    graphs, want = {}, {False: set(), True: set()}
    for k in sorted({r[0] for r in out if r[0] is not None}):
        own = [r[1:] for r in out if r[0] == k]
        at = {}
        for n, c in {e for r in own for e in (r[:2], r[2:])}:
            at.setdefault(n, []).extend([] if c is None else [c])
        blocks = {S, T} | {(n, a, b) for n, v in at.items() if n > 2 for a, b in zip(sorted(v), sorted(v)[1:])}
        graphs[k] = {(a, b) for r in own for a in blocks for b in blocks if (a[0], a[2]) == r[:2] and (b[0], b[1]) == r[2:]}
        found = placed(graphs[k])
        want[False] |= {(k, *f) for f in found}
        meets = lambda x, y: x != y and x[0] == y[0] and (x[1] < y[2] and y[1] < x[2] or x[3] < y[4] and y[3] < x[4])
        bad = {x[0] for x in found for y in found if meets(x, y)}
        want[True] |= {(k, *f) for f in found if f[0] not in bad}
    assert len(want[True]) > 20 and len(want[False]) > len(want[True])
    for drop in (False, True):
        assert rows(G.placements_of_edges(edges, drop)) == want[drop]
    assert rows(G.placements_of_edges(edges.limit(0))) == set()


def test_placements_of_long_ways(spark):
    """Groups of more layers than are counted together, and with cycles, beside short ones."""
    chain = [(S, (3, 0, 2)), *[((i, 0, 2), (i + 1, 0, 2)) for i in range(3, 3 + 2 * G.LAYERS)], ((3 + 2 * G.LAYERS, 0, 2), T)]
    loop = [(S, (3, 0, 2)), ((3, 0, 2), (4, 0, 3)), ((4, 0, 3), (3, 0, 2)), ((4, 0, 3), T)]
    graphs = {1: ladder(4), 2: chain, 3: loop, 4: ladder(5), 5: [(S, (3, 0, 1))]}
    assert rows(G.placements(frame(spark, graphs))) == {(k, *f) for k, links in graphs.items() for f in placed(links)}


def test_graph_layout(spark):
    no_call_a_group(spark, "graph_layout")
    graphs, want = random_graphs(), set()
    graphs[1000] = ladder(2000)
    for k, links in graphs.items():
        layer, seen = {}, {}
        own = [(a, b) for a, b in links if a != b]
        into = G.successors([(b, a) for a, b in own])
        for n in G.topological(own):
            layer[n] = max((layer[a] + 1 for a in into.get(n, ()) if a in layer), default=0)
        for n in sorted(layer, key=lambda n: (layer[n], n)):
            want.add((k, *n, layer[n], seen.setdefault(layer[n], 0)))
            seen[layer[n]] += 1
    assert rows(G.layout(frame(spark, graphs))) == want


def test_derive_subgraph(spark):
    no_call_a_group(spark, "derive_subgraph")
    graphs, rng, ends, want = random_graphs(), random.Random(6), [], set()
    for k, links in graphs.items():
        blocks = sorted({b for link in links for b in link})
        for r in range(rng.randrange(3)):
            a, b = rng.choice(blocks), rng.choice(blocks)
            ends.append((k, r, a[0], a[1], b[0], b[2]))
            begin = [x for x in blocks if x[0] == a[0] and x[1] <= a[1] <= x[2]]
            stop = [x for x in blocks if x[0] == b[0] and x[1] <= b[2] <= x[2]]
            want |= {(k, r, *s, *t) for s, t in G.between(links, begin[-1], stop[0])}
    df = spark.createDataFrame([*ends, (999, 0, 3, 0, 3, 0)], "block_group_id long, range_id long, start_node long, start_at long, end_node long, end_at long")
    assert want and rows(G.links_between_blocks(frame(spark, graphs), df)) == want


def test_partition_parts(spark):
    no_call_a_group(spark, "partition_parts")
    graphs, want = {**random_graphs(), 1000: ladder(30)}, set()
    for k, links in graphs.items():
        cut, part, size = G.articulation_points(links), 0, 0
        for n in G.topological(links):
            want.add((k, part, *n))
            size += 1
            if size == 6 or size >= 3 and n in cut:
                part, size = part + 1, 0
    assert rows(G.partitioned(frame(spark, graphs), 3, 6)) == want


def test_project_path(spark):
    no_call_a_group(spark, "project_path")
    graphs, paths, want = {}, [], set()
    for k in range(30):
        n = 20_000 if k == 29 else k % 5 + 1  # a walk that is copied at every step is quadratic
        walk = [S, *[(3 + i // 2, i % 2 * 5, i % 2 * 5 + 5) for i in range(2 * n)], T]
        graphs[k] = list(zip(walk, walk[1:]))
        for own in (k * 10, k * 10 + 1):  # the second leaves the graph
            paths += [(k, own, i, 3 + i, 0, 10 if own % 10 == 0 else 11, "+") for i in range(n)]
        want |= {(k, k * 10, step, *b, "+") for step, b in enumerate(walk)}
    df = spark.createDataFrame(paths, "block_group_id long, path_id long, block long, node_id long, start long, end long, strand string")
    assert rows(G.projected_paths(frame(spark, graphs), df)) == want


def test_simple_paths(spark):
    no_call_a_group(spark, "simple_paths")
    assert "collect_list(struct(step" not in plan(spark, "simple_paths")
    graphs = {**random_graphs(), 1000: ladder(10)}
    want = {(k, n, step, *b) for k, links in graphs.items() for n, path in enumerate(G.simple_paths(links, S, T)) for step, b in enumerate(path)}
    assert rows(G.enumerated(frame(spark, graphs))) == want
    with pytest.raises(Exception, match="more than 1000 paths"):
        G.enumerated(frame(spark, graphs), 1000).collect()


def test_simple_paths_by_link(spark):
    no_call_a_group(spark, "simple_paths_by_link")
    graphs = {**random_graphs(), 1000: ladder(10)}
    want = {(k, n, step, *a, *b) for k, links in graphs.items() for n, path in enumerate(G.simple_paths(links, S, T)) for step, (a, b) in enumerate(zip(path, path[1:]))}
    assert rows(G.enumerated_links(frame(spark, graphs))) == want


def test_all_sequences(spark):
    no_call_a_group(spark, "all_sequences")
    graphs = {**random_graphs(), 1000: ladder(8)}
    rng = random.Random(7)
    text = {n: "".join(rng.choice("ACGTNacgt") for _ in range(16)) for n in range(3, 40)}
    strand = {(k, *link): rng.choice("+-") for k, links in graphs.items() for link in links}
    flip, want = str.maketrans("ACGTacgt", "TGCAtgca"), set()
    for k, links in graphs.items():
        for path in G.simple_paths(links, S, T):
            pieces = []
            for a, b in zip(path, path[1:]):
                piece = text.get(b[0], "")[b[1] : b[2]]
                pieces.append(piece[::-1].translate(flip) if strand[k, a, b] == "-" else piece)
            want.add((k, "".join(pieces)))
    df = spark.createDataFrame([(k, *a, *b, [(strand[k, a, b],)]) for k, links in graphs.items() for a, b in links], SCHEMA + ", layers array<struct<target_strand: string>>")
    nodes = spark.createDataFrame(sorted(text.items()), "node_id long, sequence string")
    assert rows(G.spelled_paths(df, nodes)) == want


def pieces(links, without=None):
    left, n = {b for link in links for b in link} - {without}, 0
    while left:
        near = {left.pop()}
        while more := {x for a, b in links for x, y in ((a, b), (b, a)) if y in near and x in left}:
            near |= more
            left -= more
        n += 1
    return n


def test_articulation(spark):
    no_call_a_group(spark, "articulation")
    graphs = random_graphs()
    want = {(k, *b) for k, links in graphs.items() for b in {x for link in links for x in link} if pieces(links, b) > pieces(links)}
    assert want and rows(G.cut_blocks(frame(spark, graphs))) == want


def test_components(spark):
    no_call_a_group(spark, "components")
    graphs, want = {**random_graphs(), 1000: [((i, 0, 0), (i + 1, 0, 0)) for i in range(3, 80_000, 2)]}, set()
    for k, links in graphs.items():
        for n in {b for link in links for b in link}:
            near, todo = {n}, [n] if k < 1000 else []
            while todo:
                m = todo.pop()
                more = {x for a, b in links for x, y in ((a, b), (b, a)) if y == m} - near
                near |= more
                todo += more
            want.add((k, *n, min(near)[0] if k < 1000 else n[0] - (n[0] + 1) % 2))
    assert rows(G.component_blocks(frame(spark, graphs))) == want  # many components: one look for each at all that is left is quadratic


def test_cycle_breaks(spark):
    no_call_a_group(spark, "cycle_breaks")
    b = lambda n: (n, 0, 0)
    ring = lambda *nodes: [(b(x), b(y)) for x, y in zip(nodes, [*nodes[1:], nodes[0]])]
    graphs = {4: [*ring(7, 5, 9), *ring(20, 30), *ring(40, 41, 42, 43)], 5: [(S, b(3)), *ring(3, 4, 5), (b(5), T)], 6: ring(3, 4, 5)}
    want = {(4, 1, 5), (4, 7, 2), (4, 7, 5), (4, 1, 40), (4, 43, 2), (4, 43, 40), (6, 1, 3), (6, 5, 2), (6, 5, 3)}
    assert rows(G.cycle_links(frame(spark, graphs))) == want


def test_intermediate_edges(spark):
    no_call_a_group(spark, "intermediate_edges")
    graphs = random_graphs()
    want = {(k, *a, *b) for k, links in graphs.items() for a, b in G.between(links, S, T)}
    assert want and rows(G.links_between(frame(spark, graphs))) == want


def test_reachable(spark):
    no_call_a_group(spark, "reachable")
    graphs = random_graphs()
    want = {(k, *b) for k, links in graphs.items() for b in G.reachable(links, [S])}
    assert rows(G.reachable_blocks(frame(spark, graphs))) == want
