"""Iterative operators on block graphs, many block groups in one call.

A block group is the unit of work: its links meet in one task, as a walk with visited nodes needs. Groups are spread over the
cluster, and a task takes thousands of small ones at once (``batches``). Enumeration of simple paths is exponential in the
number of bubbles; ``most`` bounds the paths of a group and raises an error beyond it, so no path is left out silently.

A block is (node_id, start, end); a link joins two blocks.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.scalars import slice_of, spelled
from strandwork.operators.batches import ROWS, SOURCE, TARGET, Groups, column, links_of_edges, over_groups
from strandwork.schema import END_NODE, START_NODE

#: Links that a group's longest way may have to be counted by layers together with other groups; a longer one is counted link by link.
LAYERS = 256

Block = tuple[int, int, int]
START: Block = (START_NODE, 0, 0)
END: Block = (END_NODE, 0, 0)


def links_of(pdf: pd.DataFrame) -> list[tuple[Block, Block]]:
    s, t = pdf[SOURCE].to_numpy().tolist(), pdf[TARGET].to_numpy().tolist()
    return sorted({(tuple(a), tuple(b)) for a, b in zip(s, t)})


def successors(links: Iterable[tuple]) -> dict:
    out = defaultdict(list)
    for a, b in sorted(links):
        out[a].append(b)
    return out


def reachable(links: Iterable[tuple], roots: Iterable) -> set:
    """All nodes that a walk from the roots meets, the roots among them."""
    nxt, seen = successors(links), set(roots)
    todo = list(seen)
    while todo:
        for b in nxt.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def simple_paths(links: Iterable[tuple], first, last, most: int | None = None) -> Iterator[list]:
    """Walks from first to last that meet no node twice; if both are one, the cycles back to it."""
    links = list(links)
    return walks_of(successors(links), reachable([(b, a) for a, b in links], [last]), first, last, most)


def walks_of(nxt: dict, fits: set, first, last, most: int | None = None) -> Iterator[list]:
    """simple_paths by successors; a walk that cannot arrive, as it left the nodes of fits, is not followed."""
    path, inside, found = [first], {first} if first != last else set(), 0
    todo = [iter(nxt.get(first, ()))]
    while todo:
        b = next(todo[-1], None)
        if b is None:
            todo.pop()
            inside.discard(path.pop())
        elif b == last:
            found += 1
            if most is not None and found > most:
                raise ValueError(f"more than {most} paths")
            yield [*path, b]
        elif b not in inside and b in fits and b != first:
            path.append(b)
            inside.add(b)
            todo.append(iter(nxt.get(b, ())))


def between(links: Iterable[tuple], first, last) -> list[tuple]:
    """The links on any walk from first to last."""
    links = sorted(set(links))
    ahead, behind = reachable(links, [first]), reachable([(b, a) for a, b in links], [last])
    both = ahead & behind
    return [(a, b) for a, b in links if a in both and b in both]


def articulation_points(links: Iterable[tuple]) -> list:
    """Nodes without which the undirected graph falls apart further."""
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    depth, low, cut = {}, {}, set()
    for root in sorted(near):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        children, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            node, parent, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= depth[parent]:
                        cut.add(parent)
            elif child not in depth:
                depth[child] = low[child] = depth[node] + 1
                children += node == root
                stack.append((child, node, iter(sorted(near[child]))))
            elif child != parent:
                low[node] = min(low[node], depth[child])
        if children > 1:
            cut.add(root)
    return sorted(cut)


def topological(links: Iterable[tuple]) -> list:
    """An order in which every link goes forward; nodes on cycles come last."""
    nxt, degree, nodes = successors(links), defaultdict(int), set()
    for a, b in links:
        degree[b] += 1
        nodes |= {a, b}
    todo, out = deque(sorted(n for n in nodes if not degree[n])), []
    while todo:
        n = todo.popleft()
        out.append(n)
        for b in nxt.get(n, ()):
            degree[b] -= 1
            if not degree[b]:
                todo.append(b)
    return out + sorted(nodes - set(out))


def components(links: Iterable[tuple]) -> list[list]:
    """Weakly connected components, each sorted, by their smallest node."""
    near, seen, out = defaultdict(list), set(), []
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    for n in sorted(near):
        if n in seen:
            continue
        part, todo = [], [n]
        seen.add(n)
        while todo:
            m = todo.pop()
            part.append(m)
            for b in near[m]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append(sorted(part))
    return out


def ring_ends(nxt: dict, part: list) -> tuple:
    """Start and end of the walk that unties a component of cycles: its smallest node, and the last that a walk by depth meets."""
    order, seen, todo = [], set(), [part[0]]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            order.append(n)
            todo += reversed(nxt.get(n, []))
    return min(order), order[-1]


def positions(links: list[tuple], first: Iterable, last: Iterable, length: Callable) -> tuple[dict, set]:
    """Where each node begins on the walks from a first to a last node, and the nodes on or behind cycles, of which it says nothing.

    Without cycles each walk is simple, and where a node begins follows from where those before it end: places are counted
    once, however many walks lead to them.
    """
    first, last = set(first), set(last)
    links = [(a, b) for a, b in links if a != b and b not in first and a not in last]
    both = reachable(links, first) & reachable([(b, a) for a, b in links], last)
    links = [(a, b) for a, b in links if a in both and b in both]
    nxt, degree = successors(links), defaultdict(int)
    for _, b in links:
        degree[b] += 1
    at, todo, done = {n: {0} for n in first & both}, list(first & both), set()
    while todo:
        n = todo.pop()
        done.add(n)
        ends = {x + length(n) for x in at[n]}
        for b in nxt.get(n, ()):
            at.setdefault(b, set()).update(ends)
            degree[b] -= 1
            if not degree[b]:
                todo.append(b)
    return at, both - done


def positions_by_layers(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``positions`` of all groups at once, as blocks and where they begin; then the groups with cycles or over LAYERS layers, left out.

    A block's layer is the longest way to it, so all places of a layer are there before any place follows from them.
    """
    size, length, first = len(g.node), g.end - g.start, g.mask(g.first)
    arrives = g.mask(g.last)
    keep = (g.u != g.v) & ~first[g.v] & ~arrives[g.u]
    u, v = g.u[keep], g.v[keep]

    def following(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in blocks, and the blocks that a link leads to from there."""
        begin, n = at[blocks], at[blocks + 1] - at[blocks]
        place = np.repeat(np.arange(len(blocks)), n)
        return place, v[np.arange(len(place)) + np.repeat(begin - np.cumsum(n) + n, n)]

    at = np.searchsorted(u, np.arange(size + 1))
    degree, layer, depth = np.bincount(v, minlength=size), np.full(size, -1), 0
    front = np.flatnonzero(degree == 0)
    while len(front) and depth < LAYERS:
        layer[front] = depth
        depth += 1
        hit = following(front)[1]
        np.subtract.at(degree, hit, 1)
        front = np.unique(hit[degree[hit] == 0])
    rest = np.zeros(len(g.keys), bool)
    rest[g.group[layer < 0]] = True
    order = np.argsort(layer[u], kind="stable")
    cut = np.searchsorted(layer[u[order]], np.arange(depth + 1))
    for a, b in zip(cut[-2::-1].tolist(), cut[:0:-1].tolist()):
        some = order[a:b]
        arrives[u[some[arrives[v[some]]]]] = True
    keep = arrives[v] & ~rest[g.group[u]]
    u, v = u[keep], v[keep]
    at = np.searchsorted(u, np.arange(size + 1))
    todo, blocks, begins = [[] for _ in range(depth)], [], []
    start = g.first[arrives[g.first] & ~rest]
    if len(start):
        todo[0].append((start, np.zeros(len(start), np.int64)))
    for now in todo:
        if not now:
            continue
        block, begin = (np.concatenate(c) for c in zip(*now))
        order = np.lexsort([begin, block])
        block, begin = block[order], begin[order]
        new = np.r_[True, (block[1:] != block[:-1]) | (begin[1:] != begin[:-1])]
        block, begin = block[new], begin[new]
        blocks.append(block)
        begins.append(begin)
        now.clear()
        place, to = following(block)
        begin, to_layer = (begin + length[block])[place], layer[to]
        for k in np.unique(to_layer).tolist():
            todo[k].append((to[to_layer == k], begin[to_layer == k]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(blocks or none), np.concatenate(begins or none), np.flatnonzero(rest)


def projected(links: Iterable[tuple[Block, Block]], path: list[tuple[int, int, int, str]]) -> list[tuple[Block, str]]:
    """A stored path (node, start, end, strand) as blocks of the graph, or nothing if the graph has no such walk."""
    nxt = successors(links)
    want = [(START_NODE, 0, 0, "+"), *[p for p in path if p[0] not in (START_NODE, END_NODE)], (END_NODE, 0, 0, "+")]
    # a state is (block, place in want): the next block goes on in the same slice or begins the next one
    stack, came = [(START, 0)], {(START, 0): None}
    while stack:
        state = stack.pop()
        block, k = state
        if k == len(want) - 1:
            walk = []
            while state is not None:
                walk.append((state[0], want[state[1]][3]))
                state = came[state]
            return walk[::-1]
        node, start, end, strand = want[k]
        done = block[2] == end if strand != "-" else block[1] == start
        for b in reversed(nxt.get(block, [])):
            if done or block == START:
                n, s, e, st = want[k + 1]
                fits, step = b[0] == n and (b[1] == s if st != "-" else b[2] == e), k + 1
            else:
                st, step = strand, k
                fits = b[0] == node and (b[1] == block[2] if strand != "-" else b[2] == block[1])
            if fits and (b, step) not in came:
                came[b, step] = state
                stack.append((b, step))
    return []


BLOCK = "node_id long, start long, end long"
LINK = ", ".join(f"{c} long" for c in [*SOURCE, *TARGET])
PLACED = f"{BLOCK}, path_start long, path_end long"


def per_graph(pairs: DataFrame, columns_of: Callable[[Groups], Iterable[list]], schema: str, group: str = "block_group_id", *more: str) -> DataFrame:
    """What columns_of yields for the links of many groups: columns of the result, the group's key first."""
    rows = pairs.select(group, *SOURCE, *TARGET, *more)
    return over_groups(rows, lambda table: columns_of(Groups(table, group)), f"{group} {pairs.schema[group].dataType.simpleString()}, {schema}", group)


def numbers(blocks: Iterable[int]) -> np.ndarray:
    return np.fromiter(blocks, np.int64)


def reachable_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of each group that a walk from the start node meets."""
    return per_graph(pairs, lambda g: [g.blocks(np.sort(numbers(reachable(g.links(), g.first.tolist()))))], BLOCK)


def links_between(pairs: DataFrame) -> DataFrame:
    """Links of each group on any walk from the start to the end node."""

    def columns(g: Groups) -> Iterator[list]:
        links = g.links()
        both = g.mask(reachable(links, g.first.tolist())) & g.mask(reachable([(b, a) for a, b in links], g.last.tolist()))
        keep = both[g.u] & both[g.v]
        yield [*g.blocks(g.u[keep]), *g.blocks(g.v[keep])[1:]]

    return per_graph(pairs, columns, LINK)


def links_between_blocks(pairs: DataFrame, ends: DataFrame, group: str = "block_group_id") -> DataFrame:
    """Links of each group on any walk from a start to an end block.

    ends: (group, start_node, start_at, end_node, end_at), with range_id if a group has several, which the links then carry.
    The start block is the last of its node's that holds the coordinate, the end block the first.
    """
    carry = [c for c in ("range_id",) if c in ends.columns]
    asked = ["start_node", "start_at", "end_node", "end_at", *carry]
    rows = pairs.select(group, *SOURCE, *TARGET).unionByName(ends.select(group, *[F.col(c).cast("long").alias(c) for c in asked]), allowMissingColumns=True)

    def columns(table: pa.Table) -> Iterator[list]:
        is_link = table.column(SOURCE[0]).is_valid()
        right = table.filter(table.column(SOURCE[0]).is_null())
        if not right.num_rows or right.num_rows == table.num_rows:
            return
        g = Groups(table.filter(is_link), group)
        place = np.searchsorted(g.keys, column(right, group))
        cols, found, own = [right.column(c).to_pylist() for c in asked], [], []
        node, start, end = g.node.tolist(), g.start.tolist(), g.end.tolist()
        for k, key, first, at, last, to, *mine in zip(place.tolist(), column(right, group).tolist(), *cols):
            if k == len(g.keys) or g.keys[k] != key:
                continue
            held = range(g.blocks_at[k], g.blocks_at[k + 1])
            begin = [b for b in held if node[b] == first and start[b] <= at <= end[b]]
            stop = [b for b in held if node[b] == last and start[b] <= to <= end[b]]
            if begin and stop:
                links = g.links(slice(g.links_at[k], g.links_at[k + 1]))
                way = between(links, begin[-1], stop[0])
                found += way
                own += mine * len(way)
        u, v = numbers(a for a, _ in found), numbers(b for _, b in found)
        yield [*g.blocks(u)[:1], *([pa.array(own, pa.int64())] if carry else []), *g.blocks(u)[1:], *g.blocks(v)[1:]]

    schema = ", ".join([f"{group} long", *[f"{c} long" for c in carry], LINK])
    return over_groups(rows, columns, schema, group)


def walks(pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(group, path, blocks): all simple paths of each group from start to end, in a fixed order, a row each."""

    def columns(g: Groups) -> Iterator[list]:
        links = g.links()
        nxt, fits = successors(links), reachable([(b, a) for a, b in links], g.last.tolist())
        found = ((k, n, path) for k, (a, b) in enumerate(zip(g.first.tolist(), g.last.tolist())) for n, path in enumerate(walks_of(nxt, fits, a, b, most)))
        while some := list(islice(found, ROWS // 8)):
            at = np.cumsum([0, *[len(path) for _, _, path in some]], dtype=np.int32)
            steps = g.blocks(np.concatenate([path for _, _, path in some]))[1:]
            blocks = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(c) for c in steps], ["node_id", "start", "end"]))
            yield [g.keys[[k for k, _, _ in some]], np.array([n for _, n, _ in some]), blocks]

    return per_graph(pairs, columns, "path long, blocks array<struct<node_id: bigint, start: bigint, end: bigint>>")


def enumerated(pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(group, path, step, node_id, start, end): the steps of ``walks``."""
    return walks(pairs, most).select("block_group_id", "path", F.posexplode("blocks").alias("step", "b")).select("block_group_id", "path", F.col("step").cast("long").alias("step"), "b.*")


def links_of_walk(blocks: str = "blocks") -> Column:
    """An array of (a, b): the neighbours of an array of blocks."""
    n = F.size(blocks)
    return F.arrays_zip(F.slice(blocks, F.lit(1), n - 1).alias("a"), F.slice(blocks, F.lit(2), n - 1).alias("b"))


def enumerated_links(pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(group, path, step, source and target block): the same paths by their links."""
    got = walks(pairs, most).select("block_group_id", "path", F.posexplode(links_of_walk()).alias("step", "x"))
    ends = [F.col(f"x.{side}.{c}").alias(name) for side, names in (("a", SOURCE), ("b", TARGET)) for c, name in zip(("node_id", "start", "end"), names)]
    return got.select("block_group_id", "path", F.col("step").cast("long").alias("step"), *ends)


def layout(pairs: DataFrame) -> DataFrame:
    """(group, node_id, start, end, layer, row): each block's layer is the longest way to it, rows count the blocks of a layer."""

    def columns(g: Groups) -> Iterator[list]:
        links = [(a, b) for a, b in g.links() if a != b]
        into, layer = successors([(b, a) for a, b in links]), {}
        for n in topological(links):
            layer[n] = max((layer[a] + 1 for a in into.get(n, ()) if a in layer), default=0)
        block, depth = numbers(layer), numbers(layer.values())
        order = np.lexsort([block, depth, g.group[block]])
        block, depth = block[order], depth[order]
        new = np.r_[True, (depth[1:] != depth[:-1]) | (g.group[block[1:]] != g.group[block[:-1]])][: len(block)]
        place = np.arange(len(block))
        yield [*g.blocks(block), depth, place - np.maximum.accumulate(np.where(new, place, 0))]

    return per_graph(pairs, columns, f"{BLOCK}, layer long, row long")


def cut_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks without which their group's graph falls apart further."""
    return per_graph(pairs, lambda g: [g.blocks(numbers(articulation_points(g.links())))], BLOCK)


def component_blocks(pairs: DataFrame) -> DataFrame:
    """(group, node_id, start, end, component): each block with the node of the smallest block that it is connected with."""

    def columns(g: Groups) -> Iterator[list]:
        parts = components(g.links())
        yield [*g.blocks(numbers(n for part in parts for n in part)), g.node[numbers(part[0] for part in parts for _ in part)]]

    return per_graph(pairs, columns, f"{BLOCK}, component long")


def cycle_links(pairs: DataFrame) -> DataFrame:
    """(group, source, target): links that tie components of three or more nodes without start and end: in to the start of a walk, out of its end, and back."""

    def columns(g: Groups) -> Iterator[list]:
        links, source, target = g.links(), [], []
        nxt, virtual = successors(links), {*g.first.tolist(), *g.last.tolist()}
        for part in components(links):
            if len(part) < 3 or not virtual.isdisjoint(part):
                continue
            start, end = ring_ends(nxt, part)
            k = g.group[start]
            source += [g.first[k], end, end]
            target += [start, g.last[k], start]
        u, v = numbers(source), numbers(target)
        yield [*g.blocks(u)[:2], g.node[v]]

    return per_graph(pairs, columns, "source long, target long")


def partitioned(pairs: DataFrame, smallest: int, largest: int) -> DataFrame:
    """(group, part, node_id, start, end): blocks in topological order, cut at an articulation point once a part has ``smallest`` blocks, at the latest at ``largest``."""

    def columns(g: Groups) -> Iterator[list]:
        links = g.links()
        cut, order = set(articulation_points(links)), numbers(topological(links))
        order = order[np.argsort(g.group[order], kind="stable")]
        parts, last = [], None
        for n, k in zip(order.tolist(), g.group[order].tolist()):
            if k != last:
                part, size, last = 0, 0, k
            parts.append(part)
            size += 1
            if size >= largest or size >= smallest and n in cut:
                part, size = part + 1, 0
        key, *block = g.blocks(order)
        yield [key, numbers(parts), *block]

    return per_graph(pairs, columns, f"part long, {BLOCK}")


def placements(pairs: DataFrame, drop_ambiguous: bool = False, most: int = 1_000_000) -> DataFrame:
    """(group, node_id, start, end, path_start, path_end): where blocks lie on any walk of their group from start to end.

    drop_ambiguous leaves out all placements of nodes of which two overlap without being equal. A group with cycles on the way
    is enumerated, path by path.
    """
    return per_graph(pairs, lambda g: [placed(g, drop_ambiguous, most)], PLACED)


def placements_of_edges(edges: DataFrame, drop_ambiguous: bool = False, most: int = 1_000_000, group: str = "block_group_id") -> DataFrame:
    """placements(blocks.graph(edges)) in one shuffle: whole groups make their links where they are flattened."""

    def columns(table: pa.Table) -> Iterator[list]:
        links = links_of_edges(table, group)
        if links.num_rows:
            yield placed(Groups(links, group), drop_ambiguous, most)

    rows = edges.where(F.col(group).isNotNull()).select(group, *[f"{side}_{c}" for side in ("source", "target") for c in ("node_id", "coordinate")])
    return over_groups(rows, columns, f"{group} {edges.schema[group].dataType.simpleString()}, {PLACED}", group)


def placed(g: Groups, drop_ambiguous: bool, most: int) -> list:
    """Columns of ``placements``."""
    block, begin, rest = positions_by_layers(g)
    if len(rest):
        held = np.isin(g.group[g.u], rest)
        length = (g.end - g.start).tolist()
        at, cyclic = positions(g.links(held), g.first[rest].tolist(), g.last[rest].tolist(), length.__getitem__)
        for k in np.unique(g.group[numbers(cyclic)]).tolist():
            for n in range(g.blocks_at[k], g.blocks_at[k + 1]):
                at.pop(n, None)
            own = g.links(slice(g.links_at[k], g.links_at[k + 1]))
            for path in simple_paths(own, int(g.first[k]), int(g.last[k]), most):
                past = 0
                for n in path:
                    at.setdefault(n, set()).add(past)
                    past += length[n]
        block = np.concatenate([block, np.repeat(numbers(at), numbers(map(len, at.values())))])
        begin = np.concatenate([begin, numbers(x for v in at.values() for x in v)])
    keep = ~(g.mask(g.first) | g.mask(g.last))[block]
    block, begin = block[keep], begin[keep]
    order = np.lexsort([begin, block])
    block, begin = block[order], begin[order]
    key, node, start, end = g.blocks(block)
    rows = [key, node, start, end, begin, begin + end - start]
    if drop_ambiguous and len(block):
        new = np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])]
        own = np.cumsum(new) - 1
        clear = np.ones(own[-1] + 1, bool)
        # in the order of starts, and ends for equal ones, some range meets the next one if any two meet; blocks are in that order
        for order, a, b in ((slice(None), start, end), (np.lexsort([rows[5], rows[4], own]), rows[4], rows[5])):
            o, a, b = own[order], a[order], b[order]
            clear[o[1:][(o[1:] == o[:-1]) & (a[1:] < b[:-1])]] = False
        rows = [c[clear[own]] for c in rows]
    return rows


def spelled_paths(pairs: DataFrame, node_sequences: DataFrame, group: str = "block_group_id", most: int = 1_000_000) -> DataFrame:
    """(group, sequence): the distinct sequences that the walks of each group spell, strands of links included."""
    strand = F.element_at(F.col("layers"), 1)["target_strand"]
    piece = F.when(~F.col("target_node_id").isin(START_NODE, END_NODE), spelled(slice_of("sequence", "target_start", "target_end"), strand))
    named = node_sequences.select(F.col("node_id").alias("target_node_id"), "sequence")
    linked = pairs.join(named, "target_node_id", "left").withColumn("piece", F.coalesce(piece, F.lit("")))

    def columns(g: Groups) -> Iterator[list]:
        text = dict(zip(zip(g.row_u.tolist(), g.row_v.tolist()), g.table.column("piece").to_pylist()))
        links = g.links()
        nxt, fits = successors(links), reachable([(b, a) for a, b in links], g.last.tolist())
        keys, out = [], []
        for k, (a, b) in enumerate(zip(g.first.tolist(), g.last.tolist())):
            own = {"".join([text[link] for link in zip(path, path[1:])]) for path in walks_of(nxt, fits, a, b, most)}
            keys += [k] * len(own)
            out += sorted(own)
        yield [g.keys[keys] if keys else [], pa.array(out, pa.string())]

    return per_graph(linked, columns, "sequence string", group, "piece")


def projected_paths(pairs: DataFrame, path_blocks: DataFrame, group: str = "block_group_id") -> DataFrame:
    """(group, path_id, step, node_id, start, end, strand) of each stored path on its group's split graph.

    path_blocks: (group, path_id, block, node_id, start, end, strand). A path that the graph does not hold has no rows.
    """
    own = path_blocks.select(group, *[F.col(c).cast("long").alias(f"_{c}") for c in ("path_id", "block", "node_id", "start", "end")], "strand")
    rows = pairs.select(group, *SOURCE, *TARGET).unionByName(own, allowMissingColumns=True)

    def columns(table: pa.Table) -> Iterator[list]:
        is_link = table.column(SOURCE[0]).is_valid()
        paths = table.filter(table.column(SOURCE[0]).is_null())
        if not paths.num_rows or paths.num_rows == table.num_rows:
            return
        left = table.filter(is_link)
        key = column(left, group)
        ends = [list(zip(*(column(left, c).tolist() for c in side))) for side in (SOURCE, TARGET)]
        pkey, path_id, block = column(paths, group), column(paths, "_path_id"), column(paths, "_block")
        order = np.lexsort([block, path_id, pkey])
        pkey, path_id = pkey[order], path_id[order]
        new = np.flatnonzero(np.r_[True, (pkey[1:] != pkey[:-1]) | (path_id[1:] != path_id[:-1])])
        steps = list(zip(*(column(paths, c)[order].tolist() for c in ("_node_id", "_start", "_end")), paths.column("strand").take(pa.array(order)).to_pylist()))
        groups, ids, found = [], [], []
        from_, to = np.searchsorted(key, pkey[new]).tolist(), np.searchsorted(key, pkey[new], "right").tolist()
        for a, b, i, j in zip(from_, to, new.tolist(), [*new[1:].tolist(), len(pkey)]):
            walk = projected(set(zip(ends[0][a:b], ends[1][a:b])), steps[i:j]) if b > a else []
            groups += [pkey[i]] * len(walk)
            ids += [path_id[i]] * len(walk)
            found += [(k, *at, s) for k, (at, s) in enumerate(walk)]
        if found:
            *cols, strand = zip(*found)
            yield [np.array(groups), np.array(ids), *[np.array(c) for c in cols], pa.array(strand, pa.string())]

    return over_groups(rows, columns, f"{group} long, path_id long, step long, {BLOCK}, strand string", group)
