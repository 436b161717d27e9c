"""Many block groups in one call: whole groups of sorted rows as one table, their blocks as numbers.

A call for each group costs milliseconds before any work is done, and graphs are often a dozen links. Here a call takes
thousands of groups. Blocks of different groups have different numbers, so a walk over all links of a table stays within its
groups. A group is never cut; one of more rows than a table usually has is a table of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwork.schema import END_NODE, START_NODE

SOURCE = ["source_node_id", "source_start", "source_end"]
TARGET = ["target_node_id", "target_start", "target_end"]
#: Rows after which a table ends with the group, and the most rows of a list column that are held before they are sent.
ROWS = 1 << 15


def whole_groups(batches: Iterable[pa.RecordBatch], group: str, rows: int = ROWS) -> Iterator[pa.Table]:
    """Rows sorted by group as tables that hold whole groups, of at least ``rows`` rows but the last."""
    held, count, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group).to_numpy(zero_copy_only=False)
        if count >= rows:
            begin = int(np.argmax(keys == keys[-1]))  # what comes before the batch's last group is whole
            if begin or keys[0] != last:
                yield pa.Table.from_batches([*held, batch.slice(0, begin)])
                held, count, batch = [], 0, batch.slice(begin)
        held.append(batch)
        count += batch.num_rows
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class Groups:
    """Links of whole groups. Blocks are numbered by group, node, start and end; every group has its two virtual blocks.

    table: (group, source block, target block) sorted by group; other columns stay in ``table``, whose row i joins the blocks
    ``row_u[i]`` and ``row_v[i]``. ``u`` and ``v`` are the distinct links in order. Group k has the links and blocks from ``links_at[k]``
    and ``blocks_at[k]`` to the next.
    """

    def __init__(self, table: pa.Table, group: str):
        keys, n = column(table, group), table.num_rows
        new = np.r_[True, keys[1:] != keys[:-1]]
        self.table, self.keys, self.of_row = table, keys[new], np.cumsum(new) - 1
        every, k = np.arange(len(self.keys)), len(self.keys)
        zero = np.zeros(k, np.int64)
        cols = [np.concatenate([self.of_row, self.of_row, every, every])]
        for c, first, last in zip(zip(SOURCE, TARGET), (START_NODE, 0, 0), (END_NODE, 0, 0)):
            cols.append(np.concatenate([column(table, c[0]), column(table, c[1]), zero + first, zero + last]))
        order = np.lexsort(cols[::-1])
        differs = np.zeros(len(order), bool)
        differs[0] = True
        for c in cols:
            c = c[order]
            differs[1:] |= c[1:] != c[:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(differs) - 1
        self.group, self.node, self.start, self.end = (c[order[differs]] for c in cols)
        self.row_u, self.row_v, self.first, self.last = number[:n], number[n : 2 * n], number[2 * n : 2 * n + k], number[2 * n + k :]
        size = len(self.node)
        links = np.unique(self.row_u * size + self.row_v)
        self.u, self.v = links // size, links % size
        self.blocks_at = np.searchsorted(self.group, np.arange(k + 1))
        self.links_at = np.searchsorted(self.group[self.u], np.arange(k + 1))

    def links(self, keep: np.ndarray | slice = slice(None)) -> list[tuple[int, int]]:
        return list(zip(self.u[keep].tolist(), self.v[keep].tolist()))

    def mask(self, blocks: Iterable[int]) -> np.ndarray:
        out = np.zeros(len(self.node), bool)
        out[np.fromiter(blocks, np.int64)] = True
        return out

    def blocks(self, numbers: np.ndarray) -> list[np.ndarray]:
        """Columns of blocks: key of the group, node, start, end."""
        return [self.keys[self.group[numbers]], self.node[numbers], self.start[numbers], self.end[numbers]]


def links_of_edges(table: pa.Table, group: str) -> pa.Table:
    """The links of edges of whole groups, as ``blocks.graph`` has them, without layers: a row for each edge between two blocks.

    table: (group, source node and coordinate, target node and coordinate) sorted by group. A node's blocks lie between its
    neighbouring coordinates, those of edges without a link among them; an end without a node or coordinate is none.
    """
    keys, n = column(table, group), table.num_rows
    held = [table.column(c) for side in ("source", "target") for c in (f"{side}_node_id", f"{side}_coordinate")]
    there = [c.is_valid().to_numpy() for c in held]
    source, at, target, to = (c.fill_null(0).to_numpy() for c in held)
    end = np.flatnonzero(np.concatenate([there[0] & there[1], there[2] & there[3]]))
    own = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
    cols = [c[end] for c in (np.concatenate([own, own]), np.concatenate([source, target]), np.concatenate([at, to]))]
    order = np.lexsort(cols[::-1])
    own, node, place = (c[order] for c in cols)
    other = np.r_[True, (own[1:] != own[:-1]) | (node[1:] != node[:-1])][: len(end)]  # a node begins
    new = other | np.r_[True, place[1:] != place[:-1]][: len(end)]
    number = np.cumsum(new) - 1
    place, other, terminal = place[new], other[new], np.isin(node[new], (START_NODE, END_NODE))
    virtual = terminal & (place == 0)
    far, fits = np.zeros((2, 2 * n), np.int64), np.zeros(2 * n, bool)
    before = np.where(terminal, 0, np.r_[0, place[:-1]][: len(place)])
    after = np.where(terminal, 0, np.r_[place[1:], 0][: len(place)])
    far[0, end[order]], far[1, end[order]] = before[number], after[number]
    out = end[order] < n
    fits[end[order]] = np.where(out, (virtual | ~terminal & ~other)[number], (virtual | ~terminal & ~np.r_[other[1:], True][: len(other)])[number])
    keep = fits[:n] & fits[n:]
    found = [keys, source, far[0, :n], at, target, to, far[1, n:]]
    return pa.table([c[keep] for c in found], [group, *SOURCE, *TARGET])


def over_groups(rows: DataFrame, columns: Callable[[pa.Table], Iterable[list]], schema: str, group: str) -> DataFrame:
    """The columns that columns(table) yields, any number of times, for each table of whole groups."""
    names = [c.split()[0] for c in re.sub("<.*>", "", schema).split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            for found in columns(table):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return rows.repartition(group).sortWithinPartitions(group).mapInArrow(run, schema)
