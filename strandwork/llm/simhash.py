"""SimHash near-duplicates by a binary-trie self-join.

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are first grouped, so a
group of copies of any size is one trie leaf. Fingerprints within the error budget are then found by
walking a binary trie against itself: pairs of nodes go down together, their differing bits add up, and
a pair is dropped once it exceeds the budget. With an error budget of e, splitting the bits into e + 1
blocks leaves at least one block without error, so the tries are built per (block, value) bucket. A
bucket with too many fingerprints is refined by splitting its remaining bits again; the last level leaves
so few free bits that its buckets are bounded, whatever the data.

Each bucket returns a spanning forest of its links, which keeps every connection, and the components come
from alternating star contraction (see ``components``).

Nulls: a null text counts as empty (fingerprint zero); rows with a null id keep their fingerprint, take no
part in linking and get a null component. Rows that share an id count as one document. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.components import components
from strandwork.llm.shared import as_bytes, kept, steps

SEED = 42
#: Distinct fingerprints that one bucket may hold before it is refined.
BUCKET = 20_000
#: Rows of one fingerprint from which on its group is broadcast where rows meet their groups.
HOT = 1 << 16


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each of a text's word shingles, repeats included; of a shorter text's words; none of an empty one."""
    digest, found = xxhash.xxh64_intdigest, text.lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= size:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = [0, *(ends[:-size] + 1).tolist()]
    return [digest(line[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())]


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """64-bit SimHash of each text's word shingles (uint64)."""
    return simhashes([np.array(shingle_hashes(t, size), np.uint64) for t in texts])


def simhashes(hashes: list[np.ndarray]) -> np.ndarray:
    """Of each array of hashes the bits that more than half of them have; 0 of an empty one."""
    out = np.zeros(len(hashes), np.uint64)
    counts = np.array([len(h) for h in hashes], np.int64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    values = np.concatenate([hashes[r] for r in rows]).astype("<u8")
    counts = counts[rows]
    first = np.cumsum(counts) - counts
    ones = np.empty((len(first), 64), np.int64)
    for byte in range(8):  # a byte of all hashes at a time keeps the unpacked bits small
        bits = np.unpackbits(values.view(np.uint8)[byte::8].reshape(-1, 1), axis=1, bitorder="little")
        ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    wins = (2 * ones > counts[:, None]).astype(np.uint64)
    out[rows] = (wins << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            fps = fingerprints(batch.column("text").to_pylist(), size)
            yield pa.record_batch([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def trie_self_join(values: np.ndarray, bucket: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs within ``budget`` bits, inside each bucket.

    values: uint64, ascending and distinct inside each bucket; bucket: ascending. A trie node is a run of
    values with equal leading bits. All live node pairs go down one level at a time.
    """
    roots = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    ends = np.append(roots[1:], len(values))
    a0, a1 = roots[ends - roots > 1], ends[ends - roots > 1]
    b0, b1, spent = a0, a1, np.zeros(len(a0), np.int8)
    left, right = [], []
    for level in range(63, -1, -1):
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)  # two single values: no need to go further down
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, spent = (v[~leaf] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum(values >> np.uint64(level) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, spent, None),
            (am, a1, bm, b1, spent, None),
            (a0, am, bm, b1, spent + 1, None),
            (am, a1, b0, bm, spent + 1, ~same),
        ]
        live = []
        for p0, p1, q0, q1, cost, also in parts:
            keep = (p1 > p0) & (q1 > q0) & (cost <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            keep = keep if also is None else keep & also
            live.append([v[keep] for v in (p0, p1, q0, q1, cost)])
        a0, a1, b0, b1, spent = (np.concatenate(v) for v in zip(*live))
    if len(a0):  # equal values do not occur, so what is left are pairs of single values
        left.append(a0[a0 != b0])
        right.append(b0[a0 != b0])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join what was not yet joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, parts)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def links(groups: DataFrame, budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a spanning forest of the links between the groups' ids. groups: (fp, id), fp distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None or held.empty else pd.concat([held, pdf], ignore_index=True)
            last = (held.path == held.path.iloc[-1]) & (held.value == held.value.iloc[-1])
            yield solve(held[~last])
            held = held[last]
        if held is not None:
            yield solve(held)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        new = (pdf.path.to_numpy()[1:] != pdf.path.to_numpy()[:-1]) | (pdf.value.to_numpy()[1:] != pdf.value.to_numpy()[:-1])
        run_of = np.concatenate([[0], np.cumsum(new)])
        fps = pdf.fp.to_numpy().view(np.uint64)
        order = np.lexsort((fps, run_of))
        ids = pdf.id.to_numpy()[order]
        a, b = trie_self_join(fps[order], run_of[order], budget)
        return pd.DataFrame(forest(ids[a], ids[b]), columns=["a", "b"], dtype="int64")

    def rows_of(df: DataFrame, blocks: list[tuple[int, int]], at: Column | None = None) -> DataFrame:
        each = [F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for p, m in blocks]
        return df.select("fp", "id", F.inline(F.array(*each)) if at is None else F.inline(at))

    blocks = {p: part for p, part in enumerate(_split(list(range(64)), budget + 1))}
    rows = rows_of(groups, [(p, _mask(fixed)) for p, fixed in blocks.items()])
    out = None
    while True:
        free = 64 - min(map(len, blocks.values()))
        hot = None
        if 1 << free > bucket:
            hot = kept(rows.groupBy("path", "value").count().where(F.col("count") > bucket).select("path", "value"), "simhash-hot")
            hot = None if hot.isEmpty() else hot
        cold = rows if hot is None else rows.join(hot, ["path", "value"], "left_anti")
        found = cold.repartition("path", "value").sortWithinPartitions("path", "value").mapInPandas(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        inner, choices = {}, []
        for p, fixed in blocks.items():
            parts = _split([b for b in range(64) if b not in set(fixed)], budget + 1)
            made = {p * (budget + 1) + j: fixed + part for j, part in enumerate(parts)}
            inner |= made
            each = [F.struct(F.lit(q).alias("path"), F.col("fp").bitwiseAND(F.lit(_mask(v))).alias("value")) for q, v in made.items()]
            choices.append((p, F.array(*each)))
        at = F.coalesce(*[F.when(F.col("path") == p, x) for p, x in choices])
        rows = rows.join(hot, ["path", "value"], "left_semi").select("fp", "id", F.inline(at))
        blocks = inner


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the smallest id that links reach."""
    spark = docs.sparkSession
    fps = kept(with_fingerprint(docs, id_col, text_col, size), "simhash-fp")
    groups = kept(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    roots = components(spark, links(groups.select("fp", "id"), budget))
    named = groups.join(roots.withColumnRenamed("node", "id"), "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component"))
    found = with_groups(fps, kept(named, "simhash-named"), ["fp"], "n")
    return found.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], n: str, hot: int = HOT) -> DataFrame:
    """rows left-joined with the columns of groups, one row for each key; n: its number of rows.

    The groups of more than ``hot`` rows, of which there are at most one for each ``hot`` rows, are broadcast, so that a
    group of a third of all rows is not one task's.
    """
    large = groups.where(F.col(n) > hot).drop(n)
    if large.isEmpty():
        return rows.join(groups.drop(n), key, "left")
    cold = rows.join(F.broadcast(large), key, "left_anti").join(groups.where(F.col(n) <= hot).drop(n), key, "left")
    return cold.unionByName(rows.join(F.broadcast(large), key))
