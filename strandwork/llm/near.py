"""SimHash near-duplicates held against the exact similarity of five-word shingles, and completed by it.

``simhash.near_duplicates`` links fingerprints by their bits alone. Here two texts are near if the Jaccard similarity of
their sets of five-word shingles is LEAST or more. A fingerprint of 64 bits tells the nearest apart from the rest but not
all that are near (at a similarity of 0.8 some ten bits differ), so its links are candidates that are verified, and the
pairs that it misses come from an exact prefix filter.

A shingle is the 64-bit hash of five neighbouring words; a text of fewer words is one shingle. Equal sets are one node,
so a group of copies of any size is one row from then on; empty texts are equal to each other and near to nothing else.

Candidates are made in two rounds. In the first, the links of the SimHash trie join, and pairs of each set with the
smallest that it meets in a shingle, so a group of near copies becomes one component by a number of pairs that grows with
the group, not with its square. In the second, all that meet and are not yet in one component.

The prefix filter: two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of each, in any one
order. Here shingles that many texts hold come last, and else the order is that of the hashes: a line that stands in a
third of all texts is in the prefix of those alone that hold little else. Which shingles come last is found by counting in
all texts; it changes the order and by it the work, not the pairs. Sets that meet are candidates where their sizes and
places leave enough in common, and are then compared whole. Nothing is sampled or capped, so the components are those of
all pairs. A bound from counts by class of hash keeps most pairs from being compared; it leaves out no pair that is near.

The shingles of a set are not stored: they are hashed again for the sets that candidates name, which a bitmap of fixed
size picks out (some more pass it, and the join by id leaves them).

Rows whose id is null take no part; an id that several rows share is one node, near to what any of them is near to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.llm.components import components
from strandwork.llm.shared import as_bytes, concat_ranges, flat, forget, kept, steps
from strandwork.llm.simhash import links, shingle_hashes, simhashes, with_groups

SIZE, LEAST = 5, 0.8
#: Bytes of text in which shingles are counted, the share of their texts that must hold a shingle (OFTEN texts at least) for
#: it to come last, and how many such shingles the order knows (the most frequent; the others are ordered as rare ones).
COUNTED, SHARE, OFTEN, KNOWN = 8 << 20, 0.002, 8, 1 << 18
#: Classes of hashes that are counted for the bound at first and before sets are moved, bits of the bitmap of ids, and pairs that one step looks at.
CLASSES, FINE, BITS, PAIRS = 64, 512, 1 << 24, 1 << 16


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending (int64)."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64).view(np.int64))


def least_common(n, m, least: float = LEAST):
    """How many shingles two sets of n and m have in common at least, for a similarity of ``least``."""
    return np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64)


def prefix(n: int, least: float = LEAST) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def classes(found: np.ndarray, many: int = CLASSES) -> bytes:
    """How many hashes fall in each class; 255 stands for any number from there on."""
    return np.minimum(np.bincount(found & (many - 1), minlength=many), 255).astype(np.uint8).tobytes()


def enough(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether sets with counts a and b by class (a row each) can have as many shingles in common as they need."""
    return (np.minimum(a, b).sum(1, dtype=np.int64) >= need) | ((a == 255) & (b == 255)).any(1)


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).where("id is not null")


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, k1, k2, shingle, texts): fingerprint and 128-bit hash of the set of each text, and rows of shingles that many texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], 0, 0
        for batch in steps(batches):
            every = [np.array(shingle_hashes(t, SIZE), np.uint64) for t in batch.column("text").to_pylist()]
            sets = [np.unique(h) for h in every]
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = np.array([[k >> 64, k & ((1 << 64) - 1)] for k in keys], np.uint64).reshape(-1, 2).view(np.int64)
            yield table(batch.column("id"), simhashes(every).view(np.int64), halves[:, 0], halves[:, 1])
            held += sets
            texts, size = texts + batch.num_rows, size + batch.nbytes
            if size >= COUNTED:
                yield often(held, texts)
                held, texts, size = [], 0, 0
        if held:
            yield often(held, texts)

    def often(sets: list[np.ndarray], texts: int) -> pa.RecordBatch:
        found, count = np.unique(np.concatenate(sets), return_counts=True)
        many = count >= max(OFTEN, SHARE * texts)
        return table(None, None, None, None, found[many].view(np.int64), count[many])

    def table(*columns) -> pa.RecordBatch:
        size = next(len(c) for c in columns if c is not None)
        columns = [*columns, *[None] * (6 - len(columns))]
        return pa.record_batch([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=["id", "fp", "k1", "k2", "shingle", "texts"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, fp long, k1 long, k2 long, shingle long, texts long")


def last_first(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A set's shingles in the order of the prefix filter: those in ``last`` (ascending) come last."""
    if not len(last) or not len(found):
        return found
    late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
    return np.concatenate([found[~late], found[late]])


def heads(docs: DataFrame, last: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, classes, prefix): size, counts by class and prefix of each set that is not empty."""
    shared = docs.sparkSession.sparkContext.broadcast(last)  # at most KNOWN numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [(i, found) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if len(found := shingles(t))]
            yield pa.record_batch(
                [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([len(f) for _, f in rows], pa.int64()),
                    binary([classes(f) for _, f in rows]),
                    pa.array([last_first(f, shared.value)[: prefix(len(f))] for _, f in rows], pa.list_(pa.int64())),
                ],
                names=["id", "n", "classes", "prefix"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n long, classes binary, prefix array<long>")


def may_be_near(n: np.ndarray, pos: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, if the shingle at their places pos is the first that they share, can have enough in common."""
    need = least_common(n[i], n[j])
    ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
    ok[ok] = enough(counts[i[ok]], counts[j[ok]], need[ok])
    return ok


def candidates(rows: DataFrame, first_only: bool) -> DataFrame:
    """(a, b), a < b: ids of different components that meet in a shingle. rows: (h, id, pos, n, classes, component)."""

    def pairs(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        if first_only:
            i = np.repeat(start, size - 1)
            yield i, concat_ranges(start + 1, size - 1)
            return
        at = np.arange(len(h))
        after = np.repeat(start + size, size) - at - 1
        step = np.cumsum(after) // PAIRS
        for k in np.flatnonzero(np.bincount(step)):
            own = at[step == k]
            yield np.repeat(own, after[own]), concat_ranges(own + 1, after[own])

    def solve(t: pa.Table) -> pa.RecordBatch:
        col = {c: t.column(c).to_numpy() for c in ("h", "id", "pos", "n", "component")}
        counts = np.frombuffer(b"".join(t.column("classes").to_pylist()), np.uint8).reshape(-1, CLASSES)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in pairs(col["h"]):
            ok = col["component"][i] != col["component"][j]
            i, j = i[ok], j[ok]
            ok = may_be_near(col["n"], col["pos"], counts, i, j)
            a.append(np.minimum(col["id"][i[ok]], col["id"][j[ok]]))
            b.append(np.maximum(col["id"][i[ok]], col["id"][j[ok]]))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # rows of the last shingle wait for the next batch
            if cut or (held and held[-1].column("h")[-1].as_py() != h[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = rows.select("h", "id", "pos", "n", "classes", "component").repartition("h").sortWithinPartitions("h", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def spread(rows: DataFrame) -> DataFrame:
    """Small rows of many tasks, dealt evenly to as few as they need: few files, however many the texts have."""
    return rows.withColumn("_row", F.monotonically_increasing_id()).repartition("_row").drop("_row")


def named_sets(docs: DataFrame, pairs: DataFrame, what: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n, what) of the sets that pairs name, and of some more: size, and counts by FINE classes (fine) or hashes (found)."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit.alias("bit"))
    words = named.groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("value")).collect()
    held = np.zeros(BITS // 32, np.uint32)
    for r in words:  # at most BITS / 32 rows
        held[r.word] = r.value
    bitmap = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bitmap.value[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)))
            for part in steps([batch]):
                every = [shingles(t) for t in part.column("text").to_pylist()]
                rows = binary([classes(f, FINE) if what == "fine" else f.tobytes() for f in every])
                yield pa.record_batch([part.column("id"), pa.array([len(f) for f in every], pa.int64()), rows], names=["id", "n", what])

    made = _texts(docs, id_col, text_col).withColumn("bit", bit).mapInArrow(run, f"id long, n long, {what} binary")
    return kept(spread(made), f"near-{what}")


def verified(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): the pairs whose sets have a similarity of LEAST or more."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("x", "y"))
            ok = enough(x, y, least_common(batch.column("n").to_numpy(), batch.column("m").to_numpy()))
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, a), (right, b) = flat(batch.column("x")), flat(batch.column("y"))
            ok = []
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[a[k] : a[k + 1]], np.int64), np.frombuffer(right[b[k] : b[k + 1]], np.int64)
                ok.append(bool(len(x) and len(y)) and len(np.intersect1d(x, y, assume_unique=True)) >= least_common(len(x), len(y)))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    sets = named_sets(docs, pairs, "fine", id_col, text_col)
    one = pairs.join(sets.select(F.col("id").alias("a"), "n", F.col("fine").alias("x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("fine").alias("y")), "b")
    close = kept(both.select("a", "b", "n", "m", "x", "y").mapInArrow(likely, "a long, b long").distinct(), "near-likely")
    forget(sets)
    sets = named_sets(docs, close, "found", id_col, text_col)  # the whole sets of what the counts leave
    one = close.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    out = kept(both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long").distinct(), "near-links")
    forget(sets)
    forget(close)
    return out


def several(sets: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): links between the nodes of the sets that rows of one id have; None if every id stands once."""
    many = sets.groupBy("id").count().where("count > 1").select("id")
    if many.isEmpty():
        return None
    each = sets.join(many, "id").select("id", "k1", "k2").distinct()
    own = with_groups(each, nodes.select("k1", "k2", "n", "node"), ["k1", "k2"], "n").select("id", "node")
    return own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").where("node != b").select(F.col("node").alias("a"), "b").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """(id, component) of each row whose id is not null; component is the smallest id that near copies reach, itself included."""
    spark = docs.sparkSession
    every = kept(spread(facts(docs, id_col, text_col)), "near-facts")
    counted = every.where("texts is not null").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    most = counted.orderBy(F.desc("texts"), "shingle").limit(KNOWN).select("shingle").collect()
    last = np.sort(np.array([r.shingle for r in most], np.int64))
    sets = every.where("texts is null").select("id", "fp", "k1", "k2")
    nodes = kept(sets.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "near-nodes")
    tied = several(sets, nodes)
    groups = kept(nodes.groupBy("fp").agg(F.min("node").alias("id"), F.count(F.lit(1)).alias("n")), "near-groups")
    equal = nodes.select("fp", "node").join(groups.where("n > 1"), "fp").where("node != id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    by_bits = links(groups.select("fp", "id"), budget).unionByName(equal)
    head = kept(heads(docs, last, id_col, text_col).join(nodes.select(F.col("node").alias("id")), "id", "left_semi"), "near-heads")
    posts = head.select("id", F.posexplode("prefix").alias("pos", "h")).select("h", "id", F.col("pos").cast("long").alias("pos"))
    shared = kept(posts.withColumn("rows", F.count(F.lit(1)).over(W.partitionBy("h"))).where("rows > 1").drop("rows"), "near-shared")
    rows = shared.join(head.select("id", "n", "classes"), "id")
    pairs = by_bits.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star = kept(candidates(rows.withColumn("component", F.col("id")), True).unionByName(pairs).distinct(), "near-star")
    first = verified(docs, star, id_col, text_col)
    first = first if tied is None else first.unionByName(tied)
    named = components(spark, first).select(F.col("node").alias("id"), "root")
    rest = kept(candidates(rows.join(named, "id", "left").withColumn("component", F.coalesce("root", "id")), False), "near-rest")
    second = verified(docs, rest, id_col, text_col)
    found = components(spark, first.unionByName(second))
    final = kept(nodes.join(found.select("node", "root"), "node", "left").select("k1", "k2", "n", F.coalesce("root", "node").alias("component")), "near-named")
    return with_groups(sets, final, ["k1", "k2"], "n").select("id", "component")
