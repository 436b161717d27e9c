"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The windows of all benchmark items form a hash set that every executor gets. Its size is checked first: a
benchmark with more than ``MOST_WORDS`` words is dealt into blocks (an item may span several, overlapping by a window
less one word). Each block is a pass of its own over the texts that writes the hits of distinct texts to the shared
folder, and its set is gone before the next one is made; the passes' hits are then joined to the rows by a hash of the
text. So what is broadcast is bounded and no item is left out. A document's windows are looked up by a rolling hash of
word numbers and each hit is verified on the words themselves.

Nulls and empty texts have no words and no hits; an item without words matches nothing. Items that share an
id count as one. Items whose id is null count as one item without a name, a null among the items found. Rows are judged
each on its own, repeated ones too; extra columns are carried whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandwork.llm.shared import as_bytes, kept, steps, words

WINDOW = 10
#: Words of benchmark items in one broadcast set (some 100 MB of executor memory at most).
MOST_WORDS = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class NgramSet:
    """The windows of some items (id and words): hashes by length, and the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, found in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in found]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                self.owners[tuple(ids[at : at + window])].add(item)
        by_length = defaultdict(list)
        for gram in self.owners:
            by_length[len(gram)].append(gram)
        self.hashes = {n: np.unique(self.rolling(np.array(v, np.int64))[:, 0]) for n, v in by_length.items()}

    @staticmethod
    def rolling(ids: np.ndarray, length: int | None = None) -> np.ndarray:
        """Hash of each window of ``length`` along the last axis."""
        length = length or ids.shape[-1]
        many = ids.shape[-1] - length + 1
        out = np.zeros((*ids.shape[:-1], many), np.uint64)
        held = (ids.astype(np.uint64) + np.uint64(1)) * MIX
        for j in range(length):
            out = out * np.uint64(0x100000001B3) + held[..., j : j + many]
            out ^= out >> np.uint64(29)
        return out

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, the windows (start, length) that occur in an item, and those items."""
        found = words(text)
        if not found or not self.number:
            return len(found), [], set()
        number = self.number
        ids = np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        spans, items = [], set()
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            if 4 * len(starts) > len(ids):
                seen = self.rolling(ids, length)[starts]
            else:
                seen = self.rolling(ids[starts[:, None] + np.arange(length)])[:, 0]
            at = np.minimum(np.searchsorted(hashes, seen), len(hashes) - 1)
            for s in starts[hashes[at] == seen].tolist():
                owners = self.owners.get(tuple(ids[s : s + length].tolist()))
                if owners:
                    spans.append((s, length))
                    items |= owners
        return len(found), spans, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int, window: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items as lists of words, in blocks of at most ``most`` words (2 * window at least); a longer item comes in pieces."""
    most = max(most, 2 * window)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), as_bytes(text_col).alias("text"))
    held, size = [], 0
    for row in rows.toLocalIterator():
        found = words(row.text)
        at = 0
        while found:
            piece = found[at : at + most]
            if held and size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((row.item, piece))
            size += len(piece)
            if at + most >= len(found):
                break
            at += most - window + 1  # the windows across the cut stand in the next piece
    yield held


RUNS = "array<struct<start:bigint,length:bigint>>"
#: Parts that the rows of one text are dealt to where they meet its hits.
SALT = 16


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """One row for each of docs: row (a struct of its columns), text (its bytes), n_words, hits and items.

    hits: the runs of hit words as (start, length), sorted and disjoint; items: the sorted ids, as strings, then null if
    an item without an id was found.
    """
    spark = docs.sparkSession
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), as_bytes(text_col).alias("text"))
    schema = StructType([*plain.schema, *spark.createDataFrame([], f"n_words long, hits {RUNS}, items array<string>").schema])
    blocks = _blocks(benchmark, item_id, item_text, most_words, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        grams = spark.sparkContext.broadcast(NgramSet(block, window))  # at most ``most_words`` words

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                n_words, hits, items = zip(*[grams.value.hits(t) for t in batch.column("text").to_pylist()])
                yield result(batch, n_words, hits, items)

        return plain.mapInArrow(one, schema)

    passes = None
    texts = plain.select(F.md5("text").alias("key"), "text")
    for number, block in enumerate(chain([block, after], blocks)):
        grams = spark.sparkContext.broadcast(NgramSet(block, window))  # at most ``most_words`` words

        def run(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                found = {}
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                    if key not in found:
                        _, spans, items = grams.value.hits(text)
                        found[key] = ([{"start": s, "length": n} for s, n in runs(spans)], named(items))
                found = {key: v for key, v in found.items() if v[0]}
                yield pa.record_batch(
                    [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], HITS), pa.array([v[1] for v in found.values()], pa.list_(pa.string()))],
                    names=["key", "hits", "items"],
                )

        once = texts.mapInArrow(run, f"key string, hits {RUNS}, items array<string>").groupBy("key").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
        found = kept(once, f"contamination-{number}")
        grams.destroy()
        passes = found if passes is None else passes.unionByName(found)
    every = passes.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    every = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = plain.withColumn("key", F.md5("text")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hits = [[(h["start"], h["length"]) for h in found or ()] for found in batch.column("hits").to_pylist()]
            yield result(batch, [len(words(t)) for t in batch.column("text").to_pylist()], hits, [x or () for x in batch.column("items").to_pylist()])

    return dealt.join(every, ["key", "salt"], "left").select("row", "text", "hits", "items").mapInArrow(merge, schema)


HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def named(items) -> list[str | None]:
    """Item ids as sorted strings, the null id last."""
    return sorted(x for x in items if x is not None) + [None] * (None in items)


def result(batch: pa.RecordBatch, n_words, hits, items) -> pa.RecordBatch:
    listed = [[{"start": s, "length": n} for s, n in runs(spans)] for spans in hits]
    return pa.record_batch(
        [batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(listed, HITS), pa.array([named(x) for x in items], pa.list_(pa.string()))],
        names=["row", "text", "n_words", "hits", "items"],
    )


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs (start, length) that cover the same words."""
    out: list[list[int]] = []
    for start, length in sorted(set(spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b - a) for a, b in out]


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with the hit words of each text cut out; texts without hits stay as they are."""
    found = contamination(docs, benchmark, text_col, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [cut(t, h) if h else None for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cut"])

    done = found.mapInArrow(run, StructType([found.schema["row"], StructField("cut", StringType())]))
    return done.select(
        *[(F.coalesce("cut", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def cut(text: bytes, hits: list[dict]) -> str:
    """The text without its hit words (numbers of words as words() counts them)."""
    plain = np.frombuffer(text.translate(_MARK), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain, [0]])))
    begins, ends = edge[0::2], edge[1::2]
    drop = np.zeros(len(text), bool)
    for h in hits:
        drop[begins[h["start"]] : ends[h["start"] + h["length"] - 1]] = True
    return np.frombuffer(text, np.uint8)[~drop].tobytes().decode("utf-8", "replace")


_MARK = bytes(int(c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in range(256))
