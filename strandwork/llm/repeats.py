"""Removal of repeated substrings by a distributed sparse suffix array.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (in a document of smaller id, or
earlier in the same one). Strings are judged on the input and never cross documents.

Sampled suffixes. Each window of LENGTH bytes has an anchor: the leftmost of its K-grams with the smallest hash. Equal
windows have equal anchors at equal places, so it is enough to sort the suffixes that start at anchors, one byte in
some forty. An anchor owns the run of windows that chose it.

1. Anchors whose K-gram occurs once own no repeated window. K-gram hashes are dealt and sorted, and neighbours in sorted
   order are compared. A batch sends one row for each K-gram that it holds several times, so a K-gram of a third of
   all documents is a row for each batch.
2. The other anchors are sent with the bytes of their windows (their suffix, and what stands before it). Of equal ones
   in a batch the earliest goes on; the others are repeated as a whole and go on as merged stretches.
3. Sampled splitters range-partition these suffixes by their leading bytes. Each bucket sorts its suffixes by multikey
   quicksort, eight bytes at a time, and what stands before them, read backwards, likewise. The common prefixes of
   neighbours in both orders tell which windows are equal: those that start n bytes before their anchors are equal if the
   anchors lie in one run of neighbours with LENGTH - n bytes in common, and in one run of n bytes in the backward order.
4. Compare across boundaries: a suffix can have an equal window in another bucket only if it has enough bytes in common
   with the first or the last suffix of its own. Such windows, the first of their kind in the bucket, go on as bytes, and
   the earliest of equal ones is found by a grouped minimum, so no group meets in one task.

Null and empty texts have no bytes. A null id sorts before all others. Rows equal in id and text are one document and
get the same result; rows that share an id but not the text are told apart, and ordered, by a hash of the text. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.shared import as_bytes, concat_ranges, flat, kept, steps

LENGTH, K = 100, 16
GRAMS = LENGTH - K + 1  # K-grams in a window
#: Bytes of all texts for each bucket of suffixes, which a task holds.
BUCKET = 12 << 20
#: Bytes of text, and of compressed text, that a step holds some arrays or copies of.
STEP, STEP_Z = 2 << 20, 2 << 20
NO_ID = -(1 << 63)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps_ = np.full(n, BASE if name == "up" else BACK, np.uint64)
        steps_[0] = 1
        _powers[name] = np.cumprod(steps_, dtype=np.uint64)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on."""
    n = len(data) - K + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers("up", len(data)), dtype=np.uint64)])
    return mixed((total[K:] - total[:n]) * powers("down", n))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, text, place, furthest, nearest) of all anchors of some texts.

    An anchor owns the windows that start ``nearest`` to ``furthest`` bytes before it.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    hashes = gram_hashes(data)
    low = np.uint64((1 << 32) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= GRAMS:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < GRAMS:
        key = np.minimum(key[: len(key) - (GRAMS - span)], key[GRAMS - span :])
    size = np.diff(at)
    windows = np.maximum(0, size - LENGTH + 1)
    start = concat_ranges(at[:-1], windows)
    if not len(start):
        return none
    text = np.repeat(np.arange(len(size)), windows)
    place = (key[start] & low).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(start)) - 1
    anchor, own = place[new], text[new]
    return hashes[anchor], own, anchor - at[own], anchor - start[new], anchor - start[last]


def pack(place, furthest, nearest):
    """One number that sorts by place: 31, 7 and 7 bits."""
    return (place << 14) | (furthest << 7) | nearest


def unpack(packed):
    return packed >> 14, (packed >> 7) & 127, packed & 127


def candidates(docs: DataFrame) -> DataFrame:
    """(id, version, packed) of the anchors whose K-gram hash occurs more than once. docs: (id, version, text as bytes)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
            hashes, text, place, far, near = anchors(*flat(batch.column("text")))
            hashes = hashes >> np.uint64(16)  # 48 bits ask for a K-gram: a chance match is one more candidate to compare
            packed = pack(place, far, near)
            order = np.argsort(hashes, kind="stable")
            own_key = mixed(ids.view(np.uint64) ^ mixed(versions.view(np.uint64))).view(np.int64)[text[order]]
            hashes, ids, versions, packed = hashes[order].view(np.int64), ids[text[order]], versions[text[order]], packed[order]
            edge = np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]) if len(hashes) else np.ones(1, bool)
            first, twice = edge[:-1], ~(edge[:-1] & edge[1:])
            # one row asks for each K-gram; those met twice in this batch are candidates already and are dealt by their text
            asks, known = np.flatnonzero(first), np.flatnonzero(twice)
            known = known[np.lexsort((packed[known], versions[known], ids[known]))]
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([hashes[asks], own_key[known]])),
                    pa.array(np.concatenate([ids[asks], ids[known]])),
                    pa.array(np.concatenate([versions[asks], versions[known]])),
                    pa.array(np.concatenate([packed[asks], -1 - packed[known]])),  # below zero: a candidate already
                ],
                names=["key", *OWN],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, carried = None, False  # the last row so far, and whether its key came before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", *OWN)]
            if tail is not None:
                rows = [np.concatenate(pair) for pair in zip(tail, rows)]
            key, packed = rows[0], rows[-1]
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            send = same[:-1] | same[1:] | (packed < 0)
            send[0] |= carried
            send[-1] = False  # judged with the next batch
            tail, carried = [r[-1:] for r in rows], bool(same[-2])
            yield candidate(rows, send)
        if tail is not None:
            yield candidate(tail, (tail[-1] < 0) | carried)

    def candidate(rows: list[np.ndarray], send: np.ndarray) -> pa.RecordBatch:
        _, ids, versions, packed = (r[send] for r in rows)
        return pa.record_batch([pa.array(ids), pa.array(versions), pa.array(np.where(packed < 0, -1 - packed, packed))], names=OWN)

    sent = docs.mapInArrow(emit, "key long, id long, version long, packed long")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "id long, version long, packed long")


OWN = ["id", "version", "packed"]


class Zstd:
    """A zstd codec with a dictionary of a few texts, which short texts need to compress well. It loses nothing."""

    def __init__(self, texts: DataFrame, most: int = 1 << 16):
        rows = texts.where(F.octet_length("text").between(200, 1 << 13)).orderBy(F.xxhash64("id"), "id").limit(64).collect()
        self.sample, self.level = b"".join(bytes(r.text) for r in rows)[:most], 6

    def __reduce__(self):
        return _zstd, (self.sample, self.level)

    def dictionary(self):
        if not self.sample:
            return {}
        found = zstandard.ZstdCompressionDict(self.sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        found.precompute_compress(level=self.level)
        return {"dict_data": found}

    def press(self):
        return zstandard.ZstdCompressor(level=self.level, **self.dictionary()).compress

    def expand(self):
        return zstandard.ZstdDecompressor(**self.dictionary()).decompress


def _zstd(sample: bytes, level: int) -> Zstd:
    out = Zstd.__new__(Zstd)
    out.sample, out.level = sample, level
    return out


def compressed(docs: DataFrame, codec: Zstd) -> DataFrame:
    """(id, version, z): the text as a zstd frame, which is what the joins by id and version move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = codec.press()
        for batch in steps(batches):
            pressed = pa.array([press(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([batch.column("id"), batch.column("version"), pressed], names=["id", "version", "z"])

    return docs.mapInArrow(run, "id long, version long, z binary")


def suffixes(docs: DataFrame, chosen: DataFrame, codec: Zstd) -> DataFrame:
    """(suffix, before, id, version, packed): what each candidate's windows hold from the anchor on, and before it.

    A row without ``before`` is a stretch that is known to be repeated: packed is its start, and its suffix is a hash, which
    spreads such rows, and its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = codec.expand()
        for batch in steps(batches, "z", STEP_Z):
            seen: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
            done: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for own, v, z, numbers in zip(*(batch.column(c).to_pylist() for c in ("id", "version", "z")), batch.column("anchors")):
                text = expand(z)
                for packed in np.unique(numbers.values.to_numpy()).tolist():
                    place, far, near = unpack(packed)
                    what = (text[place : place + LENGTH - near], text[place - far : place])
                    now = (own, v, packed)
                    before = seen.setdefault(what, now)
                    if before != now:
                        if now < before:
                            seen[what], now = now, before
                        place, far, near = unpack(now[2])
                        done.setdefault(now[:2], []).append((place - far, place - near + LENGTH))
            known = [(own, v, a, b) for (own, v), found in done.items() for a, b in merged(*np.array(found).T)]
            ends = [xxhash.xxh3_64_digest(b"%d %d %d" % k[:3]) + k[3].to_bytes(8) for k in known]
            rows = [*seen.values(), *[k[:3] for k in known]]
            yield pa.record_batch(
                [
                    pa.array([w[0] for w in seen] + ends, pa.binary()),
                    pa.array([w[1] for w in seen] + [None] * len(known), pa.binary()),
                    *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                ],
                names=["suffix", "before", *OWN],
            )

    lists = chosen.groupBy("id", "version").agg(F.collect_list("packed").alias("anchors"))  # bounded by the text's own length
    return docs.join(lists, ["id", "version"]).select("id", "version", "z", "anchors").mapInArrow(run, "suffix binary, before binary, id long, version long, packed long")


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned numbers: rows equal so far are sorted on by their next number."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = words[order[1:], 0] == words[order[:-1], 0]
    for column in range(1, words.shape[1]):
        if not tied.any():
            break
        inside = np.append(tied, False) | np.insert(tied, 0, False)
        at = np.flatnonzero(inside)
        group = np.cumsum(~np.insert(tied, 0, False))[at]
        rows = order[at]
        order[at] = rows[np.lexsort((words[rows, column], group))]
        now = order[at]
        still = (group[1:] == group[:-1]) & (words[now[1:], column] == words[now[:-1], column])
        tied = np.zeros(len(order) - 1, bool)
        tied[at[1:][still] - 1] = True
    return order


def as_matrix(values: pa.Array, wide: int, backwards: bool = False, part: int = 1 << 12) -> np.ndarray:
    """The bytes of each value, in order or backwards, padded with zeros: a row of ``wide`` bytes each."""
    data, at = flat(values)
    out = np.zeros((len(at) - 1, wide), np.uint8)
    for a in range(0, len(out), part):  # the places of one part's bytes are held at a time
        ends = at[a : a + part + 1]
        size = np.diff(ends)
        place = concat_ranges(np.zeros(len(size)), size)
        if backwards:
            place = np.repeat(size - 1, size) - place
        out[np.repeat(np.arange(a, a + len(size)), size), place] = data[ends[0] : ends[-1]]
    return out


def sorted_rows(matrix: np.ndarray, part: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by multikey quicksort, and how many bytes each has in common with the one before it there."""
    order = multikey_quicksort(matrix.view(">u8").astype(np.uint64))
    common = np.zeros(len(order), np.int64)
    for a in range(1, len(order), part):
        b = min(len(order), a + part)
        other = matrix[order[a:b]] != matrix[order[a - 1 : b - 1]]
        common[a:b] = np.where(other.any(axis=1), other.argmax(axis=1), matrix.shape[1])
    return order, common


def runs_of(order: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its run of neighbours with ``least`` bytes in common, and whether it is alone there."""
    start = common < least
    start[:1] = True
    number, alone = np.empty(len(order), np.int64), np.empty(len(order), bool)
    number[order] = np.cumsum(start) - 1
    alone[order] = start & np.append(start[1:], True)
    return number, alone


class Bucket:
    """Suffixes of one bucket, in the order of their documents and places: which of their windows are repeated."""

    def __init__(self, suffix: pa.Array, before: pa.Array, ids: np.ndarray, versions: np.ndarray, packed: np.ndarray):
        rank = np.lexsort((packed, versions, ids))
        self.ids, self.versions = ids[rank], versions[rank]
        self.place, self.far, self.near = unpack(packed[rank])
        at = pa.array(rank)
        self.ahead, self.behind = as_matrix(suffix.take(at), 104), as_matrix(before.take(at), 88, backwards=True)
        forward, backward = sorted_rows(self.ahead), sorted_rows(self.behind)
        n = len(rank)
        self.repeated = np.zeros((n, GRAMS), bool)  # by how far a window starts before the anchor
        for o in range(GRAMS):
            ahead, alone = runs_of(*forward, LENGTH - o)
            rows = np.flatnonzero(~alone & (self.near <= o) & (o <= self.far))
            if o and len(rows):
                behind, alone = runs_of(*backward, o)
                rows = rows[~alone[rows]]
                key = ahead[rows] * n + behind[rows]
            else:
                key = ahead[rows]
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            self.repeated[rows, o] = first[which] != np.arange(len(rows))
        # bytes in common with the first or the last suffix of the bucket
        order, common = forward
        common = common.copy()
        common[:1] = self.ahead.shape[1]
        reach = np.minimum.accumulate(common)
        after = np.minimum.accumulate(np.append(common[1:], self.ahead.shape[1])[::-1])[::-1]
        self.reach = np.empty(n, np.int64)
        self.reach[order] = np.maximum(reach, after)

    def stretches(self) -> tuple[np.ndarray, ...]:
        """(id, version, start, end) of the stretches of repeated windows."""
        later = self.repeated[:, ::-1].astype(np.int8)  # in the order of their starts
        row, edge = np.nonzero(np.diff(later, axis=1, prepend=0, append=0))
        row, a, b = row[0::2], GRAMS - 1 - edge[0::2], GRAMS - edge[1::2]
        return self.ids[row], self.versions[row], self.place[row] - a, self.place[row] - b + LENGTH

    def open_windows(self, part: int = 1 << 14) -> Iterator[tuple]:
        """(id, version, start, end, window) of the first windows of their kind that another bucket may hold too."""
        o = np.arange(GRAMS)
        row, o = np.nonzero(~self.repeated & (self.near[:, None] <= o) & (o <= self.far[:, None]) & (o >= LENGTH - self.reach[:, None]))
        for a in range(0, len(row), part):
            r, n = row[a : a + part], o[a : a + part]
            at = np.arange(LENGTH) - n[:, None]  # from the anchor on
            bytes_ = np.where(at < 0, self.behind[r[:, None], np.maximum(-1 - at, 0)], self.ahead[r[:, None], np.maximum(at, 0)])
            window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(r), [None, pa.py_buffer(np.ascontiguousarray(bytes_))])
            start = self.place[r] - n
            yield self.ids[r], self.versions[r], start, start + LENGTH, window.cast(pa.binary())


def compare_buckets(rows: DataFrame) -> DataFrame:
    """(id, version, start, end, window): repeated stretches (no window), and windows still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = pc.is_null(batch.column("before"))
            done = batch.filter(known)
            start = done.column("packed").to_numpy()
            yield table(done.column("id"), done.column("version"), start, [int.from_bytes(s[8:]) for s in done.column("suffix").to_pylist()], None)
            held.append(batch.filter(pc.invert(known)))
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        if not t.num_rows:
            return
        bucket = Bucket(*(pa.concat_arrays(t.column(c).chunks) for c in ("suffix", "before")), *(t.column(c).to_numpy() for c in OWN))
        del t
        yield table(*bucket.stretches(), None)
        for found in bucket.open_windows():
            yield table(*found)

    def table(own, version, start, end, window) -> pa.RecordBatch:
        numbers = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in (own, version, start, end)]
        return pa.record_batch([*numbers, pa.nulls(len(numbers[0]), pa.binary()) if window is None else window], names=["id", "version", "start", "end", "window"])

    return rows.mapInArrow(run, "id long, version long, start long, end long, window binary")


def spans(docs: DataFrame, packed_docs: DataFrame, codec: Zstd, buckets: int) -> DataFrame:
    """(id, version, start, end): stretches to remove, overlapping and in any order."""
    ordered = suffixes(packed_docs, candidates(docs), codec).repartitionByRange(buckets, "suffix", "before")
    found = kept(compare_buckets(ordered), "repeats")
    open_ = found.where("window is not null")
    first = open_.groupBy("window").agg(F.min(F.struct("id", "version", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = open_.join(first, "window").where(F.struct("id", "version", "start") > F.col("first"))
    return found.where("window is null").select("id", "version", "start", "end").unionByName(later.select("id", "version", "start", "end"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs' rows as (id, n_bytes, spans, kept): the maximal removed runs, and the bytes that stay."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), as_bytes(text_col).alias("text"))
    sizes = plain.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n").alias("n"), F.sum("size").alias("size")).first()
    told_apart = (sizes.n or 0) > 1  # only where an id is repeated do its rows need more than the id
    plain = plain.withColumn("version", F.xxhash64("text") if told_apart else F.lit(0).cast("long"))
    codec = Zstd(plain)
    packed_docs = compressed(plain, codec)
    cuts = spans(plain.where(F.octet_length("text") >= LENGTH), packed_docs, codec, max(1, -(-(sizes["size"] or 0) // bucket)))
    cuts = cuts.groupBy("id", "version").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))  # bounded by the text's own length
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = codec.expand()
        for batch in steps(batches, "z", 1 << 20):
            ids, sizes, runs, rest = [], [], [], []
            cuts_ = batch.column("cuts")
            for k, (own, z) in enumerate(zip(batch.column("id").to_pylist(), batch.column("z").to_pylist())):
                text = expand(z)
                found = merged(*(cuts_[k].values.field(c).to_numpy() for c in ("start", "end"))) if cuts_[k].is_valid else []
                ids.append(None if own == NO_ID else own)
                sizes.append(len(text))
                runs.append([{"start": a, "end": b} for a, b in found])
                rest.append(b"".join(text[a:b] for a, b in zip([0, *[f[1] for f in found]], [*[f[0] for f in found], len(text)])))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return (
        packed_docs.join(cuts, ["id", "version"], "left")
        .select("id", "z", "cuts")
        .mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    )


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the stretches."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1].tolist()))
