"""Removal of repeated strings against a brute-force version."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandwork.llm import repeats

L = repeats.LENGTH


def order(doc):
    """Null ids first; rows of one id by the signed 64-bit hash of the text."""
    own, text = doc
    return own is not None, own or 0, int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))


def brute(docs):
    """docs: (id, text bytes) in order of id and then text; spans of removed bytes by (id, text)."""
    seen, out = set(), {}
    for own, text in sorted(set(docs), key=order):
        cover = np.zeros(len(text) + 1, int)
        for k in range(len(text) - L + 1):
            w = text[k : k + L]
            if w in seen:
                cover[k] += 1
                cover[k + L] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[own, text] = list(zip(edge[0::2].tolist(), edge[1::2].tolist()))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, shared = text(120), text(40)
    docs = [(k, (text(20) + " " + shared + " " + text(rng.randint(5, 40))).encode()) for k in range(60)]
    docs += [(100 + k, base.encode()) for k in range(20)]
    for k in range(30):
        words = base.split()
        words[rng.randrange(len(words))] = "edit"
        docs.append((200 + k, " ".join(words).encode()))
    docs += [(300, b""), (301, b"short"), (302, b"a" * 700), (303, b"ab" * 300), (304, ("é" * 40 + shared).encode()), (305, base.encode()[:L]), (None, base.encode()), (7, shared.encode()), (7, shared.encode())]
    return docs


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 1500])
def test_against_brute_force(spark, bucket):
    check(spark, corpus(), bucket)


def test_without_repeated_ids(spark):
    """Where every id stands once no row needs a hash beside it."""
    docs = [(k, t) for k, (_, t) in enumerate(corpus())]
    check(spark, docs, 3000)


def test_many_null_ids(spark):
    """Rows without an id are told apart by their texts, in time that grows with their number."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    shared = text()
    docs = [(None, (text() + " " + shared).encode()) for _ in range(1200)] + [(None, shared.encode())] * 400
    before = time.time()
    check(spark, docs, 1 << 20)
    assert time.time() - before < 60


def test_buckets_at_random():
    """Windows of a bucket against a set of all windows, on texts that are mostly repeated."""
    rng = random.Random(11)
    for trial in range(20):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        docs = [(k, 0, " ".join(rng.choice(words) for _ in range(rng.randint(5, 25))).encode()) for k in range(40)]
        data = np.frombuffer(b"".join(t for *_, t in docs), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for *_, t in docs])])
        _, text, place, far, near = repeats.anchors(data, at)
        rows = [(docs[t][2][p : p + L - b], docs[t][2][p - a : p]) for t, p, a, b in zip(text.tolist(), place.tolist(), far.tolist(), near.tolist())]
        if not rows:
            continue
        mixed = np.random.default_rng(trial).permutation(len(rows))
        suffix, before = (pa.array([rows[k][j] for k in mixed], pa.binary()) for j in (0, 1))
        bucket = repeats.Bucket(suffix, before, text[mixed], np.zeros(len(rows), np.int64), repeats.pack(place, far, near)[mixed])
        got = {}
        for own, _, a, b in zip(*(c.tolist() for c in bucket.stretches())):
            got.setdefault(own, []).append((a, b))
        want = brute([(k, t) for k, _, t in docs])
        for k, _, t in docs:
            assert repeats.merged(*np.array(got.get(k, np.zeros((0, 2), int))).reshape(-1, 2).T) == want[k, t]
        for own, _, start, end, window in bucket.open_windows():
            assert [docs[i][2][a:b] for i, a, b in zip(own.tolist(), start.tolist(), end.tolist())] == window.to_pylist()


def check(spark, docs, bucket):
    df = spark.createDataFrame([(i, t.decode(), "x") for i, t in docs], "doc_id long, text string, id string").repartition(5)
    got = repeats.remove(df, bucket=bucket).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.n_bytes, [(s.start, s.end) for s in r.spans], hashlib.sha256(bytes(r.kept)).hexdigest()))
    expect = {}
    for own, text in docs:
        cut = want[own, text]
        keep = b"".join(text[a:b] for a, b in zip([0, *[c[1] for c in cut]], [*[c[0] for c in cut], len(text)]))
        expect.setdefault(own, []).append((len(text), cut, hashlib.sha256(keep).hexdigest()))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in expect.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove(df).collect() == []


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = repeats.multikey_quicksort(words)
    assert [tuple(words[k]) for k in order] == sorted(map(tuple, words))
