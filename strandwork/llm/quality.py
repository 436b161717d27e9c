"""Quality by a byte-level convolutional network, in numpy.

Learned filters of WIDTH bytes slide over every byte of a text. The text is covered by overlapping chunks; in each
chunk every filter keeps its highest answer, and a text's features are the mean, lowest and highest of these over
all its chunks, which one logistic layer turns into a probability. A filter is a table of one weight for each place
and byte, so its answer is WIDTH look-ups.

Only texts are inputs. The fit sees a bounded sample of labelled rows (see ``fit``). Null and empty texts count as one
chunk of padding. Repeated rows have equal scores; extra columns are ignored. Without both classes in the sample every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.learning import Adam, fold, labelled_sample, logistic, sigmoid
from strandwork.llm.shared import as_bytes, concat_ranges, flat, steps

FILTERS, WIDTH = 12, 5
CHUNK, STRIDE = 256, 192
#: Bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 12
TRAIN_STEPS, TRAIN_BATCH = 500, 48
#: Bytes of a long text whose answers (4 * FILTERS bytes each) are held at a time.
PART = 1 << 20


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each followed by WIDTH - 1 zero bytes; the chunks' first places; chunks of each text."""
    size = np.diff(at)
    room = np.maximum(size, 1) + WIDTH - 1
    begins = np.cumsum(room) - room
    out = np.zeros(room.sum(), np.uint8)
    out[concat_ranges(begins, size)] = data
    counts = np.maximum(1, -(-(size - (CHUNK - STRIDE)) // STRIDE))
    starts = np.repeat(begins, counts) + STRIDE * concat_ranges(np.zeros(len(counts)), counts)
    return out, starts, counts


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": (0.4 * rng.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": (0.2 * rng.standard_normal(3 * FILTERS)).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.calibrated = np.zeros(3 * FILTERS + 1)
        self.constant: float | None = None

    def answers(self, data: np.ndarray, most: int = 1 << 12) -> np.ndarray:
        """Each filter's answer at each place (the last WIDTH - 1 places have none)."""
        n = len(data) - WIDTH + 1
        out, held = np.empty((n, FILTERS), np.float32), np.empty((most, FILTERS), np.float32)
        for a in range(0, n, most):
            b = min(n, a + most)
            index = data[a : b + WIDTH - 1].astype(np.intp)
            np.take(self.p["filters"][0], index[: b - a], axis=0, out=out[a:b], mode="clip")
            for j in range(1, WIDTH):
                np.take(self.p["filters"][j], index[j : b - a + j], axis=0, out=held[: b - a], mode="clip")
                out[a:b] += held[: b - a]
        return out

    def pooled(self, answers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Highest answer of each filter in each chunk, [start, end)."""
        # chunks overlap: pool the stretches between all borders first, then the few stretches of each chunk
        borders = np.unique(np.concatenate([starts, ends]))
        parts = np.maximum.reduceat(answers, borders[borders < len(answers)], axis=0)
        first, last = np.searchsorted(borders, starts), np.searchsorted(borders, ends)
        pairs = np.column_stack([first, last]).ravel()
        safe = np.concatenate([parts, np.full((1, parts.shape[1]), -np.inf, np.float32)])
        return np.maximum.reduceat(safe, pairs, axis=0)[::2]

    def features(self, data: np.ndarray, at: np.ndarray):
        """Mean, lowest and highest of tanh(pooled answer + bias) over each text's chunks."""
        whole, starts, counts = padded(data, at)
        size = np.maximum(np.diff(at), 1)
        begins = np.cumsum(size + WIDTH - 1) - (size + WIDTH - 1)
        ends = np.minimum(starts + CHUNK, np.repeat(begins + size, counts))
        answers = self.answers(whole)
        high = np.tanh(self.pooled(answers, starts, ends) + self.p["bias"])
        first = np.cumsum(counts) - counts
        found = np.concatenate(
            [np.add.reduceat(high, first, axis=0) / counts[:, None], np.minimum.reduceat(high, first, axis=0), np.maximum.reduceat(high, first, axis=0)],
            axis=1,
        )
        return found, (whole, starts, ends, counts, answers, high, first)

    def train_step(self, data: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        found, (whole, starts, ends, counts, answers, high, first) = self.features(data, at)
        d = (sigmoid(found @ self.p["out"] + self.p["last"]) - y).astype(np.float32) / len(y)
        grads = {"out": found.T @ d + 1e-3 * self.p["out"], "last": d.sum(keepdims=True)}
        d_found = d[:, None] * self.p["out"]
        owner = np.repeat(np.arange(len(counts)), counts)
        f = FILTERS
        d_high = d_found[owner, :f] / counts[owner, None]
        d_high += d_found[owner, f : 2 * f] * (high == found[owner, f : 2 * f])
        d_high += d_found[owner, 2 * f :] * (high == found[owner, 2 * f :])
        d_high *= 1 - high * high
        grads["bias"] = d_high.sum(axis=0)
        best = np.stack([a + answers[a:b].argmax(axis=0) for a, b in zip(starts.tolist(), ends.tolist())])
        d_filters = np.zeros_like(self.p["filters"])
        which = np.broadcast_to(np.arange(f), best.shape)
        for j in range(WIDTH):
            np.add.at(d_filters[j], (whole[best + j], which), d_high)
        grads["filters"] = d_filters
        return grads


def train(texts: list[bytes], y: np.ndarray, weights: np.ndarray, seed: int = 11) -> Network:
    net = Network(seed)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    adam = Adam(net.p, 0.01)
    for step in range(TRAIN_STEPS):
        adam.rate = 0.01 * (1 - step / TRAIN_STEPS) + 0.0005
        pick = np.concatenate([rng.choice(s, TRAIN_BATCH // 2) for s in sides])
        adam.step(net.train_step(*joined([texts[k] for k in pick]), y[pick]))
    found = np.concatenate([net.features(*joined(texts[k : k + 64]))[0] for k in range(0, len(texts), 64)])
    net.calibrated = logistic(found, y, weights, ridge=1e-4)
    return net


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def scores(net: Network, data: np.ndarray, at: np.ndarray, most: int = PART) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(at) - 1, net.constant)
    long = len(at) == 2 and len(data) > most
    found = long_features(net, data, most) if long else net.features(data, at)[0]
    return sigmoid(found @ net.calibrated[:-1] + net.calibrated[-1])


def long_features(net: Network, data: np.ndarray, most: int = PART) -> np.ndarray:
    """The features of one text, from parts of about ``most`` bytes of it, so that the answers of one part are held at a time."""
    chunks = max(1, -(-(len(data) - (CHUNK - STRIDE)) // STRIDE))
    many = max(1, most // STRIDE)
    total, low, high = np.zeros(FILTERS), np.full(FILTERS, np.inf), np.full(FILTERS, -np.inf)
    for first in range(0, chunks, many):
        starts = STRIDE * np.arange(first, min(chunks, first + many))
        base, end = starts[0], min(len(data), starts[-1] + CHUNK)
        part = np.zeros(end - base + WIDTH - 1, np.uint8)  # the bytes after the part, or padding at the text's end
        held = data[base : end + WIDTH - 1]
        part[: len(held)] = held
        best = np.tanh(net.pooled(net.answers(part), starts - base, np.minimum(starts + CHUNK, len(data)) - base) + net.p["bias"])
        total += best.sum(axis=0)
        low, high = np.minimum(low, best.min(axis=0)), np.maximum(high, best.max(axis=0))
    return np.concatenate([total / chunks, low, high])[None]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted on at most ``rows`` labelled texts outside the held-out fold (see ``labelled_sample`` for the bounds)."""
    return train(*labelled_sample(docs, labels, label, fold(id_col, 3) != 1, rows, most_bytes, id_col=id_col, text_col=text_col))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded: the filters, some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 20):
            got = scores(held.value, *flat(batch.column("text")))
            yield pa.record_batch([batch.column("id"), pa.array(got, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(run, "id long, score double")
