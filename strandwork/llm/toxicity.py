"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (by a hash of the word) beside the mean of the vectors of its character n-grams. The
first coordinate of both is the log odds of the label, drawn towards zero where few texts of the sample hold the word or
n-gram; the others are learned. While fitting, a text sees the odds that the texts of the other FOLDS - 1 parts of the
sample give, so the network learns how far odds can be trusted on texts that had no part in them.

The network reads overlapping windows of words in both directions, attention pools a window's states into one
logit, and a text's score comes from its highest window; all windows of the whole text are scored. NETWORKS such networks,
which differ in their first weights and in the windows that they saw, give the mean of their logits.

Only texts are inputs. The fit sees a bounded sample of labelled rows (see ``fit``); in a toxic text it learns from
the windows that score highest so far, in a clean one from all. Null and empty texts have the lowest score that the
network can give. Repeated rows have equal scores; extra columns are ignored or carried, whatever their names. Without
both classes in the sample every score is the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandwork.llm.learning import Adam, fold, labelled_sample, logistic, sigmoid
from strandwork.llm.shared import as_bytes, concat_ranges, steps, words

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
#: Parts of the sample, and texts that odds must outweigh.
FOLDS, SHRINK = 8, 7.0
NETWORKS = 2
GRAMS = (3, 4, 5)
#: Bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 13
TRAIN_STEPS, TRAIN_BATCH = 300, 192
TABLE_RATE = 0.02
#: Texts of the sample that must share a row of the word or n-gram table for it to count.
SUPPORT = 4
THRESHOLD = 0.3
#: Words whose inputs one Python worker remembers.
REMEMBERED = 60_000


def word_features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, rows of all its character n-grams, and how many n-grams it has."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in found), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in found], np.int64)
    owner = np.repeat(np.arange(len(found)), size)
    whole = np.zeros(len(found), np.uint64)
    ends = np.cumsum(size)
    mixed = (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(data)) - np.repeat(ends - size, size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xC2B2AE3D27D4EB4F)), ends - size) if len(found) else whole
    rows, owners = [], []
    for n in GRAMS:
        many = len(data) - n + 1
        if many <= 0:
            continue
        inside = np.flatnonzero(owner[:many] == owner[n - 1 :])
        h = np.full(len(inside), n, np.uint64)
        for j in range(n):
            h = (h ^ data[inside + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(31)
        rows.append(((h >> np.uint64(7)) % np.uint64(CHAR_ROWS)).astype(np.int64))
        owners.append(owner[inside])
    rows, owners = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return whole ^ (whole >> np.uint64(29)), rows[order], np.bincount(owners, minlength=len(found))


def window_starts(n: int) -> np.ndarray:
    """First words of the windows that cover n words."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def windows_of(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (padded at the end), and how many each text has."""
    sizes = np.array([len(x) for x in ids], np.int64)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    room = counts * STRIDE + WINDOW - STRIDE
    flat = np.full(room.sum(), pad, np.int64)
    begins = np.cumsum(room) - room
    flat[concat_ranges(begins, sizes)] = np.concatenate(ids) if ids else []
    starts = np.repeat(begins, counts) + STRIDE * concat_ranges(np.zeros(len(counts)), counts)
    return flat[starts[:, None] + np.arange(WINDOW)], counts


def summed(row: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """For each of ``many`` rows, the sum of the values that belong to it."""
    return np.column_stack([np.bincount(row, v, many) for v in values.T]).astype(np.float32)


class Network:
    """Parameters, inputs of words, and both passes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (0.1 * rng.standard_normal((WORD_ROWS, WORD_DIM - 1))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((CHAR_ROWS, CHAR_DIM - 1))).astype(np.float32),
            "look": small(2 * h),
            "out": small(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p |= {f"w{way}": small(d, 3 * h), f"u{way}": small(h, 3 * h), f"b{way}": np.zeros(3 * h, np.float32)}
        self.words = np.zeros(0, np.uint64)
        self.odds = {"word": np.zeros(1, np.float32), "char": np.zeros(CHAR_ROWS, np.float32)}
        self.calibrated = np.array([1.0, 0.0])
        self.constant: float | None = None
        self.others: list[Network] = []

    def inputs(self, word: np.ndarray, rows: np.ndarray, counts: np.ndarray, odds: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Inputs of words; ``odds`` are those of a part of the sample, else those of all of it."""
        odds = odds or self.odds
        grams = np.zeros((len(word), CHAR_DIM), np.float32)
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            grams[some, 1:] = np.add.reduceat(self.p["char"][rows], starts, axis=0) / counts[some, None]
            grams[some, 0] = np.add.reduceat(odds["char"][rows], starts) / counts[some]
        return np.concatenate([odds["word"][self.place(word), None], self.p["word"][table_row(word)], grams], axis=1)

    def place(self, word: np.ndarray) -> np.ndarray:
        """Places of words among those that the sample holds; the last place is that of all others."""
        at = np.searchsorted(self.words, word)
        return np.where(self.words[np.minimum(at, len(self.words) - 1)] == word, at, len(self.words)) if len(self.words) else at

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * HIDDEN): what each word adds to the gates, forward and backward."""
        return np.stack([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]])

    def forward(self, gates: np.ndarray, grid: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logit of each window.

        gates: (2, words, 3 * HIDDEN); grid: (time, windows), rows of gates; live: the same shape, 1 where a word
        stands. Inside, features come first and windows last, so every operation runs along the windows.
        """
        many, wide = grid.shape[1], HIDDEN
        states, trail = np.empty((len(grid), 2 * wide, many), np.float32), {}
        for way, order in ((0, range(len(grid))), (1, range(len(grid) - 1, -1, -1))):
            u = np.ascontiguousarray(self.p["uf" if way == 0 else "ub"].T)
            table, h = gates[way], np.zeros((wide, many), np.float32)
            for t in order:
                x = np.ascontiguousarray(table[grid[t]].T)
                r = u @ h
                zg = x[: 2 * wide]
                zg += r[: 2 * wide]
                zg *= 0.5
                np.tanh(zg, out=zg)
                zg *= 0.5
                zg += 0.5
                c = x[2 * wide :]
                c += zg[wide:] * r[2 * wide :]
                np.tanh(c, out=c)
                new = h + live[t] * (1 - zg[:wide]) * (c - h)
                if keep:
                    trail[way, t] = (h, zg[:wide], zg[wide:], c, r[2 * wide :])
                h = new
                states[t, way * wide : (way + 1) * wide] = h
        look = np.einsum("h,thn->tn", self.p["look"], states) + (live - 1) * 1e4
        look -= look.max(axis=0)
        share = np.exp(look) * np.maximum(live, 1e-9)
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,thn->hn", share, states)
        logit = self.p["out"] @ pooled + self.p["bias"]
        return (logit, states, share, pooled, trail) if keep else logit

    def train_step(self, x: np.ndarray, grid: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the cross-entropy, and that of the words' inputs x (words, d)."""
        wide, many = HIDDEN, grid.shape[1]
        logit, states, share, pooled, trail = self.forward(self.projected(x), grid, live, keep=True)
        d_logit = ((sigmoid(logit) - y) / many).astype(np.float32)
        grads = {"out": pooled @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = self.p["out"][:, None] * d_logit
        d_share = np.einsum("thn,hn->tn", states, d_pooled)
        d_look = share * (d_share - (share * d_share).sum(axis=0))
        grads["look"] = np.einsum("tn,thn->h", d_look, states)
        d_x = np.zeros_like(x)
        for way, order in ((0, range(len(grid) - 1, -1, -1)), (1, range(len(grid)))):
            name, part = "fb"[way], slice(way * wide, (way + 1) * wide)
            u, d_u = self.p[f"u{name}"], np.zeros_like(self.p[f"u{name}"])
            d_gates = np.empty((*grid.shape, 3 * wide), np.float32)
            d_h = np.zeros((wide, many), np.float32)
            for t in order:
                before, z, g, c, r = trail[way, t]
                d_h = d_h + share[t] * d_pooled[part] + d_look[t] * self.p["look"][part, None]
                d_c = d_h * live[t] * (1 - z) * (1 - c * c)
                d_z = d_h * live[t] * (before - c) * z * (1 - z)
                d_g = d_c * r * g * (1 - g)
                d_r = np.concatenate([d_z, d_g, d_c * g])
                d_gates[t] = np.concatenate([d_z, d_g, d_c]).T
                d_u += before @ d_r.T
                d_h = d_h * (1 - live[t] * (1 - z)) + u @ d_r
            d_table = summed(grid.ravel(), d_gates.reshape(-1, 3 * wide), len(x))
            grads |= {f"u{name}": d_u, f"w{name}": x.T @ d_table, f"b{name}": d_table.sum(axis=0)}
            d_x += d_table @ self.p[f"w{name}"].T
        return grads, d_x


def train(texts: list[bytes], y: np.ndarray, weights: np.ndarray, seed: int = 7, networks: int = NETWORKS) -> Network:
    """A network, and in its ``others`` those that score beside it."""
    net = train_one(texts, y, weights, seed)
    if net.constant is None:
        for k in range(1, networks):
            other = train_one(texts, y, weights, seed + k)
            other.words, other.odds = net.words, net.odds  # equal, and so sent once
            net.others.append(other)
    return net


def train_one(texts: list[bytes], y: np.ndarray, weights: np.ndarray, seed: int) -> Network:
    net = Network(seed)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t in texts]
    word, rows, counts = word_features(list(number))
    begins = np.cumsum(counts) - counts

    net.words = np.unique(word)
    row_of, learned_row = net.place(word), table_row(word)
    part = np.arange(len(ids)) % FOLDS
    seen = {"word": np.zeros((FOLDS, 2, len(net.words) + 1), np.float32), "char": np.zeros((FOLDS, 2, CHAR_ROWS), np.float32)}
    for x, label, f in zip(ids, y.tolist(), part.tolist()):
        own = np.unique(x)
        seen["word"][f, label, np.unique(row_of[own])] += 1
        seen["char"][f, label, np.unique(rows[concat_ranges(begins[own], counts[own])])] += 1
    parts = []
    for f in range(FOLDS):
        here = np.bincount(y[part != f], minlength=2)
        parts.append({name: log_odds(v.sum(axis=0) - v[f], here) for name, v in seen.items()})
    net.odds = {name: log_odds(v.sum(axis=0), np.bincount(y, minlength=2)) for name, v in seen.items()}
    texts_of_word = seen["word"].sum(axis=(0, 1))
    learned = {"word": summed(learned_row, texts_of_word[row_of, None], WORD_ROWS)[:, 0] >= SUPPORT, "char": seen["char"].sum(axis=(0, 1)) >= SUPPORT}
    learned = {name: v.astype(np.float32)[:, None] for name, v in learned.items()}
    for name in learned:  # rows that too few texts share stay zero, in training and in scoring
        net.p[name] *= learned[name]

    pad = len(number)
    grid, per_text = windows_of(ids, pad)
    owner = np.repeat(np.arange(len(ids)), per_text)

    def window_scores(of) -> np.ndarray:
        """of(gates or odds of a part, its windows), for the windows of each part of the sample."""
        out = np.zeros(len(grid), np.float32)
        for f in range(FOLDS):
            mine = np.flatnonzero(part[owner] == f)
            out[mine] = of(net.inputs(word, rows, counts, parts[f]), grid[mine])
        return out

    score = window_scores(lambda x, cells: np.append(x[:, 0] + x[:, WORD_DIM], -9)[cells].max(axis=1))
    adam = Adam({k: v for k, v in net.p.items() if k not in learned}, 0.02)
    for step in range(TRAIN_STEPS):
        if step % 100 == 0 and step:
            score = window_scores(lambda x, cells: net_scores(net, cells, net.projected(x), pad))
        if step % 100 == 0:
            order = np.lexsort((-score, owner))
            top = order[np.cumsum(per_text) - per_text]  # each text's highest window
            positive, hard = top[y[owner[top]] == 1], top[y[owner[top]] == 0]
            clean = np.flatnonzero(y[owner] == 0)
        adam.rate = 0.02 * (1 - step / TRAIN_STEPS) + 0.001
        few = TRAIN_BATCH // 4
        pick = np.concatenate([rng.choice(positive, 2 * few), rng.choice(hard, few), rng.choice(clean, few)])
        target = np.repeat([1.0, 0.0], [2 * few, 2 * few])
        shown = grid[pick].T
        live = (shown != pad).astype(np.float32)
        # a word is another input in each part of the sample
        own, at = np.unique(shown + (pad + 1) * part[owner[pick]], return_inverse=True)
        fold_of, number_of = own // (pad + 1), own % (pad + 1)
        x_own = np.zeros((len(own), WORD_DIM + CHAR_DIM), np.float32)
        real = np.flatnonzero(number_of < pad)
        for f in range(FOLDS):
            mine = real[fold_of[real] == f]
            w = number_of[mine]
            x_own[mine] = net.inputs(word[w], rows[concat_ranges(begins[w], counts[w])], counts[w], parts[f])
        grads, d_own = net.train_step(x_own, at.reshape(shown.shape), live, target)
        # The tables move by plain gradient steps, so a row that few windows show stays near its start.
        w, d_own = number_of[real], d_own[real]
        net.p["word"] -= TABLE_RATE * learned["word"] * summed(learned_row[w], d_own[:, 1:WORD_DIM], WORD_ROWS)
        spread = np.repeat(d_own[:, WORD_DIM + 1 :] / np.maximum(1, counts[w])[:, None], counts[w], axis=0)
        net.p["char"] -= TABLE_RATE * learned["char"] * summed(rows[concat_ranges(begins[w], counts[w])], spread, CHAR_ROWS)
        adam.step(grads)
    score = window_scores(lambda x, cells: net_scores(net, cells, net.projected(x), pad))
    highest = np.maximum.reduceat(score, np.cumsum(per_text) - per_text)
    net.calibrated = logistic(np.clip(highest, -12, 12)[:, None], y, weights, ridge=1e-3)
    return net


def table_row(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(WORD_ROWS)).astype(np.int64)


def log_odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for rows that seen[label] texts hold, beside those of all texts, SHRINK texts of which count for each row."""
    share = (texts[1] + 0.5) / (texts.sum() + 1)
    return (np.log((seen[1] + SHRINK * share) / (seen[0] + SHRINK * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)


def net_scores(net: Network, grid: np.ndarray, gates: np.ndarray, pad: int, most: int = 2048) -> np.ndarray:
    """Logit of each window; grid holds rows of gates, pad where no word stands."""
    gates = np.concatenate([gates[:, :pad], np.zeros((2, 1, gates.shape[2]), np.float32)], axis=1)
    out = [np.zeros(0, np.float32)]
    for at in range(0, len(grid), most):
        part = np.ascontiguousarray(grid[at : at + most].T)
        out.append(net.forward(gates, part, (part != pad).astype(np.float32)))
    return np.concatenate(out)


class Scorer:
    """Fitted networks with a bounded memory of words."""

    def __init__(self, net: Network):
        self.net, self.nets = net, [net, *net.others]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = [np.zeros((2, 0, 3 * HIDDEN), np.float32) for _ in self.nets]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        if len(self.known) > REMEMBERED:
            self.forget()
        known, ids, size = self.known, [], len(self.known)
        for text in texts:
            found = words(text)
            own = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
            for k in np.flatnonzero(own < 0).tolist():
                own[k] = known.setdefault(found[k], len(known))
            ids.append(own)
        if len(known) > size:
            new = word_features(list(known)[size:])
            self.gates = [np.concatenate([g, net.projected(net.inputs(*new))], axis=1) for g, net in zip(self.gates, self.nets)]
        grid, counts = windows_of(ids, len(known))
        empty = np.array([len(x) == 0 for x in ids])
        total = np.zeros(len(texts))
        for net, gates in zip(self.nets, self.gates):
            highest = np.maximum.reduceat(net_scores(net, grid, gates, len(known)), np.cumsum(counts) - counts)
            a, b = net.calibrated
            total += np.where(empty, -12 * abs(a) + b, a * np.clip(highest, -12, 12) + b)
        return sigmoid(total / len(self.nets))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network fitted on at most ``rows`` labelled texts outside the held-out fold (see ``labelled_sample`` for the bounds)."""
    return train(*labelled_sample(docs, labels, label, fold(id_col, 4) != 2, rows, most_bytes, id_col=id_col, text_col=text_col))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of each row, and the columns to carry, as _column. A text that is carried is not sent a second time."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded: fixed tables, and two numbers for each word of the sample
    read = f"_{text_col}" if text_col in carry and docs.schema[text_col].dataType == StringType() else "text"
    own = [] if read != "text" else [as_bytes(text_col).alias("text")]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), *own, *[F.col(f"`{c}`").alias(f"_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in steps(batches, read, most=1 << 20):
            got = scorer.scores([t or b"" for t in batch.column(read).cast(pa.binary()).to_pylist()])
            rest = [k for k, n in enumerate(batch.schema.names) if n not in ("id", "text")]
            yield pa.record_batch(
                [batch.column("id"), pa.array(got, pa.float64()), *[batch.column(k) for k in rest]],
                names=["id", "score", *[batch.schema.names[k] for k in rest]],
            )

    fields = ["id long", "score double", *[f"`_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]]
    return plain.mapInArrow(run, ", ".join(fields))
