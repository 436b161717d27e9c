"""What the two text classifiers share: the bounded labelled sample, folds, Adam, and the last calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.shared import as_bytes

#: Bytes of all texts of a labelled sample.
SAMPLE_TOTAL = 32 << 20
#: Labelled ids of a class that are looked up, for each row of the sample.
AHEAD = 2


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; an id that is null falls in no fold."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % parts


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    rows: int,
    most_bytes: int,
    total_bytes: int = SAMPLE_TOTAL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels (0 or 1) and weights that the model is fitted on.

    Bounds: at most ``rows`` documents, half of each class, and at most ``total_bytes`` bytes, half of each class, out of
    the first AHEAD * rows labelled ids of each class in the order of a hash of the id. Texts of at most ``most_bytes``
    bytes come first, then longer ones fill what is left, both in that order. The weights restore the share of each class among all labelled rows that may be learned from.
    """
    marked = (
        labels.where(learn)
        .where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r.y: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    first = [marked.where(F.col("y") == value).orderBy(*by_hash).limit(AHEAD * rows) for value in (0, 1)]
    # ids and lengths alone meet the labels; of rows that share an id the shortest text speaks for it
    ids = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * AHEAD * rows
    sized = texts.select("id", F.octet_length("text").alias("size")).join(ids, "id").groupBy("id").agg(F.min("size").alias("size"), F.max("y").alias("y"))
    order = [(F.col("size") > most_bytes).alias("long"), *by_hash]
    found, y = [], []
    for value in (0, 1):
        chosen = sized.where(F.col("y") == value).orderBy(*order).limit(rows // 2).select("id", "size").collect()
        reach = np.cumsum([r["size"] for r in chosen])
        wanted = {r.id: r["size"] for r in chosen[: int(np.searchsorted(reach, total_bytes // 2, "right"))]}
        if not wanted:
            continue
        ids = docs.sparkSession.createDataFrame(list(wanted.items()), "id long, size int")  # at most rows // 2
        got = texts.join(F.broadcast(ids), "id").where(F.octet_length("text") == F.col("size")).groupBy("id").agg(F.min("text").alias("text")).collect()
        place = {i: k for k, i in enumerate(wanted)}
        found += [bytes(r.text) for r in sorted(got, key=lambda r: place[r.id])]
        y += [value] * len(got)
    y = np.array(y, np.int64)
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(counts.values()))
    weights = np.array([counts.get(k, 0) / total / have[k] for k in y.tolist()], np.float64)
    return found, y, weights * max(1, len(y))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(features: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the last one for the constant) of a weighted logistic regression, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = ridge * np.ones(x.shape[1])
    keep[-1] = 1e-6
    total = weights.sum()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weights * (p - y)) / total + keep * w
        bend = (x * (weights * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x / total + np.diag(keep)
        move = np.linalg.solve(bend, grad)
        w -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w
