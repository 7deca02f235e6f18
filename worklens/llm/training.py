"""Small numpy training helpers: Adam, logistic loss, temperature, thresholds, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


class Adam:
    """Updates arrays of a dict in place."""

    def __init__(self, values: dict[str, np.ndarray], rate: float) -> None:
        self.values, self.rate, self.step = values, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in values.items()}
        self.square = {k: np.zeros_like(v) for k, v in values.items()}

    def update(self, gradients: dict[str, np.ndarray], decay: float = 0.0) -> None:
        self.step += 1
        size = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in gradients.items():
            value, mean, square = self.values[name], self.mean[name], self.square[name]
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            value -= size * mean / (np.sqrt(square) + 1e-8) + self.rate * decay * value


def temperature(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The divisor of the logits with the least logistic loss; each counts once, or as often as ``counts`` says."""
    if not len(logits) or labels.min() == labels.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
    sign = np.where(labels > 0, 1.0, -1.0)
    loss = [np.average(np.logaddexp(0, -sign * logits / t), weights=counts) for t in grid]
    return float(grid[int(np.argmin(loss))])


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two neighbours that leaves the fewest wrong, in the middle of the widest such gap."""
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(logits)
    y = labels[order] > 0
    return counted_cut(logits[order], y, ~y)


def counted_cut(x: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> float:
    """The same from ascending logits, with the number of either label at each."""
    wrong = np.concatenate([[0], np.cumsum(hits)]) + np.concatenate([np.cumsum(misses[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gaps = np.concatenate([[0], x[1:] - x[:-1], [0]])
    least = np.flatnonzero(wrong == wrong.min())
    return float(edges[least[np.argmax(gaps[least])]])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, size: int) -> DataFrame:
    """(text, label) of at most ``size`` labelled documents that are not held out, by hash order.

    A document is held out if crc32 of its id as text leaves ``held_out`` modulo ``modulus``.
    The ids are chosen on the narrow label table; the texts of the bounded choice follow. An id
    counts once, whatever the number of its rows: of several texts the least one is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~is_held_out(modulus, held_out))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # Combined before the shuffle, so a repeated id costs a task one text at a time.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def is_held_out(modulus: int, held_out: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held_out
