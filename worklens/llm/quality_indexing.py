"""Document quality: random-indexing word vectors, pooled per text, and a two-layer network.

Tokens are maximal runs of word bytes or of signs, case kept, so that "the%%%" gives
"the" and "%%%". Every token has a sparse ternary index vector, drawn from its hash. The
context vector of a hashed token (``BUCKETS``) is the sum of the index vectors of its
neighbours up to ``REACH`` tokens away, over all occurrences in all documents. Each task
sums its documents into one matrix of fixed size; the matrices are added up per slab of
rows, and the sum, whose size does not depend on the corpus, goes to every task.

A text is pooled to the mean and the standard deviation of the vectors of its tokens, the
mean product of each with the next, and the logarithm of their number. The network
is trained in numpy on at most ``SAMPLE`` labelled documents outside the held-out part;
a share of them is set apart for the temperature, which calibrates the probability. A text
without tokens, null included, has a zero vector and gets the score that follows from it.
A text of more than a slice is read in parts, with sums carried over them. Without labels of both kinds every score is the share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField

from worklens.llm.batches import SLICE_BYTES, Words, append, byte_table, hashes_by_part, mix, per_text, slices
from worklens.llm.training import Adam, is_held_out, labelled_sample, logit, sigmoid, temperature

#: Hashed tokens, vector length, nonzero entries of an index vector, neighbours on either side.
BUCKETS, LENGTH, NONZERO, REACH = 1 << 14, 48, 4, 2
#: Rows of a slab when matrices are added up.
SLAB = 256
#: Labelled documents used, hidden units, passes, share set apart.
SAMPLE, HIDDEN, EPOCHS, APART = 8000, 48, 40, 0.2
#: Documents held out: crc32 of the id modulo 3 is 1.
MODULUS, HELD_OUT = 3, 1

_FLOATS = ArrayType(FloatType())
_CLASSES = byte_table(lambda b: 0 if b <= 0x20 else 1 if b >= 0x80 or chr(b).isalnum() else 2)


def _tokens(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    words = Words(texts, _CLASSES)
    return words, words.hashes()[0]


def _index_entries(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and signs of the nonzero entries of each token's index vector."""
    out = []
    for k in range(NONZERO):
        drawn = mix(hashes + np.uint64(k + 1))
        out.append(((drawn >> np.uint64(8)) % np.uint64(LENGTH), np.where(drawn & np.uint64(1), 1.0, -1.0)))
    return out


def context_sums(texts: list[bytes]) -> np.ndarray:
    """Summed index vectors of the neighbours of each bucket's occurrences."""
    flat = np.zeros(BUCKETS * LENGTH)
    words, hashes = _tokens([t if len(t) <= SLICE_BYTES else b"" for t in texts])
    _add_context(flat, hashes, np.repeat(np.arange(len(texts)), words.counts()))
    for text in texts:
        if len(text) > SLICE_BYTES:
            last = np.zeros(0, np.uint64)
            for (part,) in hashes_by_part(text, _CLASSES):
                both = np.concatenate([last, part])
                _add_context(flat, both, np.zeros(len(both), int), len(last))
                last = both[-REACH:]
    return flat.reshape(BUCKETS, LENGTH)


def _add_context(flat: np.ndarray, hashes: np.ndarray, doc: np.ndarray, seen: int = 0) -> None:
    """Add the neighbours within ``doc``; pairs among the first ``seen`` tokens are counted already."""
    row = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64) * LENGTH
    entries = [(p.astype(np.int64), s) for p, s in _index_entries(hashes)]
    for apart in range(1, REACH + 1):
        same = np.flatnonzero(doc[apart:] == doc[:-apart])
        same = same[same + apart >= seen]
        for here, there in ((same, same + apart), (same + apart, same)):
            for position, sign in entries:
                flat += np.bincount(row[here] + position[there], sign[there], len(flat))


def context_vectors(documents: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from all documents, without their common part."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, LENGTH))
        for batch in batches:
            for _, texts in slices(batch, "text"):
                total += context_sums(texts)
        slabs = [s for s in range(0, BUCKETS, SLAB) if total[s : s + SLAB].any()]
        data = [total[s : s + SLAB].astype(np.float32).tobytes() for s in slabs]
        yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int64()), pa.array(data, pa.binary())], ["slab", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.float32).astype(np.float64)
                totals[slab] = totals[slab] + part if slab in totals else part
        data = [v.tobytes() for v in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(data, pa.binary())], ["slab", "sums"])

    slabs = documents.select("text").mapInArrow(summed, "slab long, sums binary").repartition("slab").mapInArrow(added, "slab long, sums binary")
    vectors = np.zeros((BUCKETS, LENGTH))
    for slab, data in slabs.collect():  # BUCKETS / SLAB rows at most
        vectors[slab : slab + SLAB] = np.frombuffer(bytes(data), np.float64).reshape(SLAB, LENGTH)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    common = unit[norms[:, 0] > 0].mean(axis=0) if norms.any() else np.zeros(LENGTH)
    return np.where(norms > 0, unit - common, 0).astype(np.float32)


#: Features of a text.
WIDTH = 3 * LENGTH + 1


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the token vectors of each text, mean product with the next one, log of their number."""
    words, hashes = _tokens([t if len(t) <= SLICE_BYTES else b"" for t in texts])
    counts = words.counts()
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            out[i] = _pooled_by_part(text, vectors)
    some = np.flatnonzero(counts)
    if len(some):
        rows = vectors[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        n = counts[some][:, None].astype(np.float32)
        first = np.append(words.first[some], len(rows))
        mean = per_text(rows, first, np.add.reduce) / n
        square = per_text(rows * rows, first, np.add.reduce) / n
        follow = rows.copy()
        follow[:-1] *= rows[1:]
        follow[first[1:] - 1] = 0
        out[some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), per_text(follow, first, np.add.reduce) / n, np.log1p(n)], axis=1)
    return out


def _pooled_by_part(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The features of one very long text, from sums that are carried over its parts."""
    n, sums, last = 0, np.zeros((3, LENGTH)), np.zeros((0, LENGTH), np.float32)
    for (part,) in hashes_by_part(text, _CLASSES):
        rows = vectors[(part & np.uint64(BUCKETS - 1)).astype(np.int64)]
        both = np.concatenate([last, rows])
        n += len(rows)
        sums += [rows.sum(axis=0, dtype=float), (rows * rows).sum(axis=0, dtype=float), (both[1:] * both[:-1]).sum(axis=0, dtype=float)]
        last = both[-1:]
    if not n:
        return np.zeros(WIDTH, np.float32)
    mean, square, follow = sums / n
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), follow, [np.log1p(n)]]).astype(np.float32)


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, width: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.values = {"w": rng.standard_normal((width, HIDDEN)) / np.sqrt(width), "b": np.zeros(HIDDEN), "v": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "c": np.zeros(1)}
        self.centre, self.spread, self.divisor, self.constant = np.zeros(width), np.ones(width), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.centre) / self.spread @ self.values["w"] + self.values["b"], 0)
        return z @ self.values["v"] + self.values["c"]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> Network:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        apart = int(len(y) * APART)
        train = order[apart:]
        self.centre, self.spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        adam = Adam(self.values, 0.003)
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for at in range(0, len(train), 64):
                pick = train[at : at + 64]
                z = (x[pick] - self.centre) / self.spread
                hidden = np.maximum(z @ self.values["w"] + self.values["b"], 0)
                error = (sigmoid(hidden @ self.values["v"] + self.values["c"]) - y[pick]) / len(pick)
                down = error[:, None] * self.values["v"] * (hidden > 0)
                adam.update({"w": z.T @ down, "b": down.sum(axis=0), "v": hidden.T @ error, "c": error.sum(keepdims=True)}, 1e-3)
        self.divisor = temperature(self.logits(x[order[:apart]]), y[order[:apart]])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return sigmoid(np.full(len(x), logit(self.constant)))
        return sigmoid(self.logits(x) / self.divisor)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Context vectors of the whole corpus and a network trained on its labelled sample."""
    vectors = context_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    compute = lambda texts: [pa.array(list(pooled(texts, shared.value)), pa.list_(pa.float32()))]
    rows = append(labelled_sample(documents, labels, "quality", MODULUS, HELD_OUT, sample), compute, [StructField("x", _FLOATS)], keep=["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), WIDTH)
    return vectors, Network(WIDTH).fit(x, np.array([r["label"] for r in rows], float))


def scored(documents: DataFrame, model: tuple[np.ndarray, Network], keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``score``, the probability of good quality."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> list[pa.Array]:
        vectors, network = shared.value
        return [pa.array(network.probability(pooled(texts, vectors).astype(float)), pa.float64())]

    return append(documents, compute, [StructField("score", DoubleType())], keep=keep)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contracted columns of the registered query."""
    found = scored(documents, fit(documents, labels), keep=["doc_id"])
    return found.select("doc_id", is_held_out(MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
