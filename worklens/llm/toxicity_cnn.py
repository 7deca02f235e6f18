"""Toxicity: a convolutional network over hashed word embeddings.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Each has a row in
the table of whole words and in the tables of its first ``PREFIXES`` bytes, so that rare
forms of a known stem are understood, and two words share all rows only by a rare chance.
Filters of several widths slide over the text; the maximum of
each filter over the whole text goes to a logistic output. Training in numpy on at most
``SAMPLE`` labelled documents outside the held-out part; the gradient flows through the
maxima only, so an update touches few embedding rows.

Thresholds are calibrated by language. The language is guessed from function words in
the text itself, never from a column; the cut of a language is the logit that leaves the
fewest errors among its documents set apart, and the general cut where a language has
fewer than ``ENOUGH`` of either label there. The score is the calibrated probability
shifted so that 0.5 is the cut. Texts without words, null included, are scored as padding.
A text of more than a slice is scored in parts, with maxima and votes carried over them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from worklens.llm.batches import LOWER, SLICE_BYTES, Words, append, byte_table, hashes_by_part, per_text
from worklens.llm.training import Adam, best_cut, is_held_out, labelled_sample, sigmoid, temperature

#: Rows of an embedding table, length of a row, bytes of prefixes, filters per width, widths.
ROWS, LENGTH, PREFIXES, FILTERS, WIDTHS = 1 << 17, 8, (4, 6), 8, (1, 2, 3)
TABLES = 1 + len(PREFIXES)
#: Labelled documents used, passes, share set apart, documents of either label for a language's own cut.
SAMPLE, EPOCHS, APART, ENOUGH = 12000, 4, 0.25, 20
#: Documents held out: crc32 of the id modulo 5 is 0.
MODULUS, HELD_OUT = 5, 0

#: Function words by which the language of a text is guessed.
LANGUAGES = {
    "en": "the of and to in is that it for was on are with as be this have from at by",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les et des est dans que une du qui au pour pas sur par plus avec ce il sont",
    "es": "el los y del se las por con una su para al lo como más pero sus ya o este",
}

_CLASSES = byte_table(lambda b: int(b >= 0x80 or chr(b).isalnum()))
PAD = max(WIDTHS) - 1


def _word_hash(word: str) -> int:
    return int(Words([word.encode()], _CLASSES, LOWER).hashes()[0][0])


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the tables of all words, each text followed by padding (row 0); bounds and language of each text."""
    words = Words(texts, _CLASSES, LOWER)
    hashes, counts = words.hashes(*PREFIXES), words.counts()
    size = counts + PAD
    first = np.append(0, np.cumsum(size))
    place = np.arange(len(hashes[0])) + PAD * np.repeat(np.arange(len(texts)), counts)
    rows = np.zeros((TABLES, int(first[-1])), np.int32)
    rows[:, place] = _table_rows(hashes)
    return rows, first, _votes(hashes[0], words.first).argmax(axis=0)


def _table_rows(hashes: list[np.ndarray]) -> np.ndarray:
    return (np.stack(hashes) % np.uint64(ROWS - 1) + np.uint64(1)).astype(np.int32)


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Function words of each language in each text; the language with most is taken, the first one without any."""
    known = [np.array([_word_hash(w) for w in line.split()], np.uint64) for line in LANGUAGES.values()]
    maybe = np.zeros(1 << 16, bool)
    for group in known:
        maybe[group & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(maybe[hashes & np.uint64(0xFFFF)])
    doc = np.searchsorted(first, at, "right") - 1
    return np.array([np.bincount(doc[np.isin(hashes[at], group)], minlength=len(first) - 1) for group in known])


class Network:
    def __init__(self, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, size: (rng.standard_normal(shape) * size).astype(np.float32)
        self.tables = draw(TABLES, ROWS, LENGTH, size=0.1)
        self.tables[:, 0] = 0
        self.moved = np.full((TABLES, ROWS), 1e-8, np.float32)
        self.values = {f"w{w}": draw(w, TABLES * LENGTH, FILTERS, size=0.4 / np.sqrt(w)) for w in WIDTHS}
        self.values |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.values |= {"out": draw(FILTERS * len(WIDTHS), size=0.3), "bias": np.zeros(1, np.float32)}
        self.divisor, self.cuts = 1.0, np.zeros(len(LANGUAGES))

    def pooled(self, rows: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Filter maxima per text, before the rectifier, and the places of the maxima if asked for."""
        seen = np.concatenate([table[r] for table, r in zip(self.tables, rows, strict=True)], axis=1)
        parts, places = [], {}
        for w in WIDTHS:
            value = seen @ self.values[f"w{w}"][0]
            for k in range(1, w):
                value[:-k] += seen[k:] @ self.values[f"w{w}"][k]
            value += self.values[f"b{w}"]
            # A text ends with PAD rows of padding, or goes on in the next part; the last rows start no window that would reach beyond.
            for k in range(1, max(w, 2)):
                value[first[1:] - k] = -np.inf
            parts.append(per_text(value, first, np.maximum.reduce))
            if where:
                places[w] = first[:-1, None] + per_text(value, first, np.argmax)
        return np.concatenate(parts, axis=1), places, seen

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, first)[0], 0) @ self.values["out"] + self.values["bias"]

    def step(self, adam: Adam, rate: float, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        top, places, seen = self.pooled(rows, first, where=True)
        active = np.maximum(top, 0)
        error = ((sigmoid(active @ self.values["out"] + self.values["bias"]) - labels) * weight / len(labels)).astype(np.float32)
        down = error[:, None] * self.values["out"] * (top > 0)
        gradient = {"out": active.T @ error, "bias": error.sum(keepdims=True)}
        for i, w in enumerate(WIDTHS):
            d = down[:, i * FILTERS : (i + 1) * FILTERS]
            kernel = self.values[f"w{w}"]
            grad = np.zeros_like(kernel)
            for k in range(w):
                at = np.minimum(places[w] + k, len(seen) - 1)
                grad[k] = np.einsum("df,dfe->ef", d, seen[at])
                back = np.einsum("df,ef->dfe", d, kernel[k]).reshape(-1, TABLES * LENGTH)
                for t in range(TABLES):
                    target, part = rows[t][at].ravel(), back[:, t * LENGTH : (t + 1) * LENGTH]
                    np.add.at(self.moved[t], target, (part**2).mean(axis=1))
                    np.add.at(self.tables[t], target, -rate * part / np.sqrt(self.moved[t][target])[:, None])
            gradient |= {f"w{w}": grad, f"b{w}": d.sum(axis=0)}
        self.tables[:, 0] = 0
        adam.update(gradient)

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 6) -> Network:
        if not len(labels) or labels.min() == labels.max():
            self.values["out"][:] = 0
            self.values["bias"][:] = 0 if not len(labels) else 4 * labels[0] - 2
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        apart = int(len(order) * APART)
        train, weight = order[apart:], np.where(labels > 0, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        adam = Adam(self.values, 0.01)
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for at in range(0, len(train), 32):
                pick = train[at : at + 32]
                rows, first, _ = encoded([texts[i] for i in pick])
                self.step(adam, 0.05, rows, first, labels[pick].astype(np.float32), weight[pick])
        out, language = self._outputs([texts[i] for i in order[:apart]])
        truth = labels[order[:apart]]
        self.divisor = temperature(out, truth)
        self.cuts[:] = best_cut(out, truth)
        for k in range(len(LANGUAGES)):
            own = language == k
            if min((truth[own] > 0).sum(), (truth[own] <= 0).sum()) >= ENOUGH:
                self.cuts[k] = best_cut(out[own], truth[own])
        return self

    def _outputs(self, texts: list[bytes], block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        out, language = [np.zeros(0)], [np.zeros(0, int)]
        for at in range(0, len(texts), block):
            some = texts[at : at + block]
            rows, first, guess = encoded([t if len(t) <= SLICE_BYTES else b"" for t in some])
            logits = self.logits(rows, first)
            for i, text in enumerate(some):
                if len(text) > SLICE_BYTES:
                    logits[i], guess[i] = self._output_by_part(text)
            out.append(logits)
            language.append(guess)
        return np.concatenate(out), np.concatenate(language)

    def _output_by_part(self, text: bytes) -> tuple[float, int]:
        """Logit and language of one very long text: maxima and votes are carried over its parts."""
        top, votes = np.full((1, FILTERS * len(WIDTHS)), -np.inf, np.float32), np.zeros(len(LANGUAGES), int)
        last = np.zeros((TABLES, 0), np.int32)
        for hashes in hashes_by_part(text, _CLASSES, LOWER, *PREFIXES):
            if not len(hashes[0]):
                continue
            rows = np.concatenate([last, _table_rows(hashes)], axis=1)
            if rows.shape[1] > PAD:
                top = np.maximum(top, self.pooled(rows, np.array([0, rows.shape[1]]))[0])
            votes += _votes(hashes[0], np.array([0, len(hashes[0])]))[:, 0]
            last = rows[:, -PAD:]
        rows = np.concatenate([last, np.zeros((TABLES, PAD), np.int32)], axis=1)
        top = np.maximum(top, self.pooled(rows, np.array([0, rows.shape[1]]))[0])
        return float((np.maximum(top, 0) @ self.values["out"] + self.values["bias"])[0]), int(votes.argmax())

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, language = self._outputs(texts)
        return sigmoid((out - self.cuts[language]) / self.divisor)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    rows = labelled_sample(documents, labels, "toxic", MODULUS, HELD_OUT, sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))
    return Network().fit([(r["text"] or "").encode() for r in rows], np.array([r["label"] for r in rows]))


def scored(documents: DataFrame, network: Network, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``score``, high for toxic texts."""
    shared = documents.sparkSession.sparkContext.broadcast(network)
    return append(documents, lambda texts: [pa.array(shared.value.scores(texts), pa.float64())], [StructField("score", DoubleType())], keep=keep)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contracted columns of the registered query."""
    found = scored(documents, fit(documents, labels), keep=["doc_id"])
    return found.select("doc_id", is_held_out(MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
