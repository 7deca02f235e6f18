"""Arrow batches of texts: bounded slices, appended columns, words as flat byte arrays.

Helpers for operators that work inside tasks. A batch is cut into slices of a few
megabytes of text, so that the arrays derived from it stay small whatever the batch
size; only one very long text can make a slice larger. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 21


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each (or one row)."""
    if not batch.num_rows:
        return
    column = pc.fill_null(batch.column(text).cast(pa.binary()), b"")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at), column.slice(at, stop - at).to_pylist()
        at = stop


def append(
    frame: DataFrame,
    compute: Callable[[list[bytes]], list[pa.Array]],
    fields: list[StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns plus what ``compute`` makes of the texts, row by row.

    A kept column that has the name of a new one gives way to it.
    """
    new = {f.name for f in fields}
    kept = [f for f in frame.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                columns = [part.column(n) for n in names] + compute(texts)
                yield pa.RecordBatch.from_arrays(columns, names + [f.name for f in fields])

    columns = list(dict.fromkeys([*names, text]))
    return frame.select([frame[f"`{c}`"] for c in columns]).mapInArrow(run, StructType(kept + fields))


class Words:
    """Words of some texts over one joined byte array.

    ``classes`` maps a byte to 0 (separator) or a class above 0; a word is a maximal run
    of one class. The line feed has to be a separator: it stands around every text.
    ``fold`` maps bytes before use, for lower case. Attributes: ``data`` (folded bytes),
    ``starts`` and ``ends`` of words, ``first`` (index of the first word of each text,
    and the number of words as last entry).
    """

    def __init__(self, texts: list[bytes], classes: np.ndarray, fold: np.ndarray | None = None) -> None:
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        kind = classes[raw]
        change = kind[1:] != kind[:-1]
        self.starts = np.flatnonzero(change & (kind[1:] > 0)) + 1
        self.ends = np.flatnonzero(change & (kind[:-1] > 0)) + 1
        self.data = raw if fold is None else fold[raw]
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
        self.first = np.searchsorted(self.starts, edges + 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """64-bit polynomial hashes of each word, and of its first bytes for each of ``prefixes``, mixed."""
        n = len(self.data)
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        base, scale = sums[self.starts], down[self.starts]
        ends = [self.ends, *(np.minimum(self.ends, self.starts + k) for k in prefixes)]
        return [mix((sums[end] - base) * scale) for end in ends]


def hashes_by_part(text: bytes, classes: np.ndarray, fold: np.ndarray | None = None, *prefixes: int, limit: int = SLICE_BYTES) -> Iterator[list[np.ndarray]]:
    """``Words.hashes`` of one text in several parts, in order, so that memory does not grow with the text.

    A part ends where the class of bytes changes, so no word is cut; a word of more than
    ``limit`` bytes is a part of its own, and its hash is added up.
    """
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        kind = classes[data[at : at + limit + 1]]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        if len(kind) <= limit or len(change):
            stop = len(data) if len(kind) <= limit else at + int(change[-1]) + 1
            yield Words([text[at:stop]], classes, fold).hashes(*prefixes)
        else:
            stop = at + limit
            while stop < len(data):
                other = np.flatnonzero(classes[data[stop : stop + limit]] != kind[0])
                stop = stop + int(other[0]) if len(other) else min(len(data), stop + limit)
                if len(other):
                    break
            if kind[0]:
                yield [_word_hash(data[at : min(stop, at + k)], fold, limit) for k in (stop - at, *prefixes)]
        at = stop


def _word_hash(word: np.ndarray, fold: np.ndarray | None, limit: int) -> np.ndarray:
    """The hash of one word, as ``Words.hashes`` gives it."""
    total = np.zeros(1, np.uint64)
    for at in range(0, len(word), limit):
        part = word[at : at + limit] if fold is None else fold[word[at : at + limit]]
        here = ((part.astype(np.uint64) + np.uint64(1)) * powers(limit)[0][: len(part)]).sum(dtype=np.uint64)
        total += here * np.array([pow(_BASE, at, 1 << 64)], np.uint64)
    return mix(total)


def per_text(rows: np.ndarray, first: np.ndarray, reduce) -> np.ndarray:
    """``reduce`` over the rows of each text, one row per text; ``first`` as in Words, no text empty."""
    return np.stack([reduce(rows[a:b], axis=0) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept between calls."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def byte_table(word: Callable[[int], int]) -> np.ndarray:
    return np.array([word(b) for b in range(256)], np.uint8)


#: A-Z to a-z, all other bytes as they are.
LOWER = byte_table(lambda b: b + 32 if 65 <= b <= 90 else b)
