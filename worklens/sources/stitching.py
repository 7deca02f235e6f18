"""Joining log lines into entries inside a task, with Arrow kernels.

These functions run in Python workers. They are pickled by value, so workers do not need
the package on their path.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

PIECE = "file string, block long, line long, kind string, text string"


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(file, block, line, value, start)`` to pieces of three kinds.

    ``head``: lines before the first entry of a file split; ``entry``: an entry that ends
    inside the split; ``last``: the split's last entry, which may go on in the next split.
    The piece still open at the end of a batch is held as slices until it ends, and joined once.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and not _breaks(held[-1], batch).any():
            held.append(batch)
            continue
        lines = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        starts, kinds = _boundaries(lines)
        tail = int(starts[-1])
        if len(starts) > 1:
            yield _pieces(lines.slice(0, tail), starts[:-1], kinds[:-1])
        held = [lines.slice(tail)]
    if held:
        lines = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts, kinds = _boundaries(lines)
        yield _pieces(lines, starts, kinds)


def _breaks(last: pa.RecordBatch, batch: pa.RecordBatch) -> np.ndarray:
    """Which lines of a batch start an entry, or a split other than that of the line before."""
    begins = batch.column("start").to_numpy(zero_copy_only=False).astype(bool)
    return begins | _opens(pa.Table.from_batches([last.slice(last.num_rows - 1), batch]).combine_chunks().to_batches()[0])[1:]


def _opens(lines: pa.RecordBatch) -> np.ndarray:
    """Which lines are the first of their split, the first line always."""
    n = lines.num_rows
    file, block = lines.column("file"), lines.column("block").to_numpy()
    opens = np.ones(n, dtype=bool)
    if n > 1:
        moved = pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens[1:] = moved | (block[1:] != block[:-1])
    return opens


def quoted_stitcher(inside: list[tuple[str, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``stitch`` for lines ``(file, block, line, value, odd)`` of csv files.

    ``odd`` tells whether a line's quotes are odd in number, ``inside`` which splits start
    inside quotes. A line starts a record where an even number of quotes stands before it.
    """
    known = frozenset(inside)

    def with_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, quoted = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first = np.flatnonzero(_opens(batch))
            odd = batch.column("odd").to_numpy().astype(np.int64)
            start = np.empty(len(odd), dtype=bool)
            for a, b in zip(first, np.append(first[1:], len(odd)), strict=True):
                here = (batch.column("file")[a].as_py(), batch.column("block")[a].as_py())
                if here != split:
                    split, quoted = here, int(here in known)
                swaps = np.cumsum(odd[a:b])
                start[a:b] = (quoted + swaps - odd[a:b]) % 2 == 0
                quoted = (quoted + int(swaps[-1])) % 2
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("file", "block", "line", "value")), pa.array(start)], ["file", "block", "line", "value", "start"])

    return lambda batches: stitch(with_starts(batches))


def _boundaries(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows where pieces start, and the kind of each piece. The last piece counts as the
    last of its split."""
    opens = _opens(lines)
    begins = lines.column("start").to_numpy(zero_copy_only=False).astype(bool)
    starts = np.flatnonzero(begins | opens)
    closes = np.append(opens[starts][1:], True)
    kinds = np.where(begins[starts], np.where(closes, "last", "entry"), "head")
    return starts, kinds


def _pieces(lines: pa.RecordBatch, starts: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
    """One row per piece; piece i holds the lines from ``starts[i]`` to the next start."""
    offsets = pa.array(np.append(starts, lines.num_rows), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.column("value")), "\n")
    at = pa.array(starts)
    columns = [lines.column(c).take(at) for c in ("file", "block", "line")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(kinds.tolist(), pa.string()), text],
        names=["file", "block", "line", "kind", "text"],
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
