"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are lower-cased (A-Z) and reduced to words separated by one
space. Every window of ``width`` consecutive item words (an item of fewer words, but not
none, is one window) becomes a byte pattern with a space on either side. Patterns are
grouped by length, so that a few short ones do not shorten the jumps of the rest. For a
group with shortest pattern ``m``, a shift table holds for each hashed block of bytes how
far the search may jump; a block that ends some pattern's first ``m`` bytes has shift 0
and leads to the bucket of patterns with that block, which are compared byte by byte.

Inside a task the search runs over many stretches of text at once: each stretch has a
cursor, and all cursors jump in step. Documents are only mapped over, nothing is
shuffled. The patterns are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of
benchmark text; a larger benchmark takes further passes, with the result so far written
to the shared folder between them.

Results: ``n_words``, ``hits`` (runs of hit words, start and stop), ``items`` (ids as
strings, sorted, of items with an occurring window). Null and empty texts have no words
and no hits; a null item id counts as the empty string; repeated items count once by id.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from worklens.llm.batches import LOWER, Words, append, byte_table
from worklens.llm.staging import staged

#: Benchmark text in one pass; bounds what is sent to each task. Its tables take about 120 bytes
#: for each byte of text (measured: 480 MB for 4 MB), in the driver and in every worker.
BLOCK_BYTES = 2 << 20
#: Words of a window.
WIDTH = 10
#: Longest hashed block, in bytes, and bits of its hash.
BLOCK, BITS = 8, 20
#: Bytes of text per cursor.
STRETCH = 512
#: Separators: 00-2F, 3A-60 and 7B-7F of the lower-cased text.
CLASSES = byte_table(lambda b: int(not (b <= 0x2F or 0x3A <= LOWER[b] <= 0x60 or 0x7B <= b <= 0x7F)))

HITS = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
FIELDS = [StructField("n_words", LongType()), StructField("hits", HITS), StructField("items", ArrayType(StringType()))]


def squeezed(words: Words) -> np.ndarray:
    """All words, each followed by one space, after a leading space."""
    keep = np.zeros(len(words.data), bool)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    np.cumsum(inside[:-1], out=inside[:-1])
    keep[:] = inside[:-1] > 0
    out = np.where(keep, words.data, np.uint8(32))
    keep[words.ends] = True
    return np.concatenate([np.full(1, 32, np.uint8), out[keep]])


def windows(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The patterns of one item."""
    words = Words([(text or "").encode()], CLASSES, LOWER)
    tokens = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    stops = range(min(width, len(tokens)), len(tokens) + 1) if tokens else ()
    return {b" " + b" ".join(tokens[max(0, e - width) : e]) + b" " for e in stops}


def _hash(block: np.ndarray) -> np.ndarray:
    return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


@dataclass
class Group:
    """Tables of the patterns whose lengths lie near each other."""

    patterns: list[bytes]
    shortest: int
    block: int
    shift: np.ndarray
    order: np.ndarray
    bucket: np.ndarray
    prefix: np.ndarray

    @classmethod
    def build(cls, patterns: list[bytes]) -> Group:
        m = min(map(len, patterns))
        size = min(BLOCK, m)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        shift = np.full(1 << BITS, m - size + 1, np.int32)
        for end in range(size, m + 1):
            np.minimum.at(shift, cls.hashed(heads[:, end - size : end]), np.int32(m - end))
        last = cls.hashed(heads[:, m - size :])
        order = np.argsort(last, kind="stable")
        bucket = np.searchsorted(last[order], np.arange((1 << BITS) + 1, dtype=np.uint64))
        return cls(patterns, m, size, shift, order, bucket, cls.hashed(heads[:, :size]))

    @staticmethod
    def hashed(bytes_: np.ndarray) -> np.ndarray:
        value = np.zeros(len(bytes_), np.uint64)
        for k in range(bytes_.shape[1]):
            value |= bytes_[:, k].astype(np.uint64) << np.uint64(8 * k)
        return _hash(value)

    def search(self, text: np.ndarray, loads: np.ndarray) -> tuple[list[int], list[int]]:
        """Start positions and pattern numbers of all occurrences in ``text``.

        ``loads[i]`` has the eight bytes from ``i`` on.
        """
        size, m = len(text), self.shortest
        mask = np.uint64((1 << (8 * self.block)) - 1)
        begin = np.arange(0, max(0, size - m + 1), STRETCH)
        limit = np.minimum(begin + STRETCH, size - m + 1) + m - 1
        at, found = begin + m - 1, []
        while len(at):
            key = _hash(loads[at - (self.block - 1)] & mask)
            jump = self.shift[key].astype(np.int64)
            found.append((at[jump == 0] - (m - 1), key[jump == 0]))
            at = at + np.maximum(jump, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        if not found:
            return [], []
        starts, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        sizes = self.bucket[keys + np.uint64(1)] - self.bucket[keys]
        first = np.repeat(self.bucket[keys] - np.cumsum(sizes) + sizes, sizes)
        number = self.order[first + np.arange(len(first))]
        starts = np.repeat(starts, sizes)
        same = _hash(loads[starts] & mask) == self.prefix[number]
        starts, number = starts[same], number[same]
        whole = text.tobytes()
        pairs = [(s, n) for s, n in zip(starts.tolist(), number.tolist(), strict=True) if whole.startswith(self.patterns[n], s)]
        return [s for s, _ in pairs], [n for _, n in pairs]


class Searcher:
    """Search tables for one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH) -> None:
        owners: dict[bytes, set[str]] = defaultdict(set)
        for name, text in items:
            for pattern in windows(text, width):
                owners[pattern].add(name)
        sized: dict[int, list[bytes]] = defaultdict(list)
        for pattern in sorted(owners):
            sized[len(pattern).bit_length()].append(pattern)
        self.groups = [Group.build(patterns) for patterns in sized.values()]
        self.owners = {p: sorted(o) for p, o in owners.items()}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words, runs of hit words and item ids of each text."""
        words = Words(texts, CLASSES, LOWER)
        counts, n = words.counts(), len(words.starts)
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not n:
            return counts, runs, items
        text = squeezed(words)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(text),), "<u8", padded.tobytes(), strides=(1,))
        lengths = words.ends - words.starts + 1
        begins = np.cumsum(lengths) - lengths  # of the space before each word
        edge = np.zeros(n + 1, np.int64)
        for group in self.groups:
            starts, numbers = group.search(text, loads)
            if not starts:
                continue
            word = np.searchsorted(begins, starts)
            width = np.array([group.patterns[k].count(b" ") - 1 for k in numbers])
            doc = np.searchsorted(words.first, word, "right") - 1
            inside = word + width <= words.first[doc + 1]
            np.add.at(edge, word[inside], 1)
            np.add.at(edge, (word + width)[inside], -1)
            for d, k in set(zip(doc[inside].tolist(), np.array(numbers)[inside].tolist(), strict=True)):
                items[d].update(self.owners[group.patterns[k]])
        hit = np.cumsum(edge[:-1]) > 0
        for d in {int(x) for x in np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1}:
            a, b = words.first[d], words.first[d + 1]
            flag = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
            runs[d] = list(zip(np.flatnonzero(flag == 1).tolist(), np.flatnonzero(flag == -1).tolist(), strict=True))
        return counts, runs, items


#: Runs that are set aside together, so that joining does not copy all of them at each step.
RUN = 256


def _joined(spans: Column) -> Column:
    """Runs that overlap or touch, as one."""
    kind, lists = HITS.simpleString(), f"array<{HITS.simpleString()}>"
    none = F.array().cast(kind)
    one = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    state = lambda done, open_, last: F.struct(done.alias("done"), open_.alias("open"), last.alias("last"))

    def step(s: Column, x: Column) -> Column:
        last = s["last"]
        closed = F.when(last.isNull(), s["open"]).otherwise(F.concat(s["open"], F.array(last)))
        apart = F.when(F.size(closed) < RUN, state(s["done"], closed, x)).otherwise(state(F.concat(s["done"], F.array(closed)), none, x))
        grown = state(s["done"], s["open"], one(last["start"], F.greatest(last["stop"], x["stop"])))
        return F.when(last.isNull() | (x["start"] > last["stop"]), apart).otherwise(grown)

    start = state(F.array().cast(lists), none, F.lit(None).cast(HITS.elementType))
    end = lambda s: F.flatten(F.concat(s["done"], F.array(s["open"]), F.when(s["last"].isNull(), F.array().cast(lists)).otherwise(F.array(F.array(s["last"])))))
    return F.aggregate(F.array_sort(spans), start, step, end)


def contaminated_words(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` (columns ``keep``, or all) with ``n_words``, ``hits`` and ``items``."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = documents.columns if keep is None else keep
    out = None
    for block in range(blocks):
        # Bounded: about block_bytes of benchmark text.
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        searcher = documents.sparkSession.sparkContext.broadcast(Searcher([(r[0], r[1]) for r in rows], width))
        if out is None:
            out = append(documents, _first(searcher), FIELDS, keep=[*names, "text"] if blocks > 1 else names)
        else:
            out = _merged(staged(out, "contaminated"), searcher, width)
    return out.select(*[out[f"`{n}`"] for n in out.columns if n in names or n in {f.name for f in FIELDS}])


def _arrays(counts, runs, items) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    spans = pa.array([[{"start": a, "stop": b} for a, b in r] for r in runs], kind)
    return [pa.array(counts, pa.int64()), spans, pa.array([sorted(i) for i in items], pa.list_(pa.string()))]


def _first(searcher):
    return lambda texts: _arrays(*searcher.value(texts))


def _merged(frame: DataFrame, searcher, width: int) -> DataFrame:
    """One more block of items over rows that have the hits of earlier blocks."""
    old = frame.withColumnsRenamed({"hits": "earlier_hits", "items": "earlier_items"})
    more = append(old, _first(searcher), FIELDS)
    return more.withColumns({"hits": _joined(F.concat("earlier_hits", "hits")), "items": F.array_sort(F.array_union("earlier_items", "items"))}).drop("earlier_hits", "earlier_items")


def digest(found: DataFrame) -> DataFrame:
    """The contracted columns of the registered query."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
