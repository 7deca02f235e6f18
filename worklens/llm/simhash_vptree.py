"""SimHash near-duplicates, found through a vantage-point tree over Hamming distance.

``fingerprints``: a text is lower-cased (A-Z) and split at white space; every run of
``shingle`` words (all words, if fewer) is hashed with XXH64, seed 42; a bit of the
fingerprint is set if more than half of the hashes have it. A text without words, null
included, has fingerprint 0.

``linked``: fingerprints within ``radius`` bits of each other.

- Equal fingerprints are one point, so copies never meet each other.
- The tree is built on the driver from a hash-ordered sample of at most ``SAMPLE`` points,
  with as many leaves as the number of points asks for. Each inner node has a vantage
  point and the median distance to it; of several candidates the one with the fewest
  points near the border is taken.
- Every point goes down to one leaf, its home. By the triangle inequality a point farther
  than ``radius`` from the border has no partner beyond it. A point within ``radius`` on
  the inner side is also sent to the outer side, as a guest, and a guest follows every
  branch that its ball overlaps. So each pair over a border meets exactly on the outer side.
- A leaf compares its points with itself and with its guests, pruned by distance to the
  leaf's pivot, in blocks. It returns a spanning set of links, never all pairs.

``components`` joins linked points to groups (worklens.llm.components). Rows without
``doc_id`` take part; the smallest doc_id ignores them, and a group of such rows only has
component null.

``one_of_each`` keeps one document of each group, as a stage of the corpus pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from worklens.llm.batches import LOWER, Words, append, byte_table
from worklens.llm.components import component_roots
from worklens.llm.staging import staged
from worklens.llm.wu_manber import squeezed

#: Largest sample for the tree, points wanted per leaf, sampled points per leaf at least.
SAMPLE, LEAF, PER_LEAF = 1 << 17, 4096, 16
#: Vantage points tried at a node.
TRIES = 8
#: Differing bits of a link, words of a shingle.
RADIUS, SHINGLE = 2, 3

NODE = StructField("node", BinaryType())
CLASSES = byte_table(lambda b: int(not (b == 0x20 or 0x09 <= b <= 0x0D)))


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, repeats included, and the number of each text's."""
    words = Words(texts, CLASSES, LOWER)
    counts = words.counts()
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    if not len(words.starts):
        return np.zeros(0, np.uint64), number
    text = squeezed(words).tobytes()
    lengths = words.ends - words.starts + 1
    stops = np.cumsum(lengths)  # of each word, in the squeezed text
    first = np.cumsum(number) - number
    lead = np.repeat(words.first[:-1] - first, number) + np.arange(number.sum())
    last = np.minimum(lead + shingle, np.repeat(words.first[1:], number)) - 1
    spans = zip((stops - lengths + 1)[lead].tolist(), stops[last].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in spans], np.uint64), number


#: Bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def majority(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Per text the bits that over half of its hashes have; 0 without hashes.

    Byte values are counted per text and byte position, then turned into bit counts.
    """
    texts = len(number)
    out = np.zeros((texts, 8), np.uint8)
    key = np.repeat(np.arange(texts) << 8, number)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        seen = np.bincount(key + columns[:, k], minlength=texts << 8).reshape(texts, 256)
        out[:, k] = np.packbits(2 * (seen @ _BITS) > number[:, None], axis=1, bitorder="little").ravel()
    return out.view(np.uint64).ravel()


def nodes(prints: np.ndarray, band: np.ndarray) -> pa.Array:
    """One value per row of ``prints`` (a 64-bit word per column): the words, then two bytes of band."""
    packed = np.concatenate([prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), band.astype(">u2")[:, None].view(np.uint8)], axis=1)
    return pa.array([row.tobytes() for row in packed], pa.binary())


def unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    words = np.ascontiguousarray(packed[:, :-2]).view(">u8").astype(np.uint64)
    return words, packed[:, -2].astype(np.int64) * 256 + packed[:, -1]


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``node``: 64 bits over all shingles, repeats included, in one band."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [nodes(majority(*shingle_hashes(texts, shingle))[:, None], np.zeros(len(texts), int))]

    return append(documents, compute, [NODE], keep=keep)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


@dataclass
class Tree:
    """Inner nodes by number; a negative child is leaf ``-child - 1``."""

    vantage: list[np.ndarray] = field(default_factory=list)
    border: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def build(cls, sample: np.ndarray, leaves: int, radius: int) -> Tree:
        tree = cls()
        tree._grow(sample, max(0, int(np.ceil(np.log2(max(1, leaves))))), radius)
        return tree

    def _grow(self, points: np.ndarray, depth: int, radius: int) -> int:
        best = None
        if depth and len(points) > 1:
            for vantage in points[:: max(1, len(points) // TRIES)]:
                distance = _distance(points, vantage)
                border = int(np.median(distance))
                if distance.max() <= border:
                    border -= 1
                inside = np.count_nonzero(distance <= border)
                if not inside or border < 0:
                    continue
                cost = np.count_nonzero(np.abs(distance - border) <= radius) + abs(2 * inside - len(points))
                if best is None or cost < best[0]:
                    best = cost, vantage, border, distance
        if best is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.vantage)
        self.vantage.append(best[1])
        self.border.append(best[2])
        self.inner.append(0)
        self.outer.append(0)
        self.inner[node] = self._grow(points[best[3] <= best[2]], depth - 1, radius)
        self.outer[node] = self._grow(points[best[3] > best[2]], depth - 1, radius)
        return node

    def leaves_of(self, points: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether the row is a guest there, for every leaf that a point visits."""
        row = np.arange(len(points))
        if not self.vantage:
            return row, np.zeros(len(points), np.int64), guest
        vantage, border = np.array(self.vantage), np.array(self.border)
        inner, outer = np.array(self.inner), np.array(self.outer)
        node, done = np.zeros(len(points), np.int64), []
        while len(row):
            distance, edge = _distance(points[row], vantage[node]), border[node]
            within = distance <= edge
            go_in = np.where(guest, distance <= edge + radius, within)
            go_out = np.where(guest, distance > edge - radius, ~within)
            visit = ~guest & within & (distance > edge - radius)
            row, node, guest = (
                np.concatenate([row[go_in], row[go_out], row[visit]]),
                np.concatenate([inner[node[go_in]], outer[node[go_out]], outer[node[visit]]]),
                np.concatenate([guest[go_in], guest[go_out], np.ones(visit.sum(), bool)]),
            )
            leaf = node < 0
            done.append((row[leaf], -node[leaf] - 1, guest[leaf]))
            row, node, guest = row[~leaf], node[~leaf], guest[~leaf]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]


def _tied(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a to b: equal within a component, the smallest index of it."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return labels
        for side in (a, b):
            np.minimum.at(labels, labels[side], low)
            np.minimum.at(labels, side, low)
        while not np.array_equal(labels, jumped := labels[labels]):
            labels = jumped


def leaf_links(points: np.ndarray, guest: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the components of a leaf; two guests are not compared.

    Rows are taken in order of distance to a pivot; partners of a block lie in the rings
    that the triangle inequality leaves.
    """
    labels = np.arange(len(points))
    homes = np.flatnonzero(~guest)
    if len(homes):
        ring = _distance(points, points[homes[0]])
        order = np.argsort(ring, kind="stable")
        rings, mine = ring[order], order[~guest[order]]
        for at in range(0, len(mine), block):
            rows = mine[at : at + block]
            lo = np.searchsorted(rings, ring[rows[0]] - radius, "left")
            hi = np.searchsorted(rings, ring[rows[-1]] + radius, "right")
            for to in range(lo, hi, 4 * block):
                others = order[to : min(hi, to + 4 * block)]
                apart = np.zeros((len(rows), len(others)), np.uint16)
                for w in range(points.shape[1]):
                    apart += np.bitwise_count(points[rows, w][:, None] ^ points[others, w][None])
                a, b = np.nonzero(apart <= radius)
                a, b = rows[a], others[b]
                labels = _tied(labels, a[a != b], b[a != b])
    tied = np.flatnonzero(labels != np.arange(len(points)))
    return tied, labels[tied]


def links(points: DataFrame, radius: int = RADIUS, bands: int = 1, leaf: int = LEAF) -> DataFrame:
    """Spanning links (a, b) between distinct nodes of one band, or of two that follow each other if ``bands`` is 2."""
    leaves = -(-points.count() // leaf)
    sample = points.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, PER_LEAF * leaves)).collect() if leaves > 1 else []
    words = unpacked([bytes(r[0]) for r in sample])[0] if sample else np.zeros((0, 1), np.uint64)
    shared = points.sparkSession.sparkContext.broadcast(Tree.build(words, leaves, radius))

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, band = unpacked(batch.column(0).to_pylist())
            for step in range(bands):
                row, at, guest = shared.value.leaves_of(values, np.full(len(values), step > 0), radius)
                key = (band[row] + step << 40) | at
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), pa.array(guest)], ["leaf", "node", "guest"])

    def compared(table: pa.Table) -> pa.Table:
        node = table["node"].combine_chunks()
        a, b = leaf_links(unpacked(node.to_pylist())[0], table["guest"].to_numpy().astype(bool), radius)
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    spread = points.mapInArrow(dealt, "leaf long, node binary, guest boolean")
    return spread.groupBy("leaf").applyInArrow(compared, "a binary, b binary")


def components(prints: DataFrame, radius: int = RADIUS, bands: int = 1) -> DataFrame:
    """``prints`` (doc_id, node, ...) with ``component_id``, the smallest doc_id that links reach."""
    points = staged(prints.groupBy("node").agg(F.min("doc_id").alias("smallest")), "points")
    roots = component_roots(links(points.select("node"), radius, bands))
    grouped = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = staged(grouped.groupBy("root").agg(F.min("smallest").alias("component_id")), "named")
    labels = staged(grouped.join(named, "root").select("node", "component_id"), "labels")
    return prints.join(labels, "node")


def digest(documents: DataFrame) -> DataFrame:
    """The contracted columns of the registered query."""
    prints = staged(fingerprints(documents, keep=["doc_id"]), "fingerprints")
    return components(prints).select("doc_id", F.lower(F.hex(F.substring("node", 1, 8))).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each group of linked fingerprints one row stays.

    It is the row with the smallest doc_id; a row without doc_id stays where no other row of
    its group has one. Of rows that group, fingerprint and doc_id leave, the one with the
    least text stays (null first). Columns of any name are kept as they are.
    """
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"

    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [nodes(majority(*shingle_hashes(texts, shingle))[:, None], np.zeros(len(texts), int))]

    rows = staged(append(plain, compute, [NODE], text=text), "printed")
    best = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"))).alias("best")
    points = staged(rows.groupBy("node").agg(best), "points")
    grouped = points.join(component_roots(links(points.select("node"), radius)), "node", "left")
    first = F.min(F.struct("best", "node")).alias("first")
    chosen = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(first)
    chosen = staged(chosen.select(F.col("first.node").alias("node"), F.col("first.best.doc_id").alias("best_id")), "chosen")
    kept = rows.join(chosen, "node").where(F.col(doc_id).eqNullSafe(F.col("best_id")))
    one = kept.groupBy("node").agg(F.min_by(F.struct(*plain.columns), F.struct(text)).alias("row"))
    return one.select("row.*").toDF(*names)
