"""Ranked lexical search: the best documents of every item, by norm buckets in the manner of LEMP.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. One pass
over the documents counts N, L and the df of the items' terms. A second makes of each document
its impact vector: per term ``(10^9 tf) div (1000 tf + 8 m)``. An item is the vector of its
terms' weights times their repeats, and a score is the product of two vectors.

Each task searches its documents in groups of ``GROUP``:

- vectors are ordered by length and cut into buckets of ``BUCKET``, longest first;
- a bucket is pruned for every item whose length times that of the bucket's longest vector is
  below the item's tenth score so far (Cauchy-Schwarz), as are then all later buckets;
- inside, the item's ``FOCUS`` largest coordinates are taken as they are and the rest is
  bounded by the lengths of what remains, so that most vectors fall away;
- survivors are scored exactly, in 64-bit integers. Bounds are in doubles, with a margin, and
  prune only what lies strictly below, so ties are never lost.

A task returns the best of what it has read per item; the best of those are taken after one
small shuffle. Copies of one document stay apart; a group of any size is only mapped over.
Items come in blocks of at most ``BLOCK_BYTES`` of text (or one item), which bounds what is
broadcast; a further block reads the documents again. Long texts are read in pieces.

Null and empty texts have no terms and no rank; they do not count in N. Every row of
``items`` is an item of its own, and gets its rows under its id, also if the id is null or
repeated. Repeated documents are ranked each; equal scores go by doc_id, null last.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from worklens.llm.batches import LOWER, Words, byte_table, slices

#: Item text in one pass.
BLOCK_BYTES = 4 << 20
#: Documents of a group and of a bucket, coordinates taken exactly, documents kept per item.
GROUP, BUCKET, FOCUS, TOP = 16384, 256, 3, 10
#: Bytes of one text that are split into terms at a time.
PIECE = 4 << 20

SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASSES = byte_table(lambda b: int(SEPARATOR.match(bytes([b])) is None))
_MARGIN = 1 + 1e-9


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.translate(LOWER.tobytes()))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Vocabulary:
    """The items' terms, found by hash and then compared byte by byte."""

    def __init__(self, words: set[bytes]) -> None:
        self.terms = sorted(words)
        table = Words([b"\n".join(self.terms)], CLASSES)
        (hashes,) = table.hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[self.order], table.data
        self.starts, self.sizes = table.starts[self.order], (table.ends - table.starts)[self.order]
        self.longest_run = max(Counter(self.hashes.tolist()).values(), default=0)

    def __len__(self) -> int:
        return len(self.terms)

    def places(self, words: Words) -> np.ndarray:
        """The number of each word among the terms, or -1."""
        out = np.full(len(words.starts), -1)
        if not len(self.terms) or not len(out):
            return out
        (hashes,) = words.hashes()
        first, sizes = np.searchsorted(self.hashes, hashes), words.ends - words.starts
        for step in range(self.longest_run):
            at = np.minimum(first + step, len(self.hashes) - 1)
            like = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
            if len(like):
                size, stops = sizes[like], np.cumsum(sizes[like])
                inside = np.arange(stops[-1]) - np.repeat(stops - size, size)
                differs = words.data[np.repeat(words.starts[like], size) + inside] != self.data[np.repeat(self.starts[at[like]], size) + inside]
                same = np.add.reduceat(differs, stops - size) == 0
                out[like[same]] = self.order[at[like[same]]]
        return out


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """All texts at once, or long ones in parts that end between terms; with the first text's number."""
    at = 0
    for i, text in enumerate(texts):
        if len(text) <= PIECE:
            continue
        if i > at:
            yield at, texts[at:i]
        start = 0
        while start < len(text):
            cut = SEPARATOR.search(text, start + PIECE)
            stop = cut.end() if cut else len(text)
            yield i, [text[start:stop]]
            start = stop
        at = i + 1
    if at < len(texts):
        yield at, texts[at:]


def term_counts(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; and document, term and occurrences of those that the vocabulary has."""
    number, size = np.zeros(len(texts), np.int64), max(1, len(vocabulary))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, part in pieces(texts):
        words = Words(part, CLASSES, LOWER)
        length = words.counts()
        number[first : first + len(part)] += length
        place = vocabulary.places(words)
        doc = np.repeat(np.arange(first, first + len(part)), length)
        key, count = np.unique((doc * size + place)[place >= 0], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    occurrences = np.zeros(len(key), np.int64)
    np.add.at(occurrences, back, np.concatenate(counts))
    return number, key // size, key % size, occurrences


def statistics(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term; every task adds up what it has read."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for _, texts in slices(batch, text):
                number, _, term, _ = term_counts(texts, shared.value)
                total[:size] += np.bincount(term, minlength=size)
                total[size:] += np.count_nonzero(number), number.sum()
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "total"])

    found = documents.select(documents[f"`{text}`"].alias(text)).mapInArrow(run, "term long, total long").groupBy("term").agg(F.sum("total").alias("total"))
    total = np.zeros(len(vocabulary) + 2, np.int64)
    for row in found.collect():  # bounded by the vocabulary
        total[row["term"]] = row["total"]
    return int(total[-2]), int(total[-1]), total[:-2]


class Search:
    """Items as sparse vectors, and the search of documents for them."""

    def __init__(self, items: list[Counter], vocabulary: Vocabulary, documents: int, total: int, holding: np.ndarray) -> None:
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        weights = np.array([weight(documents, int(h)) for h in holding], np.int64)
        self.vocabulary, self.documents, self.total = vocabulary, documents, total
        self.terms = [np.array([number[t] for t in sorted(item)], np.int64) for item in items]
        self.values = [weights[t] * np.array([item[w] for w in sorted(item)], np.int64) for t, item in zip(self.terms, items, strict=True)]
        self.focus = [np.argsort(-v, kind="stable")[:FOCUS] for v in self.values]
        self.squares = np.array([float((v.astype(float) ** 2).sum()) for v in self.values])
        self.lengths = np.sqrt(self.squares)

    def impacts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and impact of the vectors of some texts."""
        number, doc, term, tf = term_counts(texts, self.vocabulary)
        m = 25 + (75 * number * self.documents) // max(1, self.total)
        return doc, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


class Best:
    """The best documents of each item so far, within a task."""

    def __init__(self, search: Search, top: int) -> None:
        self.search, self.top = search, top
        self.floor = np.zeros(len(search.terms), np.int64)  # a score below it can't be among the best
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(search.terms)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(search.terms)
        self.none: list[np.ndarray] = [np.zeros(0, bool)] * len(search.terms)
        self.query = np.zeros(max(1, len(search.vocabulary)), np.int64)
        self.looked_at = self.scored = 0

    def take(self, item: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids]), np.concatenate([self.none[item], none])
        order = np.lexsort((ids, none, -scores))[: self.top]
        self.scores[item], self.ids[item], self.none[item] = scores[order], ids[order], none[order]
        if len(order) == self.top:
            self.floor[item] = self.scores[item][-1]

    def add(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Search a group: entries ordered by document, ids per document number."""
        if not len(doc):
            return
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        squares = np.add.reduceat(impact.astype(float) ** 2, first)
        order = np.argsort(-squares, kind="stable")
        sizes = np.diff(np.append(first, len(doc)))
        active = np.arange(len(self.floor))
        for at in range(0, len(order), BUCKET):
            rows = order[at : at + BUCKET]
            longest = math.sqrt(squares[rows[0]])
            active = active[self.search.lengths[active] * longest * _MARGIN + 1 >= self.floor[active]]
            if not len(active):
                return
            size = sizes[rows]
            starts = np.cumsum(size) - size
            inside = np.arange(size.sum()) - np.repeat(starts - first[rows], size)
            self._bucket(active, np.repeat(np.arange(len(rows)), size), term[inside], impact[inside], starts, squares[rows], ids[doc[first[rows]]], none[doc[first[rows]]])

    def _bucket(self, active, row, term, impact, starts, squares, ids, none) -> None:
        by_term = np.argsort(term, kind="stable")
        sorted_term = term[by_term]
        for item in active.tolist():
            terms, values, rows = self.search.terms[item], self.search.values[item], None
            self.looked_at += len(squares)
            if self.floor[item]:
                taken, rest, left = np.zeros(len(squares)), self.search.squares[item], squares.copy()
                for k in self.search.focus[item]:
                    here = by_term[np.searchsorted(sorted_term, terms[k], "left") : np.searchsorted(sorted_term, terms[k], "right")]
                    value = impact[here].astype(float)
                    taken[row[here]] += float(values[k]) * value
                    left[row[here]] -= value**2
                    rest -= float(values[k]) ** 2
                bound = taken + np.sqrt(max(rest, 0.0) * np.maximum(left, 0.0))
                rows = bound * _MARGIN + 1 >= self.floor[item]
                if not rows.any():
                    continue
            self.query[terms] = values
            if rows is None or 2 * np.count_nonzero(rows) > len(rows):
                scores, which = np.add.reduceat(self.query[term] * impact, starts), np.arange(len(squares))
            else:
                entry = rows[row]
                which = np.flatnonzero(rows)
                of = row[entry]
                scores = np.add.reduceat(self.query[term[entry]] * impact[entry], np.flatnonzero(np.append(True, of[1:] != of[:-1])))
            self.query[terms] = 0
            self.scored += len(which)
            good = (scores > 0) & (scores >= self.floor[item])
            if good.any():
                self.take(item, scores[good], ids[which[good]], none[which[good]])


def _searched(documents: DataFrame, search: Search, names: list, kind: StructField, block: int, text: str, top: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((search, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, names = shared.value
        best, held, count = Best(search, top), [], 0

        def flush() -> None:
            edges = np.cumsum([0] + [len(h[3]) for h in held])
            doc = np.concatenate([h[0] + e for h, e in zip(held, edges, strict=False)])
            best.add(doc, *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4)))
            held.clear()

        schema = None
        for batch in batches:
            schema = batch.schema
            for part, texts in slices(batch, "text"):
                ids = part.column("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False)
                held.append((*search.impacts(texts), ids.fill_null(0).to_numpy(zero_copy_only=False), none))
                count += len(texts)
                if count >= GROUP:
                    flush()
                    count = 0
        if held:
            flush()
        item = np.repeat(np.arange(len(names)), [len(s) for s in best.scores])
        if schema is None or not len(item):
            return
        ids = pa.array(np.concatenate(best.ids), mask=np.concatenate(best.none))
        yield pa.RecordBatch.from_arrays([pa.array(item + (block << 32)), pa.array(names, to_arrow_type(kind.dataType)).take(pa.array(item)), ids, pa.array(np.concatenate(best.scores))], ["item", "item_id", "doc_id", "score"])

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents[f"`{text}`"].alias("text"))
    return rows.mapInArrow(run, StructType([StructField("item", LongType()), kind, StructField("doc_id", LongType()), StructField("score", LongType())]))


def ranked(documents: DataFrame, items: DataFrame, text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0."""
    kind = StructField("item_id", items.schema["item_id"].dataType)
    queries = items.select("item_id", "text")
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        # Bounded: about block_bytes of item text.
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else queries.collect()
        counted = [Counter(terms((r["text"] or "").encode())) for r in rows]
        vocabulary = Vocabulary(set().union(*counted))
        search = Search(counted, vocabulary, *statistics(documents, vocabulary, text))
        part = _searched(documents, search, [r["item_id"] for r in rows], kind, block, text, top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM texts),
entries AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM entries, totals GROUP BY term, docs),
wanted AS (SELECT q, item_id, term, count(*) AS repeats
           FROM (SELECT q, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(len(terms) AS BIGINT) * docs) // total)))) AS BIGINT) AS score
           FROM wanted JOIN weights USING (term) JOIN entries USING (term) JOIN texts USING (r), totals GROUP BY q, item_id, r, doc_id),
places AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= {TOP}
"""
