"""Removal of repeated byte strings, with a column-wise multi-string Burrows-Wheeler index.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller doc_id. Strings are judged on the input, overlaps count, and no match crosses
documents. The collection is indexed in pieces that Spark shuffles:

1. **Stretches.** Of the ``GRAM``-byte strings within each window of ``LENGTH`` bytes the one
   with the least hash is its anchor. Windows that follow each other and share an anchor
   form a stretch. Equal windows have equal anchors at equal places, wherever they stand, so
   all occurrences of a window lie in stretches of one anchor.
2. **Copies of stretches.** Per anchor, a stretch that also occurs in a smaller document is
   wholly removed. Equal stretches are one string with the smallest doc_id from here on.
3. **Column-wise index.** The different stretches of an anchor that are left, those at the
   borders of passages, are the strings of a collection. ``Collection`` builds its
   Burrows-Wheeler transform from right to left: every round inserts one symbol of each
   string, at the place that the rank of the last one gives, and updates the lengths of
   common prefixes in the same pass. The columns of a round are read in sequence from the
   shuffled Arrow batches, anchors in sorted order, a bounded number of strings at a time.
   Suffixes with a common prefix of ``LENGTH`` or more are neighbours; each run of them
   gets the smallest doc_id of its strings.
4. Both answers meet the text again per document and become removed runs.

Hot passages: anchors and stretches found in over ``HOT_SHARE`` of the documents, a number
bounded by what a document can hold, are counted in a first pass. A hot anchor is cut into
single windows, so its many borders spread over many keys, and a hot stretch or window is
settled in place from a table of its smallest doc_id, so only that document sends it on.

Null text is empty. Rows without doc_id neither lose bytes nor cause a loss. Rows that
repeat a doc_id are judged alike and never against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.batches import mix, powers, slices
from worklens.llm.staging import staged

#: Bytes of a repeated string, bytes of an anchor.
LENGTH, GRAM = 50, 24
#: Share of documents, and their least number, from which an anchor or stretch is settled in place.
HOT_SHARE, HOT_LEAST = 0.005, 64.0
#: Strings indexed at a time (whole anchors; a larger one is alone).
STRINGS = 1 << 10
#: Bytes of texts, and windows of a longer text, looked at together; their arrays fit a core's cache.
_CHUNK = 1 << 16
_PLACE = np.uint64((1 << 21) - 1)


class Stretches:
    """Stretches of some texts: anchor and content hash, text number, first and last window (byte offsets within the joined texts)."""

    def __init__(self, texts: list[bytes], cut: np.ndarray | None = None) -> None:
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.edges = np.append(0, np.cumsum(np.array([len(t) for t in texts], np.int64)))
        found, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(self.edges, self.edges[at] + _CHUNK, "right")) - 1)
            base = self.edges[at]
            text, first, last, anchor, content = _Block(self.raw[base : self.edges[stop]], self.edges[at : stop + 1] - base).stretches(cut)
            found.append((text + at, first + base, last + base, anchor, content))
            at = stop
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.text, self.first, self.last, self.anchor, self.content = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none


class _Block:
    """Some whole texts side by side, few enough for a core's cache (one text alone may be larger)."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray) -> None:
        self.edges, self.size = edges, len(raw)
        up, self._down = powers(self.size + 1)
        self._sums = np.zeros(self.size + 1, np.uint64)
        for a in range(0, self.size, _CHUNK):
            b = min(a + _CHUNK, self.size)
            terms = raw[a:b].astype(np.uint64)
            terms += np.uint64(1)
            terms *= up[a:b]
            terms[:1] += self._sums[a : a + 1]
            np.cumsum(terms, out=self._sums[a + 1 : b + 1])
        # Windows that reach over the end of a text are none.
        over = edges[1:, None] - np.arange(1, LENGTH)
        self._whole = np.ones(self.size, bool)
        self._whole[over[over >= edges[:-1, None]]] = False

    def stretches(self, cut: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Text, first and last window, anchor and content hash of each stretch."""
        found = [self._of(a, min(a + _CHUNK, self.size - LENGTH + 1)) for a in range(0, max(0, self.size - LENGTH + 1), _CHUNK)]
        text, first, last, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        if len(found) > 1:
            # A stretch over a chunk border comes in two parts with one anchor place. Joined, stretches depend on their text only.
            fresh = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
            text, first, last, place = text[fresh], first[fresh], last[np.append(fresh[1:], len(place))[: len(fresh)] - 1], place[fresh]
        anchor = self.hashed(place, place + GRAM)
        if cut is not None and len(cut) and len(anchor):
            hot = _found(anchor, cut) >= 0
            if hot.any():
                number = np.where(hot, last - first + 1, 1)
                within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                hot = np.repeat(hot, number)
                text, first, last, anchor = (np.repeat(x, number) for x in (text, first, last, anchor))
                first = np.where(hot, first + within, first)
                last = np.where(hot, first, last)
                anchor = np.where(hot, self.hashed(first, last + LENGTH), anchor)
        return text, first, last, anchor, mix(self.hashed(first, last + LENGTH) ^ (anchor * np.uint64(3)))

    def hashed(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sums[stop] - self._sums[start]) * self._down[start])

    def _of(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Stretches of the windows that begin in [start, stop)."""
        end = stop + LENGTH - GRAM
        least = self._sums[start + GRAM : end + GRAM] - self._sums[start:end]
        least *= self._down[start:end]
        least ^= least >> np.uint64(32)
        least *= np.uint64(0x9E3779B97F4A7C15)
        least &= ~_PLACE
        least |= np.arange(end - start, dtype=np.uint64)
        span, want = 1, LENGTH - GRAM + 1
        while 2 * span <= want:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        place = (np.minimum(least[: stop - start], least[want - span : want - span + stop - start]) & _PLACE).astype(np.int32)
        whole, change = self._whole[start:stop], place[1:] != place[:-1]
        begins, ends = whole.copy(), whole.copy()
        begins[1:] &= change | ~whole[:-1]
        ends[:-1] &= change | ~whole[1:]
        begin = np.flatnonzero(begins)
        text = np.searchsorted(self.edges, begin + start, "right") - 1
        return text, begin + start, np.flatnonzero(ends) + start, place[begin].astype(np.int64) + start


class Collection:
    """Burrows-Wheeler transform and common prefixes of a string collection, built column by column.

    Round ``j`` inserts the suffix of length ``j`` of every string that has one. ``symbols``
    holds, in suffix order, the byte before each suffix (plus one; 0 where the string
    begins), ``shared`` the common prefix with the suffix before it, up to ``depth``. The
    place of a new suffix is the number of suffixes that begin with a smaller byte plus the
    rank of its byte up to the suffix that it extends. Its common prefix with a neighbour
    that begins alike is one more than the least value between the suffixes they extend.
    """

    def __init__(self, strings: list[bytes], depth: int = LENGTH) -> None:
        count, sizes = len(strings), np.array([len(s) for s in strings])
        width = int(sizes.max())
        table = np.frombuffer(b"".join(s.rjust(width, b"\0") for s in strings), np.uint8).reshape(-1, width).T
        # The rounds read and write these arrays as a whole, so their numbers are as narrow as the values allow.
        columns = np.ascontiguousarray(table, np.uint8 if table.max(initial=0) < 255 else np.uint16) + 1
        before = lambda ids, size: np.where(sizes[ids] > size, columns[max(width - size - 1, 0), ids], 0).astype(columns.dtype)
        live = np.arange(count)
        self.symbols = before(live, 0)
        # Which suffix stands at a place, as size times the number of strings plus owner; and one value past the last common prefix.
        self._suffix = live.astype(np.min_scalar_type((width + 1) * count))
        self._shared = np.zeros(count + 1, np.min_scalar_type(-depth - 1))
        place = np.arange(count)  # of the last suffix of each live string, in ascending order
        for size in range(1, width + 1):
            going = sizes[live] >= size
            live, place = live[going], place[going]
            order = np.argsort(self.symbols, kind="stable")
            last = np.zeros(len(order), bool)
            last[place] = True
            # Ranks of the last suffixes, and their strings in that order, which is that of the new suffixes too.
            r = np.flatnonzero(last[order])
            live = live[np.argsort(self.symbols[place], kind="stable")]
            ended = int(np.count_nonzero(self.symbols == 0))
            above, below = self._extended(order, r, depth)
            place = count + r - ended
            self._insert(place, size * count + live, before(live, size), above)
            # A follower that begins alike gets its prefix with the new suffix; new followers have theirs.
            follows = np.flatnonzero(below >= 0)
            self._shared[place[follows] + 1] = below[follows]
        self.shared = self._shared[:-1]
        self.size, self.owner = (x.astype(np.int32) for x in np.divmod(self._suffix, count))

    def _extended(self, order: np.ndarray, ranks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Common prefixes of the suffixes that extend those at these sorted ranks with their neighbours above and below; -1 where they begin differently."""
        at = order[ranks]
        first, second = order[np.maximum(ranks - 1, 0)], order[np.minimum(ranks + 1, len(order) - 1)]
        symbols = self.symbols[at]
        above = (ranks > 0) & (self.symbols[first] == symbols)
        below = (ranks + 1 < len(order)) & (self.symbols[second] == symbols)
        bounds = np.stack([np.where(above, first, at) + 1, at + 1, np.where(below, second, at) + 1], axis=1)
        # From the last to the first, so that what lies between two triples is not looked at.
        least = np.minimum.reduceat(self._shared, bounds[::-1].ravel()).reshape(-1, 3)[::-1].astype(np.int64)
        least = np.minimum(least + 1, depth)
        return np.where(above, least[:, 0], -1), np.where(below, least[:, 1], -1)

    def _insert(self, to: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, shared: np.ndarray) -> None:
        total = len(self.symbols) + len(to)
        old = np.ones(total + 1, bool)
        old[to] = False
        for name, fresh in (("symbols", symbols), ("_suffix", suffixes), ("_shared", np.maximum(shared, 0))):
            values = getattr(self, name)
            size = total + (name == "_shared")
            grown = np.empty(size, values.dtype)
            grown[to], grown[old[:size]] = fresh, values
            setattr(self, name, grown)

    def repeated(self, docs: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
        """Owner and suffix size of each string of ``depth`` bytes that also has an owner with a smaller document."""
        starts = self.shared < depth
        group = np.cumsum(starts) - 1
        least = np.minimum.reduceat(docs[self.owner], np.flatnonzero(starts))
        again = (self.size >= depth) & (least[group] < docs[self.owner])
        return self.owner[again], self.size[again]


def _hot(documents: DataFrame, least: float, values) -> DataFrame:
    """(key, docs, smallest) of keys that are frequent within slices and add up to ``least`` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found, ids = values(texts), part.column("doc_id").to_numpy(zero_copy_only=False)
                key, text = found
                # Most keys stand once in a slice; only the others are sorted with their documents.
                order = np.argsort(key)
                alike = key[order[1:]] == key[order[:-1]]
                order = order[np.append(alike, False) | np.append(False, alike)] if len(order) else order
                order = order[np.lexsort((ids[text[order]], key[order]))]
                key, text = key[order], text[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                key, doc = key[fresh], ids[text[fresh]]
                keys, first, number = np.unique(key, return_index=True, return_counts=True)
                often = number >= max(2, HOT_SHARE * len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(number[often]), pa.array(doc[first[often]])], ["key", "docs", "smallest"])

    counted = documents.mapInArrow(run, "key long, docs long, smallest long").groupBy("key")
    return counted.agg(F.sum("docs").alias("docs"), F.min("smallest").alias("smallest")).where(F.col("docs") >= least)


def _settled(found: Stretches, ids: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Stretches whose content a smaller document is known to have."""
    keys, smallest = hot
    if not len(keys) or not len(found.content):
        return np.zeros(len(found.content), bool)
    at = np.minimum(np.searchsorted(keys, found.content), len(keys) - 1)
    return (keys[at] == found.content) & (smallest[at] < ids[found.text])


def _listed(documents: DataFrame, cut, hot) -> DataFrame:
    """Per document with a repeat: hashes of stretches that are wholly removed, and of those to be indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                found = Stretches(texts, cut.value)
                settled = _settled(found, ids, hot.value)
                marked = np.unique(found.text[settled])
                open_ = np.flatnonzero(~settled)
                order = open_[np.argsort(_keys(found.content[open_].view(np.int64), found.text[open_]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (found.content[order[1:]] != found.content[order[:-1]]) | (found.text[order[1:]] != found.text[order[:-1]])
                order = np.sort(order[fresh])
                anchor = np.concatenate([found.anchor[order], mix(ids[marked].astype(np.uint64))]).view(np.int64)
                content = np.concatenate([found.content[order], np.zeros(len(marked), np.uint64)]).view(np.int64)
                doc = np.concatenate([ids[found.text[order]], ids[marked]])
                mark = np.concatenate([np.zeros(len(order), bool), np.ones(len(marked), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(doc), pa.array(mark)], ["anchor", "content", "doc", "mark"])

    # One sort serves both windows; without it Spark sorts by anchor first and again for the second.
    rows = documents.mapInArrow(run, "anchor long, content long, doc long, mark boolean").repartition("anchor").sortWithinPartitions("anchor", "content")
    group, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    plain = lambda c: F.when(~F.col("mark"), F.col(c))
    rows = rows.select(
        "*",
        (F.min(plain("doc")).over(group) < F.max(plain("doc")).over(group)).alias("several"),
        (F.min(plain("content")).over(group) < F.max(plain("content")).over(group)).alias("differ"),
    ).where("mark or several")  # the anchors of one document alone, which are most, end here
    rows = rows.select("*", F.min(plain("doc")).over(same).alias("smallest"))
    gone = ~F.col("mark") & (F.col("doc") > F.col("smallest"))
    open_ = ~F.col("mark") & F.col("several") & F.col("differ") & (F.col("doc") == F.col("smallest"))
    kept = rows.select("doc", "content", "mark", gone.alias("gone"), open_.alias("open")).where("mark or gone or open")
    return kept.groupBy("doc").agg(
        F.collect_list(F.when(F.col("gone"), F.col("content"))).alias("gone"),
        F.collect_list(F.when(F.col("open"), F.col("content"))).alias("open"),
    )


def _keys(content: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Content hashes made to differ between the texts of a slice."""
    return content.astype(np.int64).view(np.uint64) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _listed_keys(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number of each entry of a list column, and the entries; null lists count as empty."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array ``among``, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def _isin(found: Stretches, lists: pa.Array) -> np.ndarray:
    """Whether each stretch's content is in the list of its text."""
    text, values = _listed_keys(lists)
    among = np.sort(_keys(values.to_numpy(zero_copy_only=False), text))
    return _found(_keys(found.content.view(np.int64), found.text), among) >= 0


def _indexed(affected: DataFrame, cut) -> DataFrame:
    """(doc, content, mask): which windows of an open stretch a smaller document has."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = Stretches(texts, cut.value)
                content = found.content.view(np.int64)
                wanted = np.flatnonzero(_isin(found, part.column("open")))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[found.text[wanted]]
                raw = found.raw.tobytes()
                data = [raw[a : b + LENGTH] for a, b in zip(found.first[wanted].tolist(), found.last[wanted].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.anchor[wanted].view(np.int64)), pa.array(ids), pa.array(content[wanted]), pa.array(data, pa.binary())], ["anchor", "doc", "content", "string"]
                )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(held) >= STRINGS and row[0] != held[-1][0]:
                    yield _masks(held)
                    held = []
                held.append(row)
        if held:
            yield _masks(held)

    rows = affected.where(F.size("open") > 0).select("doc_id", "text", "open").mapInArrow(strings, "anchor long, doc long, content long, string binary")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "content", "doc").mapInArrow(index, "doc long, content long, mask long")


def _masks(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Equal strings are inserted once, with the smallest document; each gets the bits of its repeated windows."""
    doc_of: dict[bytes, int] = {}
    for _, doc, _, string in rows:
        doc_of[string] = min(doc, doc_of.get(string, doc))
    strings = list(doc_of)
    owner, size = Collection(strings).repeated(np.array([doc_of[s] for s in strings]))
    masks = np.zeros(len(strings), np.int64)
    if len(owner):
        window = np.array([len(s) for s in strings])[owner] - size
        np.bitwise_or.at(masks, owner, np.int64(1) << window)
    mask_of = dict(zip(strings, masks.tolist(), strict=True))
    out = [(d, c, mask_of[s] if d == doc_of[s] else -1) for _, d, c, s in rows]
    out = [r for r in out if r[2]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["doc", "content", "mask"])


SPANS = "array<struct<start:bigint,stop:bigint>>"


def _spans(found: Stretches, ids: np.ndarray, hot, gone: pa.Array, masks: pa.Array) -> list[list[tuple[int, int]]]:
    """Removed runs of bytes of each text."""
    whole = _settled(found, ids, hot) | _isin(found, gone)
    begin, stop = [found.first[whole]], [found.last[whole] + LENGTH]
    text, entries = _listed_keys(masks)
    if len(entries):
        keys = _keys(entries.field("content").to_numpy(zero_copy_only=False), text)
        order = np.argsort(keys)
        place = _found(_keys(found.content.view(np.int64), found.text), keys[order])
        some = np.flatnonzero((place >= 0) & ~whole)
        mask = entries.field("mask").to_numpy(zero_copy_only=False)[order[place[some]]]
        size = (found.last - found.first + 1)[some]
        row, window = np.nonzero((mask[:, None] >> np.arange(LENGTH - GRAM + 1) & 1) & (np.arange(LENGTH - GRAM + 1) < size[:, None]))
        begin.append(found.first[some][row] + window)
        stop.append(begin[-1] + LENGTH)
    total = len(found.raw) + 1
    edge = np.bincount(np.concatenate(begin), minlength=total) - np.bincount(np.concatenate(stop), minlength=total)
    covered = np.cumsum(edge[:-1]) > 0
    out = []
    for a, b in zip(found.edges[:-1], found.edges[1:], strict=True):
        flag = np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(flag == 1).tolist(), np.flatnonzero(flag == -1).tolist(), strict=True)))
    return out


def repeated_spans(documents: DataFrame, hot_least: float = HOT_LEAST) -> DataFrame:
    """(doc_id, text, spans) of the documents that lose bytes; equal rows once.

    Anchors and stretches of fewer than ``hot_least`` documents are never settled in place.
    """
    spark = documents.sparkSession
    known = documents.select("doc_id", "text").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    least = max(hot_least, HOT_SHARE * known.count())
    anchors = _hot(known, least, lambda texts: (lambda s: (s.anchor, s.text))(Stretches(texts))).select("key").collect()
    cut = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in anchors], np.int64).view(np.uint64)))
    contents = _hot(known, least, lambda texts: (lambda s: (s.content, s.text))(Stretches(texts, cut.value))).collect()
    keys = np.array([r["key"] for r in contents], np.int64).view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], np.array([r["smallest"] for r in contents], np.int64)[order]))
    lists = staged(_listed(known, cut, hot), "repeat-lists")
    joined = known.join(lists.withColumnRenamed("doc", "doc_id"), "doc_id").dropDuplicates(["doc_id", "text"])
    affected = staged(joined, "affected")
    masks = _indexed(affected, cut).groupBy("doc").agg(F.collect_list(F.struct("content", "mask")).alias("masks"))
    both = affected.join(staged(masks, "masks").withColumnRenamed("doc", "doc_id"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                spans = _spans(Stretches(texts, cut.value), ids, hot.value, part.column("gone"), part.column("masks"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                rows = [[{"start": a, "stop": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(rows, kind)], ["doc_id", "text", "spans"])

    found = both.select("doc_id", "text", "gone", "masks").mapInArrow(run, f"doc_id long, text string, spans {SPANS}")
    return found.where(F.size("spans") > 0)


def digest(documents: DataFrame, hot_least: float = HOT_LEAST) -> DataFrame:
    """The contracted columns of the registered query."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = documents.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    # Bytes outside the runs, as hex digits, so that a run may begin inside a character.
    digits = F.hex(F.col("text").cast("binary"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["stop"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    kept = F.unhex(F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.substring(F.col("digits"), (2 * x["a"] + 1).cast("int"), (2 * (x["b"] - x["a"])).cast("int"))), ""))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    lost = repeated_spans(documents, hot_least).withColumn("digits", digits).select(
        F.col("doc_id").alias("lost_id"), F.sha2(F.col("text").cast("binary"), 256).alias("lost_text"), removed.alias("lost"), F.size("spans").cast("long").alias("runs"), F.sha2(kept, 256).alias("rest")
    )
    both = base.join(lost, (base["doc_id"] == lost["lost_id"]) & (base["whole"] == lost["lost_text"]), "left")
    none = F.lit(0).cast("long")
    return both.select("doc_id", "n_bytes", F.coalesce("lost", none).alias("n_removed"), F.coalesce("runs", none).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256"))
