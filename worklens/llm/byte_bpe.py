"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A word is the array of the ids of its bytes, and the ranked merges are a fold over it: the
accumulator holds, for every place, its id and the id of what it and its neighbour join to, as
one number. Each step joins the leftmost pair of least rank and looks up the two new pairs only. Ranks are the
result of a scalar subquery (as a literal they would stand in the text of every plan): one flat array of numbers, each a pair of ids with the id of the joined bytes, at one of two places that
the remainders of the pair's number name (cuckoo hashing), since Spark searches a map from front to back. Behind
them stand the first cells of all pairs of bytes, which need no search. A word
that is a token as a whole is that token, as in the library. Nearly always the fold ends there too; tokens that
it does not reach are found when the vocabulary is read, and are a second literal.

The fold runs over distinct words. Those of the whole corpus are counted; the most frequent
ones, ``FREQUENT`` at most, are folded once each and broadcast, a table of bounded size. Texts
are split by the vocabulary's pattern (marks are put around its matches, so that a text stays one string
until it is cut in Arrow) and looked up in that table inside Arrow batches;
the distinct words of a text that it lacks are folded next to their text. So nothing but
word counts is shuffled, and no text is moved. Decoding concatenates the bytes of every id:
as an expression over a literal array (``Vocabulary.decoded``), or block by block where only
a hash of them is wanted (``digest``).

A fold copies its ids in each step, so its time grows with the square of a word's length.
Words of more than ``FOLDED`` bytes, which are rare and can be a text of one letter, are merged
in the Arrow batch instead, by a heap of ranked pairs, with the same result in n log n.

The special tokens of a vocabulary are not used. Null text counts as empty: no ids, no
bytes. Columns of any name are kept as they are; one named ``ids`` gives way to the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from worklens.llm.staging import staged

#: Words folded ahead, and the longest of them in characters: bounds of what is broadcast.
FREQUENT, LONGEST = 500_000, 64
#: Bytes of marked text that are looked at together in a task.
PART = 1 << 21
#: Stands before and after every word of a text; a text that has it is split by Spark.
MARK = "\x1e"
#: Longest word that is folded, in bytes.
FOLDED = 256
#: Maps in the literal of tokens that merges do not reach.
WORD_MAPS = 1 << 8
#: Ids are below this, so that three of them are one number; more ids than any folded word has.
PAIR, MOST = 1 << 21, 1 << 20
#: Bits of a cell below the id of what its place joins to, and those of its own id.
ABOVE, BITS = PAIR.bit_length() + MOST.bit_length() - 2, PAIR.bit_length() - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def _literal(entries: dict[str, object], maps: int, kind: str) -> Column:
    """A literal array of maps, each key in the map that its CRC-32 names."""
    parts: list[dict[str, object]] = [{} for _ in range(maps)]
    for key, value in entries.items():
        parts[zlib.crc32(key.encode()) % maps][key] = value
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _looked_up(literal: Column, maps: int, key: Column) -> Column:
    return F.try_element_at(F.get(literal, (F.crc32(key.cast("binary")) % maps).cast("int")), key)


def with_table(frame: DataFrame, values: list, kind: pa.DataType) -> DataFrame:
    """The frame with an array as column ``table_``, for use once in the select that follows.

    Spark evaluates the subquery once and puts its result in place of the column, so rows do not hold
    it. A literal would stand in the text of every plan, which the driver keeps.
    """
    table = frame.sparkSession.createDataFrame(pa.table({"table_": pa.array([values], pa.list_(kind))}))
    return frame.select("*", table.scalar().alias("table_"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value bound to a name within an expression, by an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair_ids(ranks: dict[bytes, int]) -> dict[int, int]:
    """Number of each pair of tokens that join to a token, with the id of that token."""
    out = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
            if left is not None and right is not None:
                out[left * PAIR + right] = rank
    return out


def _primes(least: int) -> Iterator[int]:
    while True:
        if all(least % k for k in range(2, int(least**0.5) + 1)):
            yield least
        least += 1


def placed(pairs: dict[int, int]) -> tuple[list[int], int, int]:
    """Pairs with their ids in one array, and the sizes of its two parts.

    A pair stands in the first part at its remainder by that part's size, or in the second
    likewise. Empty places hold -1.
    """
    # The first part is mostly empty. What ends at an empty first place is in no other: nothing ever leaves a place empty.
    size = max(7, len(pairs))
    while True:
        first, second = next(_primes(size * 5 // 2)), next(_primes(size * 5 // 4))
        slots = [-1] * (first + second)
        if all(_put(slots, first, second, pair * PAIR + rank) for pair, rank in pairs.items()):
            return slots, first, second
        size *= 2


def _put(slots: list[int], first: int, second: int, entry: int) -> bool:
    """Put an entry at its first place, and what was there at its other place, and so on; false if that has no end."""
    at = entry // PAIR % first
    for _ in range(500):
        slots[at], entry = entry, slots[at]
        if entry < 0:
            return True
        at = first + entry // PAIR % second if at < first else entry // PAIR % first
    return False


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of ranked pairs; for words too long to fold."""
    return [ranks[word]] if word in ranks else joined(word, ranks)


def joined(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that merges alone give."""
    size = len(word)
    start, after, before = list(range(size)), list(range(1, size + 1)), list(range(-1, size - 1))
    ends = list(range(1, size + 1))
    heap: list[tuple[int, int, int]] = []  # rank, start, end of a joined pair

    def offer(i: int) -> None:
        if i >= 0 and after[i] < size:
            end = ends[after[i]]
            rank = ranks.get(word[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

    for i in start:
        offer(i)
    alive = [True] * size
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= size or ends[after[i]] != end:
            continue
        gone = after[i]
        alive[gone], ends[i], after[i] = False, end, after[gone]
        if after[gone] < size:
            before[after[gone]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : ends[i]]] for i in start if alive[i]]


def first_cells(ranks: dict[bytes, int], pairs: dict[int, int]) -> list[int | None]:
    """The cell of each byte before each byte, and before the end of a word (256); none for bytes that are no token.

    They are less by the cell of id 0 that joins to nothing, so that most are short numbers where they stand in a plan.
    """
    octets = [*(ranks.get(bytes([b])) for b in range(256)), None]
    joined = lambda a, b: PAIR if b is None else pairs.get(a * PAIR + b, PAIR)
    return [None if a is None else ((joined(a, b) - PAIR) << ABOVE) + a for a in octets[:-1] for b in octets]


class Vocabulary:
    """Expressions over the ranks of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        # Java's \\s knows Unicode white space only under this flag.
        self.pattern = "(?U)" + pattern
        self.ranks = ranks
        if max(ranks.values(), default=0) >= PAIR - 1:
            raise ValueError(f"ids must be below {PAIR - 1}")
        # Tokens of more than FOLDED bytes are never folded; they are met in ``merged`` only.
        reached = lambda word, rank: all(bytes([b]) in ranks for b in word) and joined(word, ranks) == [rank]
        apart = {word.decode("latin-1"): rank for word, rank in ranks.items() if len(word) <= FOLDED and not reached(word, rank)}
        self.whole = _literal(apart, WORD_MAPS, "int") if apart else None
        pairs = pair_ids(ranks)
        slots, self.first, self.second = placed(pairs)
        # Behind the pairs, the cells that a fold begins with, by the bytes of a place and its right neighbour.
        self.start, self.slots = len(slots), slots + first_cells(ranks, pairs)
        hexes = [""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            hexes[rank] = word.hex()
        self.hexes = hexes

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def folded(self, word: Column, pairs: Column | None = None) -> Column:
        """The ids of one word; ``pairs`` is ``slots`` as a column, else a literal."""
        if pairs is None:
            literal = F.from_json(F.lit(json.dumps(self.slots, separators=(",", ":"))), "array<bigint>")
            return _let(literal, lambda pairs: self.folded(word, pairs))

        def found(latin: Column) -> Column:
            by_merges = self._merged(latin, pairs)
            if self.whole is None:
                return by_merges
            return _let(_looked_up(self.whole, WORD_MAPS, latin), lambda rank: F.when(rank.isNotNull(), F.array(rank)).otherwise(by_merges))

        return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), found)

    def _merged(self, latin: Column, pairs: Column) -> Column:
        """The ids that merges give for bytes, as a fold over the steps."""
        # A cell is the id of a place and, above room for that place, what it and its right neighbour
        # join to. With the places added, the least cell is the leftmost pair of least rank
        # (array_position unwinds by an exception, which is slow).
        above, bits = ABOVE, BITS
        id_of = lambda cell: cell.bitwiseAND(F.lit(PAIR - 1))

        def cell(pair: Column) -> Column:
            """The cell of the left one of two neighbours."""
            rank = lambda x, other: F.when(F.shiftright(x, bits) == pair, x.bitwiseAND(F.lit(PAIR - 1))).otherwise(other)
            slot = lambda place: F.get(pairs, place.cast("int"))
            second = _let(slot(pair % self.second + self.first), lambda x: rank(x, F.lit(PAIR).cast("long")))
            joined = _let(slot(pair % self.first), lambda x: rank(x, F.when(x < 0, F.lit(PAIR).cast("long")).otherwise(second)))
            return F.shiftleft(joined, above) + F.shiftright(pair, bits)

        def join(cells: Column, id_: Column, at: Column) -> Column:
            two = F.array(id_of(F.get(cells, at - 1)) * PAIR + id_, id_ * PAIR + F.coalesce(id_of(F.get(cells, at + 2)), F.lit(PAIR - 1)))
            return F.flatten(F.array(F.slice(cells, F.lit(1), at - 1), F.transform(two, cell), F.slice(cells, at + 3, F.lit(MOST))))

        def step(cells: Column) -> Column:
            least = F.array_min(F.transform(cells, lambda c, i: c + F.shiftleft(i.cast("long"), bits)))
            split = lambda x: join(cells, F.shiftright(x, above), F.shiftright(x, bits).bitwiseAND(F.lit(MOST - 1)).cast("int"))
            # Once nothing joins, the mark in front becomes -1, and later steps do nothing.
            ended = F.concat(F.array(F.lit(-1).cast("long")), F.slice(cells, 2, MOST))
            return F.when(F.get(cells, F.lit(0)) < 0, cells).otherwise(_let(least, lambda x: F.when(x < PAIR << above, split(x)).otherwise(ended)))

        # A mark before the first id and after the last, which no pair has, so that every place has a neighbour on either side.
        alone = F.lit(PAIR << above).cast("long")
        # Two bytes name their cell, so that no pair is looked for before the first step.
        begun = lambda a, b: F.get(pairs, a * 257 + F.coalesce(b, F.lit(256)) + self.start) + alone
        start = _let(F.transform(F.split(latin, ""), F.ascii), lambda x: F.concat(F.array(alone + (PAIR - 1)), F.transform(x, lambda a, i: begun(a, F.get(x, i + 1)))))
        steps = F.sequence(F.lit(2), F.greatest(F.length(latin), F.lit(2)))
        return F.aggregate(steps, start, lambda cells, _: step(cells), lambda cells: F.transform(F.slice(cells, 2, MOST), lambda c: id_of(c).cast("int")))

    def decoded(self, ids: Column, hexes: Column | None = None) -> Column:
        """The bytes of the ids, concatenated; ``hexes`` is that attribute as a column, else a literal."""
        hexes = F.split(F.lit(",".join(self.hexes)), ",") if hexes is None else hexes
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), ""))


def _split(documents: DataFrame, vocabulary: Vocabulary, text: str, keep: dict[str, str]) -> DataFrame:
    """The kept columns under new names and each text with its words marked, or, where it holds the mark itself, their array."""
    whole = F.coalesce(documents[f"`{text}`"], F.lit(""))
    has = F.contains(whole, F.lit(MARK))
    marked = F.when(~has, F.regexp_replace(whole, vocabulary.pattern, f"{MARK}$0{MARK}"))
    kept = [documents[f"`{c}`"].alias(name) for c, name in keep.items()]
    return documents.select(*kept, marked.alias("marked_"), F.when(has, vocabulary.words(whole)).alias("words_"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Consecutive rows of a batch with at most ``PART`` bytes of marked text together (or one row), and their words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("marked_")), PART).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        part = batch.slice(at, stop - at)
        yield part, _words(part.column("marked_"), part.column("words_"))
        at = stop


def _words(marked: pa.Array, plain: pa.Array) -> pa.ListArray:
    """The words of each text: every second piece between marks, or the given array."""
    pieces = pc.split_pattern(pc.fill_null(marked, ""), MARK)
    sizes = pc.list_value_length(pieces).to_numpy(zero_copy_only=False) // 2
    text = np.repeat(np.arange(len(sizes)), sizes)
    edges = np.append(0, np.cumsum(sizes)).astype(np.int32)
    # A text has one piece more than twice its words.
    values = pieces.flatten().take(pa.array(2 * np.arange(len(text)) + 1 + text))
    words = pa.ListArray.from_arrays(pa.array(edges), values)
    if plain.null_count == len(plain):
        return words
    given = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(plain), 0).to_numpy(zero_copy_only=False))).astype(np.int32)), plain.flatten())
    row = np.arange(len(plain))
    return pa.concat_arrays([words, given]).take(pa.array(np.where(plain.is_null().to_numpy(zero_copy_only=False), row, row + len(row))))


def word_counts(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(word, count) over all texts; batches and tasks add up what they have read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _parts(batch):
                counted = pc.value_counts(words.flatten())
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "count"])

    return _split(documents, vocabulary, text, {}).mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def frequent_words(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", number: int = FREQUENT) -> pa.Table:
    """Ids of the most frequent words: at most ``number`` words of at most ``LONGEST`` characters."""
    counts = staged(word_counts(documents, vocabulary, text).where(F.length("word") <= LONGEST), "word-counts")
    steps = counts.groupBy("count").agg(F.count("*").alias("words"))
    # One row per power of two; the words with at least the chosen count fit.
    sizes = steps.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.sum("words").alias("words")).collect()
    least, total = 1 << 62, 0
    for power, words in sorted(sizes, reverse=True):
        if total + words > number:
            within = steps.where(F.floor(F.log2("count")) == power).orderBy(F.desc("count")).limit(number).collect() if power < 20 else []
            for count, some in within:
                if total + some > number:
                    break
                least, total = count, total + some
            break
        least, total = 1 << power, total + words
    chosen = counts.where(F.col("count") >= least)
    # As many tasks as set: the rows are small, but folding them is the work.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(with_table(chosen.repartition(tasks, "word").select("word"), vocabulary.slots, pa.int64()).select("word", _let(F.col("table_"), lambda pairs: vocabulary.folded(F.col("word"), pairs)).alias("ids")), "frequent-words").toArrow()


def _marked(words: pa.Array, known: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Per text its pieces, and its other words.

    A piece is a run of ids of known words, or one number that stands for another word; those
    count from -1 down. Works on the distinct words of the batch, then lays their ids out by
    array arithmetic.
    """
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(words)), sizes)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    place = pc.index_in(coded.dictionary, value_set=known["word"]).fill_null(-1).to_numpy(zero_copy_only=False)[code]
    ids = known["ids"].combine_chunks()
    flat, bounds = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    # Other words: numbered within their text, one placeholder each.
    missing = np.flatnonzero(place < 0)
    pair, back = np.unique(np.stack([text[missing], code[missing]]), axis=1, return_inverse=True)
    first = np.searchsorted(pair[0], np.arange(len(words) + 1))
    number = np.arange(pair.shape[1]) - first[pair[0]]
    start = np.append(bounds, 0)[place]
    length = np.where(place < 0, 1, np.append(bounds, 0)[place + 1] - start) if len(place) else np.zeros(0, int)
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)
    out = np.append(flat, 0)[np.minimum(at, len(flat))].astype(np.int32)
    alone = (ends - length)[missing]
    out[alone] = -1 - number[back.ravel()]
    edges = np.append(0, ends)[np.append(0, np.cumsum(sizes))]  # of the texts, among the ids
    cuts = np.unique(np.concatenate([alone, alone + 1, edges]))
    others = pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded.dictionary.take(pa.array(pair[1])))
    pieces = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, edges), pa.int32()), pieces), others


def _long(words: pa.Array, ranks: dict[bytes, int], known: pa.Table) -> pa.Table:
    """The known words and those of the batch that are too long to fold."""
    flat = words.flatten()
    rare = pc.unique(flat.filter(pc.greater(pc.binary_length(flat), FOLDED)))
    if not len(rare):
        return known
    return pa.concat_tables([known, pa.table({"word": rare, "ids": [merged(w.encode(), ranks) for w in rare.to_pylist()]}, known.schema)])


def encoded(documents: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None, text: str = "text", number: int = FREQUENT) -> DataFrame:
    """The kept columns and ``ids``, the array of token ids of each text."""
    known = documents.sparkSession.sparkContext.broadcast((frequent_words(documents, vocabulary, text, number), vocabulary.ranks))
    names = [c for c in (documents.columns if keep is None else keep) if c != "ids"]
    inner = [f"c{i}" for i in range(len(names))]
    split = _split(documents, vocabulary, text, dict(zip(names, inner, strict=True)))
    fields = [StructField("pieces", ArrayType(ArrayType(IntegerType()))), StructField("other_words", ArrayType(StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks = known.value
        for batch in batches:
            for part, words in _parts(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inner), *_marked(words, _long(words, ranks, table))], [*inner, "pieces", "other_words"])

    marked = split.mapInArrow(run, StructType([*(f for f in split.schema.fields if f.name not in ("marked_", "words_")), *fields]))
    folded = F.struct("pieces", _let(F.col("table_"), lambda pairs: F.transform("other_words", lambda word: vocabulary.folded(word, pairs))).alias("words"))
    # Bound to a name, so that the fold runs once per text and not once per piece.
    place = lambda x: F.flatten(F.transform(x["pieces"], lambda p: F.when(F.get(p, F.lit(0)) >= 0, p).otherwise(F.get(x["words"], -1 - F.get(p, F.lit(0))))))
    ids = F.when(F.size("other_words") == 0, F.flatten("pieces")).otherwise(F.get(F.transform(F.array(folded), place), F.lit(0)))
    return with_table(marked, vocabulary.slots, pa.int64()).select(*inner, ids.alias("ids")).toDF(*names, "ids")


#: Ids that are hashed at a time.
HASHED = 1 << 18


def digest(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The contracted columns of the registered query, hashed in Arrow batches from the ids."""
    # Written, so that a task runs one Python worker at a time and not two.
    found = staged(encoded(documents, vocabulary, keep=["doc_id"]), "token-ids")
    pieces = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for word, rank in vocabulary.ranks.items():
        pieces[rank] = word
    # Each id as decimal digits and a comma, and each id's bytes.
    shared = documents.sparkSession.sparkContext.broadcast((pa.array([b"%d," % i for i in range(len(pieces))], pa.binary()), pa.array(pieces, pa.binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges, flat = lists.offsets.to_numpy(), lists.values
            hashes = [[hashlib.sha256() for _ in range(len(lists))] for _ in (0, 1)]
            row = 0
            for at in range(int(edges[0]), int(edges[-1]), HASHED):
                stop = min(int(edges[-1]), at + HASHED)
                # Taken bytes lie side by side, so those of a text are one slice of them.
                taken = [values.take(flat.slice(at, stop - at)) for values in shared.value]
                bounds = [np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1] for t in taken]
                data = [memoryview(t.buffers()[2]) if t.buffers()[2] else memoryview(b"") for t in taken]
                while row < len(lists) and edges[row] < stop:
                    a, b = max(at, int(edges[row])) - at, min(stop, int(edges[row + 1])) - at
                    last = edges[row + 1] <= stop
                    if b > a:
                        # No comma after the last id of a text.
                        hashes[0][row].update(data[0][int(bounds[0][a]) : int(bounds[0][b]) - int(last)])
                        hashes[1][row].update(data[1][int(bounds[1][a]) : int(bounds[1][b])])
                    if not last:
                        break
                    row += 1
            sums = [pa.array([h.hexdigest() for h in some], pa.string()) for some in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges).astype(np.int64)), *sums], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return found.mapInArrow(run, StructType([found.schema["doc_id"], *kinds]))
