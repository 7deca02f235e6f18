"""Conversation structure repair: faults, cheapest edits, repaired turns.

Rows are put in order of conversation and turn (nulls first; rows of one turn by the SHA-256
of role and text) over range partitions, so that a conversation of any size lies in several.
``CHUNK`` consecutive rows are a chunk. Edits are found by worklens.llm.audit_dp:

- a conversation within one chunk is edited there, from beginning to end;
- one that several chunks share first gets the cheapest costs between all states of every
  chunk; from the last chunk back these give the cost of what follows each; then every chunk
  finds its audit for every state it may begin in, knowing what follows, and the states are
  chained. Only the small tables of costs and states meet in one task.

Duplicates are rows whose role and text, compared by SHA-256, stand earlier: within a chunk by
a set, over chunks by the first chunk of each text. Repaired turns are streamed through one
task per conversation, in order, since a hash of the whole repaired text can be had no other
way; a task holds one batch of rows and one chunk's audit.

Null roles and texts are one space; a null conv_id is a conversation of its own; a null turn
takes part, but not in ``gaps``. A role without an initial can't be kept. Repeated rows are
duplicates of each other. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm import audit_dp
from worklens.llm.staging import staged

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12

SPACE = r"[\x20\x09-\x0D]"
EDITS = "key string, chunk long, audits array<string>, exits array<int>, costs array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string"


def key_of(conv_id: Column) -> Column:
    """The conversation as a string; null is one space."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: ``conv_id, turn, role, text`` after it."""
    c = conversations.select("conv_id", "turn", *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    draw = F.crc32(F.concat(key_of(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1)))
    return c.where(draw != 0).select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy_")).drop("copy_")


def ordered(rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """The rows with their place ``at`` in the order of all conversations, their chunk and what can be said of a row alone."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    named = rows.select(key_of(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    order = ("key", "turn", "same")
    laid = named.withColumn("same", same).repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition number, then row number: the order of the rows. One stage with the sort.
    at = laid.withColumn("at", F.monotonically_increasing_id())
    return at.select(
        "key",
        "turn",
        "role",
        "text",
        "same",
        "at",
        F.shiftright("at", bits).alias("chunk"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("cut"),
    )


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Consecutive rows of one value of ``names``, over batches, as lists by column."""
    held: list[pa.RecordBatch] = []

    def whole() -> dict[str, list]:
        return pa.Table.from_batches(held).to_pydict()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        starts = [i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else last)]
        if held and (not starts or starts[0] > 0):
            held.append(batch.slice(0, starts[0] if starts else len(keys)))
        for i, start in enumerate(starts):
            if held:
                yield whole()
            stop = starts[i + 1] if i + 1 < len(starts) else len(keys)
            held = [batch.slice(start, stop - start)]
        last = keys[-1]
    if held:
        yield whole()


def _kinds(run: dict[str, list]) -> tuple[list[tuple[str, int]], list[int]]:
    """Initial and kind of each row, and how many are blank, duplicate and truncated."""
    seen, rows, counts = set(), [], [0, 0, 0]
    for initial, blank, cut, same, earlier in zip(*(run[n] for n in ("initial", "blank", "cut", "same", "earlier")), strict=True):
        fault = 0 if blank else 1 if earlier or same in seen else 2 if cut else None
        seen.add(same)
        if fault is not None:
            counts[fault] += 1
        rows.append((initial, audit_dp.WHOLE if fault is None else audit_dp.TRUNCATED if fault == 2 else audit_dp.GONE))
    return rows, counts


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each chunk: for every state it may begin in if ``after`` is given, else from nothing to an end."""
    out: list[dict] = []
    for run in _runs(batches, ("key", "chunk")):
        rows, counts = _kinds(run)
        after, last = run["after"][0], run["last"][0]
        found = [audit_dp.cheapest(rows, e, after or audit_dp.END, last) for e in (range(4) if after else (0,))]
        costs, audits, exits = map(list, zip(*found, strict=True))
        head, tail = run["initial"][0], run["initial"][-1]
        out.append({"key": run["key"][0], "chunk": run["chunk"][0], "audits": audits, "exits": exits, "costs": costs, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": _illegal(run["initial"]), "head": head, "tail": tail})
        if len(out) >= 1000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


_EDITS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_EDITS)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cheapest costs of each chunk between all states."""
    for run in _runs(batches, ("key", "chunk")):
        matrix = audit_dp.costs(_kinds(run)[0], run["last"][0])
        yield pa.RecordBatch.from_pydict({"key": run["key"][:1], "chunk": run["chunk"][:1], "costs": pa.array([sum(matrix, [])], pa.list_(pa.int64()))})


def _follows(table: pa.Table) -> pa.Table:
    """Per chunk of a conversation, the cost of what follows it, by state."""
    table = table.sort_by([("chunk", "descending")])
    after, out = list(audit_dp.END), []
    for matrix in table["costs"].to_pylist():
        out.append(after)
        after = [min(min(c + a, audit_dp.FAR) for c, a in zip(matrix[4 * e : 4 * e + 4], after, strict=True)) for e in range(4)]
    return pa.table({"key": table["key"], "chunk": table["chunk"], "after": pa.array(out, pa.list_(pa.int64()))})


def _chained(table: pa.Table) -> pa.Table:
    """Per chunk of a conversation, the state it begins in, and whether its border is illegal."""
    table = table.sort_by([("chunk", "ascending")])
    state, tail, entries, borders = audit_dp.NOTHING, None, [], []
    for exits, head, last in zip(table["exits"].to_pylist(), table["head"].to_pylist(), table["tail"].to_pylist(), strict=True):
        entries.append(state)
        borders.append(0 if tail is None else _illegal([tail, head]))
        state, tail = exits[state], last
    return pa.table({"key": table["key"], "chunk": table["chunk"], "entry": pa.array(entries, pa.int32()), "border": pa.array(borders, pa.int64())})


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "at")


def edits(rows: DataFrame) -> DataFrame:
    """Per chunk of ``ordered`` rows: its audit, the state it begins in, cost and faults."""
    thin = rows.select("key", "chunk", "at", "initial", "blank", "cut", "same")
    shared = staged(thin.groupBy("key").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select("key", "high"), "shared")
    none = F.lit(None).cast("array<bigint>")
    single = thin.join(shared, "key", "left_anti").select("*", F.lit(False).alias("earlier"), F.lit(True).alias("last"), none.alias("after"))
    several = thin.join(shared, "key")
    first = several.where("not blank").groupBy("key", "same").agg(F.min("chunk").alias("first"))
    several = staged(several.join(first, ["key", "same"], "left").select(*thin.columns, F.coalesce(F.col("first") < F.col("chunk"), F.lit(False)).alias("earlier"), (F.col("chunk") == F.col("high")).alias("last")), "several")
    between = _by_chunk(several).mapInArrow(_between, "key string, chunk long, costs array<long>")
    after = staged(between.groupBy("key").applyInArrow(_follows, "key string, chunk long, after array<long>"), "after")
    both = single.unionByName(several.join(after, ["key", "chunk"]).select(*single.columns))
    found = staged(_by_chunk(both).mapInArrow(_edited, EDITS), "edits")
    many = found.where(F.size("exits") > 1)
    chain = many.select("key", "chunk", "exits", "head", "tail").groupBy("key").applyInArrow(_chained, "key string, chunk long, entry int, border long")
    return found.join(staged(chain, "chain"), ["key", "chunk"], "left").select(
        "key",
        "chunk",
        F.coalesce("entry", F.lit(0)).alias("entry"),
        F.get("audits", F.coalesce("entry", F.lit(0))).alias("audit"),
        F.get("costs", F.coalesce("entry", F.lit(0))).alias("cost"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + F.coalesce("border", F.lit(0))).alias("illegal"),
    )


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str]]:
    """(key, letter, role, text) of every turn that the edits leave, in order.

    Rows come by key and chunk; the first of each chunk carries its audit.
    """
    audit, place, state, key = "", 0, 0, ""

    def turn(letter: str, role: str, text: str) -> tuple[str, str, str, str]:
        nonlocal state
        if letter == "K" and state == audit_dp.NOTHING and role[:1] == "s":
            state = audit_dp.S
        else:
            state = audit_dp.WRITTEN[state]
            if letter != "K":
                role = "user" if state == audit_dp.U else "assistant"
        return key, letter, role, text

    for batch in batches:
        for new_key, edit, entry, role, text in zip(*(batch.column(n).to_pylist() for n in ("key", "audit", "entry", "role", "text")), strict=True):
            if edit is not None:
                while place < len(audit):  # insertions at the end
                    place += 1
                    yield turn("I", "", "")
                key, audit, place, state = new_key, edit, 0, entry
                continue
            while audit[place] == "I":
                place += 1
                yield turn("I", "", "")
            place += 1
            if audit[place - 1] != "D":
                yield turn(audit[place - 1], role, text)
    while place < len(audit):
        place += 1
        yield turn("I", "", "")


def _laid_out(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows of each conversation in order, an audit before the rows of its chunk."""
    none = lambda kind: F.lit(None).cast(kind)
    audits = found.select("key", "chunk", F.lit(-1).cast("long").alias("at"), "audit", "entry", none("string").alias("role"), none("string").alias("text"))
    turns = rows.select("key", "chunk", "at", none("string").alias("audit"), none("int").alias("entry"), "role", "text")
    return audits.unionByName(turns).repartition("key").sortWithinPartitions("key", "chunk", "at").select("key", "audit", "entry", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that the edits leave: ``key, place, edit, role, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, last, place = ("key", "place", "edit", "role", "text"), [], None, 0
        for key, letter, role, text in _written(batches):
            place = place + 1 if key == last else 0
            last = key
            out.append((key, place, letter, role, text))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return _laid_out(rows, found).mapInArrow(run, "key string, place long, edit string, role string, text string")


def hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of conversations with a turn left: ``role:text`` of its turns, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, done = None, None, []
        for key, _, role, text in _written(batches):
            if key != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if last is not None:
            done.append((last, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "repaired_sha256": [d for _, d in done]})

    return _laid_out(rows, found).mapInArrow(run, "key string, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """One row per conversation of ``conversations``: faults, cost and edits of its ``rows``, and the hash of what they leave."""
    laid = staged(ordered(rows, bits), "ordered")
    found = staged(edits(laid), "chosen")
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    totals = found.groupBy("key").agg(*sums, audit.alias("audit"))
    turns = laid.where("turn is not null").select("key", "turn").distinct()
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    ids = conversations.select("conv_id", key_of(F.col("conv_id")).alias("key")).distinct()
    joined = ids.join(totals, "key", "left").join(gaps, "key", "left").join(hashes(laid, found), "key", "left")
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *(zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The contracted columns of the registered query: the table is damaged, then repaired."""
    return report(conversations, damaged(conversations))
