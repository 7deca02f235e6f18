"""Conversation repair against the enumeration of all edits and a plain reading of the rules."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.llm import audit_dp
from worklens.llm import conversation_repair as repair

RIGHT = re.compile("(s?(ua)+)?")


def enumerated(rows):
    """Cheapest cost and least audit of (initial, kind) rows, by trying all edits."""
    best = [2 * len(rows), "D" * len(rows)]

    def go(i, roles, cost, audit, inserted):
        if cost > best[0]:
            return
        if i == len(rows) and RIGHT.fullmatch(roles) and (cost, audit) < tuple(best):
            best[:] = cost, audit
        if inserted < 3:
            for role in "ua":
                go(i, roles + role, cost + 5, audit + "I", inserted + 1)
        if i < len(rows):
            initial, kind = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if kind != audit_dp.GONE:
                extra = 5 * (kind == audit_dp.TRUNCATED)
                if initial:
                    go(i + 1, roles + initial, cost + extra, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 1 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return tuple(best)


def drawn(rng, size):
    return [(str(rng.choice(["s", "u", "a", "t", ""], p=[0.15, 0.4, 0.35, 0.05, 0.05])), int(rng.choice(3, p=[0.7, 0.15, 0.15]))) for _ in range(size)]


@pytest.mark.parametrize("prime", [audit_dp._PRIME, 3])
def test_dp_equals_enumeration_also_with_colliding_hashes(prime):
    rng = np.random.default_rng(1)
    for _ in range(250):
        rows = drawn(rng, int(rng.integers(0, 7)))
        assert audit_dp.cheapest(rows, prime=prime)[:2] == enumerated(rows)


def plain(rows):
    """Cost and audit by a DP over whole strings."""
    best = {0: (0, "")}

    def add(table, state, value):
        table[state] = min(table.get(state, (audit_dp.FAR, "")), value)

    def inserts(table):
        for _ in range(2):
            for state, (c, a) in list(table.items()):
                add(table, audit_dp.WRITTEN[state], (c + 5, a + "I"))
        return table

    for initial, kind in rows:
        new = {}
        for state, (c, a) in inserts(best).items():
            for to, price, letter in audit_dp._moves(state, initial, kind):
                add(new, to, (c + price, a + letter))
        best = new
    return min(v for s, v in inserts(best).items() if s in (0, 3))


def test_long_runs_with_many_ties():
    rng = np.random.default_rng(2)
    for rows in (drawn(rng, 700), [("u", 0)] * 900, [("a", 0), ("a", 0), ("u", 1)] * 300, [("s", 0)] * 400):
        assert audit_dp.cheapest(rows)[:2] == plain(rows)


def expected(conversations):
    """The contract row by row."""
    space, out = " \t\n\v\f\r", []
    none = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, text in conversations:
        rows = groups.setdefault(conv, [])
        draw = zlib.crc32(f"{none(conv)}:{none(turn)}".encode()) % 20
        role, text = none(role), none(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        rows += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.rstrip(space)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            kinds.append((role[:1], {None: 0, 0: 2, 1: 2, 2: 1}[fault]))
        cost, audit = plain(kinds)
        turns, at, roles = [], 0, ""
        for letter in audit:
            row = None
            if letter != "I":
                row = rows[at]
                at += 1
            if letter == "D":
                continue
            if letter == "K":
                turns.append((row[1], row[2]))
                roles += row[1][:1]
            else:
                role = "assistant" if roles.endswith("u") else "user"
                roles += role[0]
                turns.append((role, row[2] if row else ""))
        assert RIGHT.fullmatch(roles)
        known = {r[0] for r in rows if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng):
    texts = ["Yes.", "No", "Why?", "", " \n", "Go on!", "one two three.\n", "é...", "Yes.", "end without"]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 12))):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else str(rng.choice(["system", "tool", "", "user"]))
            rows.append((conv, int(turn + (rng.random() < 0.1)), role, f"{turn} " * bool(rng.integers(2)) + str(rng.choice(texts))))
    rows += [(900, t, ["user", "assistant", "assistant"][t % 3], f"{t % 41} says.") for t in range(300)]
    rows += [(None, 1, "user", "Null id."), (None, None, None, None), (None, 2, "assistant", "Yes."), (901, None, "user", None), (901, None, "user", "Hm."), (902, 5, None, "Role?"), (903, 0, "user", "Same."), (903, 0, "user", "Same.")]
    rows += [(1000 + i, 0, "user", "dropped or not.") for i in range(40)]
    return rows


@pytest.mark.parametrize("bits", [12, 3])
def test_report_equals_the_rules(spark, bits):
    rows = talk(np.random.default_rng(3))
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, cost string").repartition(4)
    got = sorted(map(tuple, repair.report(frame, repair.damaged(frame), bits).collect()), key=str)
    assert got == expected(rows)
    assert repair.report(frame.limit(0), repair.damaged(frame.limit(0)), bits).collect() == []


def test_repaired_turns_are_those_of_the_hash(spark):
    rows = talk(np.random.default_rng(4))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    laid = repair.staged(repair.ordered(frame, 4), "laid")
    found = repair.staged(repair.edits(laid), "found")
    turns = repair.repaired(laid, found)
    joined = turns.groupBy("key").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256).alias("h"))
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in repair.hashes(laid, found).collect()}
    roles = turns.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda t: F.substring(t["role"], 1, 1)), "").alias("r"))
    assert roles.where(~F.col("r").rlike("^(s?(ua)+)?$")).isEmpty()


def test_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.digest(frame).collect()), key=str) == expected(rows)
