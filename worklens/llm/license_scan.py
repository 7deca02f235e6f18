"""License scan: ordered signature rules behind a keyword prefilter, in Spark expressions only.

A text is lower-cased (A-Z) and reduced to words with one space between them. A text in which
no gate of a rule occurs ends here: it has no detection. In the others each word
that may start a rule opens a window of ``WINDOW`` words; of the rules with that trigger,
those with a keyword in the window are matched at its start. Nothing is shuffled, and the
work grows with the number of words and triggers, not with the square of either.

Overlapping detections are resolved from left to right, in order of start, then longer
first, then priority, then place in the rule list. A detection that lies within the one
kept before goes (interval containment). Of two that overlap otherwise the one with the
better priority stays, of equal priority the first. Base phrases are counted and labelled
whether or not they are suppressed.

Columns: ``n_words``; ``base`` (every place of a base phrase: start, stop, label);
``detections`` (what is kept: start, stop, label, rule, priority, confidence). Starts count
words from 0, stops are exclusive. Null text counts as empty: no words, empty lists. Null
ids, repeated rows and empty tables are results like any other; a kept column that has the
name of a new one gives way to it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.license_rules import RULES

#: Words that a rule can span.
WINDOW = 40
#: Detections kept before they are set aside, so that a fold does not copy all of them at each step.
RUN = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "struct<no:int,label:string,rule:string,pattern:string,keywords:array<string>,priority:int,confidence:double>"
FOUND = "struct<start:bigint,stop:bigint,label:string,rule:string,priority:int,confidence:double,no:int>"


def _groups() -> tuple[dict[str, int], list[list[dict]]]:
    """The group of rules of every trigger word."""
    by_word: dict[str, list[int]] = {}
    for no, rule in enumerate(RULES):
        for word in rule.triggers:
            by_word.setdefault(word, []).append(no)
    numbers = {rules: i for i, rules in enumerate(dict.fromkeys(map(tuple, by_word.values())))}
    field = lambda no: {"no": no, "label": RULES[no].label, "rule": RULES[no].name, "pattern": f"^(?:{RULES[no].pattern}) ", "keywords": RULES[no].keywords, "priority": RULES[no].priority, "confidence": RULES[no].confidence}
    return {w: numbers[tuple(r)] for w, r in by_word.items()}, [[field(no) for no in rules] for rules in numbers]


def gate() -> str:
    """One pattern for the gates of all rules; each starts with a space, which is looked for once."""
    every = {g for rule in RULES for g in rule.gates}
    needed = sorted(g for g in every if not any(g != o and g.startswith(o) for o in every))
    return f" (?:{'|'.join(g[1:] for g in needed)})"


def _single_spaced(text: Column) -> Column:
    # lower() is much faster than translate(). Of the letters beyond A-Z it turns one, the
    # Kelvin sign, into an ASCII letter; that one is put out of its way.
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " ")


def _detected(words: Column) -> Column:
    """Every match of a rule, by place and then by place in the rule list."""
    triggers, groups = _groups()
    literal = F.from_json(F.lit(json.dumps(groups)), f"array<array<{RULE}>>")
    group_of = F.from_json(F.lit(json.dumps(triggers)), "map<string,int>")
    opened = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.try_element_at(group_of, w).alias("group"))), lambda x: x["group"].isNotNull())

    def matched(at: Column, window: Column, rules: Column) -> Column:
        near = F.filter(rules, lambda r: F.exists(r["keywords"], lambda k: F.contains(window, k)))

        def found(r: Column) -> Column:
            length = F.regexp_count(F.regexp_substr(F.substring(window, 2, 1 << 30), r["pattern"]), F.lit(" "))
            return F.struct(at.cast("long").alias("start"), (at + length).cast("long").alias("stop"), r["label"].alias("label"), r["rule"].alias("rule"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["no"].alias("no"))

        return F.filter(F.transform(near, found), lambda d: d["stop"] > d["start"])

    window = lambda x: F.concat(F.lit(" "), F.array_join(F.slice(words, x["at"] + 1, WINDOW), " "), F.lit(" "))
    return F.flatten(F.transform(opened, lambda x: F.flatten(F.transform(F.array(window(x)), lambda w: matched(x["at"], w, F.get(literal, x["group"]))))))


def _kept(found: Column) -> Column:
    """What the resolution of overlaps leaves, by place."""
    order = F.struct
    by_place = F.transform(F.array_sort(F.transform(found, lambda d: order(d["start"].alias("a"), (-d["stop"]).alias("b"), d["priority"].alias("c"), d["no"].alias("d"), d.alias("found")))), lambda x: x["found"])
    none = F.lit(None).cast(FOUND)
    empty = F.array().cast(f"array<{FOUND}>")

    def state(done: Column, open_: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), last.alias("last"))

    def step(s: Column, d: Column) -> Column:
        apart = s["last"].isNull() | (d["start"] >= s["last"]["stop"])
        better = (d["stop"] > s["last"]["stop"]) & (d["priority"] < s["last"]["priority"])
        closed = F.when(s["last"].isNull(), s["open"]).otherwise(F.concat(s["open"], F.array(s["last"])))
        moved = F.when(F.size(s["open"]) < RUN, state(s["done"], closed, d)).otherwise(state(F.concat(s["done"], F.array(closed)), empty, d))
        return F.when(apart, moved).when(better, state(s["done"], s["open"], d)).otherwise(s)

    def end(s: Column) -> Column:
        return F.flatten(F.concat(s["done"], F.array(s["open"]), F.when(s["last"].isNull(), F.array().cast(f"array<array<{FOUND}>>")).otherwise(F.array(F.array(s["last"])))))

    return F.aggregate(by_place, state(F.array().cast(f"array<array<{FOUND}>>"), empty, none), step, end)


def licenses(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, if not named) with ``n_words``, ``base`` and ``detections``."""
    new = ("n_words", "base", "detections")
    names = [c for c in (documents.columns if keep is None else keep) if c not in new]
    inner = [f"c{i}" for i in range(len(names))]
    rows = documents.select(*[documents[f"`{c}`"].alias(i) for c, i in zip(names, inner, strict=True)], _single_spaced(documents[f"`{text}`"]).alias("spaced"))
    # The words between the first and the last space.
    words = F.split(F.expr("substring(spaced, 2, length(spaced) - 2)"), " ")
    spaces = F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit("")))
    gated = rows.select(*inner, (spaces - 1).cast("long").alias("n_words"), F.when(F.col("spaced").rlike(gate()), words).alias("words"))
    found = gated.select(*inner, "n_words", F.when(F.col("words").isNotNull(), _detected(F.col("words"))).alias("found"))
    place = "struct<start:bigint,stop:bigint,label:string>"
    base = F.transform(F.filter("found", lambda d: d["priority"] == 0), lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["label"].alias("label")))
    kept = F.transform(_kept(F.col("found")), lambda d: d.dropFields("no"))
    fields = FOUND.replace(",no:int", "")
    out = found.select(
        *inner,
        "n_words",
        F.coalesce(base, F.array().cast(f"array<{place}>")).alias("base"),
        F.coalesce(F.when(F.size("found") > 0, kept), F.array().cast(f"array<{fields}>")).alias("detections"),
    )
    return out.toDF(*names, *new)


def digest(documents: DataFrame) -> DataFrame:
    """The contracted columns of the registered query; ``score`` is the best confidence kept, 0 without any."""
    found = licenses(documents, keep=["doc_id"])
    label = lambda column: F.transform(column, lambda d: d["label"])
    starts = F.transform("base", lambda d: d["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(label("base")).alias("base_labels"),
        joined(F.concat(label("base"), label("detections"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """DuckDB SQL of the same result, with joins on a table of rules and a recursive walk over the detections."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(
        f"({no}, {quoted(r.label)}, [{', '.join(map(quoted, r.triggers))}], {quoted(f'^(?:{r.pattern}) ')}, [{', '.join(map(quoted, r.keywords))}], {r.priority}, {r.confidence})" for no, r in enumerate(RULES)
    )
    return rf"""
WITH RECURSIVE rules AS (
  SELECT no, label, unnest(triggers) AS starter, pattern, keywords, priority, confidence
  FROM (VALUES {rules}) AS t(no, label, triggers, pattern, keywords, priority, confidence)),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
spots AS (
  SELECT r, words, unnest(range(len(words))) AS spot FROM texts),
opened AS (
  SELECT r, spot, g.*, ' ' || array_to_string(list_slice(words, spot + 1, spot + {WINDOW}), ' ') || ' ' AS around
  FROM spots JOIN rules g ON words[spot + 1] = g.starter),
found AS (
  SELECT r, spot AS start, label, priority, confidence, no,
         spot + len(string_split(regexp_extract(substr(around, 2), pattern), ' ')) - 1 AS stop
  FROM opened WHERE len(list_filter(keywords, lambda k: contains(around, k))) > 0 AND regexp_matches(substr(around, 2), pattern)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY start, stop DESC, priority, no) AS k FROM found),
walk AS (
  SELECT r, k, start, stop, priority, no FROM placed WHERE k = 1
  UNION ALL
  SELECT p.r, p.k,
         CASE WHEN p.start >= w.stop OR (p.stop > w.stop AND p.priority < w.priority) THEN p.start ELSE w.start END,
         CASE WHEN p.start >= w.stop OR (p.stop > w.stop AND p.priority < w.priority) THEN p.stop ELSE w.stop END,
         CASE WHEN p.start >= w.stop OR (p.stop > w.stop AND p.priority < w.priority) THEN p.priority ELSE w.priority END,
         CASE WHEN p.start >= w.stop OR (p.stop > w.stop AND p.priority < w.priority) THEN p.no ELSE w.no END
  FROM walk w JOIN placed p ON p.r = w.r AND p.k = w.k + 1),
-- The detection held at a step is kept if the next one starts at or after its stop, or if there is none.
last_held AS (
  SELECT w.r, w.start, w.no FROM walk w LEFT JOIN placed p ON p.r = w.r AND p.k = w.k + 1 WHERE p.k IS NULL OR p.start >= w.stop),
kept AS (SELECT f.r, f.label, f.confidence FROM last_held h JOIN found f ON f.r = h.r AND f.start = h.start AND f.no = h.no),
base AS (SELECT r, start, label FROM found WHERE priority = 0),
all_labels AS (SELECT r, label FROM kept UNION SELECT r, label FROM base),
base_of AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
labels_of AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM all_labels GROUP BY r),
score_of AS (SELECT r, max(confidence) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN base_of USING (r) LEFT JOIN labels_of USING (r) LEFT JOIN score_of USING (r)
"""


ORACLE = _oracle()
