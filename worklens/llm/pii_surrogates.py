"""Personal data replaced by keyed surrogates of the same type and format.

Entities: e-mail addresses, IPv4 addresses, phone numbers, account and card numbers, and
names after a title or a known given name (``rules`` below). The surrogate of an entity
follows from an HMAC of its normal form under the caller's key: digits become digits,
letters become letters of the same case, separators stay; an address keeps a top-level
domain and equal domains stay equal; the octets of an IPv4 address are permuted under their
prefix; names are built from syllables of their script with an ending of their gender,
each part on its own, so that a surname alone gets what it got in a full name.

Equal entities get equal surrogates in the whole corpus. Distinctness is checked in Spark:
entities are collected per kind, distinct; where two share a surrogate, or a surrogate is
itself an entity of the corpus, all but one take the next draw, until no clash is left. A kind
with few free forms gets longer ones after every few draws, so the draws end; addresses of
four octets can't grow, but their first draw is a permutation, which all of them keep if draws
do not settle. Only the local part of an e-mail address is drawn anew, its domain stays. Most
entities keep their first draw, so only the later draws are sent to the tasks: as a
broadcast table up to ``BROADCAST`` entries, beyond that joined per text.

A mention of a surname that a text has introduced with a name is replaced as well. Names are
found by a title or by one of the given names listed below, and by their capital letter; a name
without either is not found. Null text stays null with no entities, rows, repeated ids
included, are kept as they are but for ``text``; a column named ``n_entities`` gives way.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from worklens.llm.batches import slices
from worklens.llm.staging import staged

#: Entries with a later draw that are broadcast.
BROADCAST = 100_000
#: Rounds of drawing anew before a surrogate may be an entity of the corpus, as where a kind has
#: no free forms, and only distinctness counts; rounds before addresses go back to their first draw.
ROUNDS, SETTLE = 15, 30
KINDS = ("email", "ip", "phone", "number", "given", "surname")

# Fixed rules.
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)")
# Three groups with or without country code; any grouping after a plus sign; a trunk zero and groups with one separator.
PHONE = re.compile(
    r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4})"
    r"|\+\d(?:[ .()/-]{0,2}\d){6,14}|0\d{1,4}([ /-])(?:\d{5,8}|\d{3,4}\1\d{2,5}|\d{2,4}(?:\1\d{2,4}){2,3}))(?!\d)"
)
NUMBER = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Господин": "m", "Госпожа": "f",
}
GIVEN = {
    "James": "m", "John": "m", "Robert": "m", "Michael": "m", "William": "m", "David": "m", "Thomas": "m", "Peter": "m",
    "Hans": "m", "Klaus": "m", "Jürgen": "m", "Pierre": "m", "Jean": "m", "Carlos": "m", "José": "m", "Иван": "m",
    "Mary": "f", "Patricia": "f", "Jennifer": "f", "Linda": "f", "Elizabeth": "f", "Susan": "f", "Sarah": "f", "Anna": "f",
    "Ursula": "f", "Sabine": "f", "Marie": "f", "Sophie": "f", "María": "f", "Carmen": "f", "Ольга": "f", "Анна": "f",
}
WORD = re.compile(r"\w+")
_CAP = r"[A-ZÀ-ÖØ-ÞА-Я][a-zà-öø-ÿа-я]+"
NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(TITLES)})\.? (?P<first>{_CAP})(?: (?P<second>{_CAP}))?|(?P<given>{'|'.join(GIVEN)}) (?P<last>{_CAP}))\b"
)
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi na ne no pa pe ra re ro sa se so ta te to va ve".split(), "cyrillic": "ба ве го да же за ка ле ми но па ре са ту фе ша".split()}
ENDINGS = {("latin", "m"): ("n", "rd", "s", "ck"), ("latin", "f"): ("a", "ia", "ina", "elle"), ("latin", ""): ("rt", "nd", "lin", "mer", "sen"),
           ("cyrillic", "m"): ("н", "р", "й"), ("cyrillic", "f"): ("а", "ия", "на"), ("cyrillic", ""): ("ов", "ин", "ко")}


def _script(word: str) -> str:
    return "cyrillic" if any("А" <= c <= "я" for c in word) else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Start, stop, kind and normal form of every entity; the first kind wins where two overlap."""
    found: list[tuple[int, int, str, str]] = []  # by place, none overlaps another

    def add(start: int, stop: int, kind: str, form: str) -> None:
        at = bisect.bisect_left(found, (start,))
        if (at == 0 or found[at - 1][1] <= start) and (at == len(found) or stop <= found[at][0]):
            found.insert(at, (start, stop, kind, form))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m.group().lower())
    if sum(map(text.count, "0123456789")) >= 4:
        for m in IP.finditer(text):
            if all(int(p) <= 255 for p in m.group().split(".")):
                add(m.start(), m.end(), "ip", ".".join(str(int(p)) for p in m.group().split(".")))
        for m in NUMBER.finditer(text):
            add(m.start(), m.end(), "number", re.sub(r"\D", "", m.group()))
        for m in PHONE.finditer(text):
            add(m.start(), m.end(), "phone", re.sub(r"[^\d+]", "", m.group()))
    surnames: dict[str, None] = {}
    for m in NAME.finditer(text):
        first, last, gender = ("first", "second", TITLES.get(m["title"] or "", "")) if m["title"] else ("given", "last", GIVEN.get(m["given"] or "", ""))
        if not m[last]:
            first, last = "", first
        if first:
            add(*m.span(first), "given", f"{gender}:{m[first].lower()}")
        add(*m.span(last), "surname", m[last].lower())
        surnames[m[last]] = None
    if surnames:
        mentions = {seen: name.lower() for name in surnames for seen in (name, name.upper())}
        for m in WORD.finditer(text):
            if m.group() in mentions:
                add(m.start(), m.end(), "surname", mentions[m.group()])
    return found


@functools.lru_cache(maxsize=1 << 16)
def surrogate(key: bytes, kind: str, form: str, draw: int = 0) -> str:
    """The replacement of a normal form, itself in normal form."""

    def stream(label: str, size: int, draw: int = draw) -> list[int]:
        out, block = [], 0
        while len(out) < size:
            out += hmac.new(key, f"{label}|{draw}|{block}".encode(), hashlib.sha256).digest()
            block += 1
        return out[:size]

    def letters(text: str, label: str, draw: int = draw) -> str:
        drawn = iter(stream(label, 2 * len(text), draw))
        out = []
        for c in text:
            value = next(drawn) * 256 + next(drawn)
            out.append(str(value % 10) if c.isdigit() else chr(97 + value % 26) if "a" <= c <= "z" else c)
        return "".join(out)

    # After many draws the format gives way: too few forms of that length are free.
    longer = "x" * (draw // 8)
    if kind == "email":
        local, _, domain = form.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{letters(local, 'local|' + form)}{letters(longer, 'more|' + form)}@{letters(name, 'domain|' + domain, 0)}.{top}"
    if kind == "ip":
        out, prefix = [], ""
        for octet in form.split("."):
            # A permutation of 256 values: six keyed rounds over two halves of four bits.
            left, right = divmod(int(octet), 16)
            for half in range(6):
                left, right = right, left ^ stream(f"ip|{prefix}|{half}|{right}", 1)[0] % 16
            out.append(str(16 * left + right))
            prefix += octet + "."
        return ".".join(out)
    if kind in ("phone", "number"):
        code = re.match(r"\+\d", form)
        head = code.group() if code else ""
        return head + letters(form[len(head) :], f"{kind}|{form}") + letters("0" * len(longer), f"more|{form}")
    gender, _, word = form.rpartition(":")
    script, drawn = _script(word), stream(f"{kind}|{form}", 8)
    pieces, ends = SYLLABLES[script], ENDINGS[script, gender]
    name = "".join(pieces[d % len(pieces)] for d in drawn[: 2 + drawn[6] % 2] + stream(f"more|{form}", len(longer))) + ends[drawn[7] % len(ends)]
    return f"{gender}:{name}" if kind == "given" else name


def dressed(form: str, seen: str, kind: str) -> str:
    """A surrogate in the format of the mention it replaces."""
    if kind in ("given", "surname"):
        word = form.rpartition(":")[2]
        return word.upper() if seen.isupper() else word.capitalize() if seen[:1].isupper() else word
    if kind in ("phone", "number"):
        digits = iter(c for c in form if c.isdigit())
        return "".join(next(digits, "0") if c.isdigit() else c for c in seen) + "".join(digits)
    if kind == "email" and len(form) == len(seen):
        return "".join(f.upper() if s.isupper() else f for f, s in zip(form, seen, strict=True))
    return form


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, draw) with the surrogate of that draw."""

    # Small rows, costly to make: adaptive execution would put them all into one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            made = [surrogate(key, *row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["kind", "form", "draw", "made"])

    return rows.select("kind", "form", "draw").repartition(tasks, "kind", "form").mapInArrow(run, "kind string, form string, draw long, made string")


def found_entities(documents: DataFrame) -> DataFrame:
    """The distinct (kind, form) of the corpus; each slice of texts passes a form on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                seen = list({(k, f) for raw in texts for _, _, k, f in entities(raw.decode("utf-8", "replace"))})
                yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in seen], pa.string()) for i in (0, 1)], ["kind", "form"])

    return documents.select("text").mapInArrow(run, "kind string, form string").distinct()


def later_draws(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, draw) of the entities that may not keep their first draw."""
    table = staged(_drawn(found.withColumn("draw", F.lit(0).cast("long")), key), "draws")
    step = 0
    while True:
        owner = table.groupBy("kind", "made").agg(F.min("form").alias("owner"))
        judged = table.join(owner, ["kind", "made"])
        clash = F.col("form") != F.col("owner")
        if step < ROUNDS:
            judged = judged.join(table.select("kind", F.col("form").alias("made"), F.lit(True).alias("real")), ["kind", "made"], "left")
            clash = clash | F.col("real").isNotNull()
        judged = judged.where(clash)
        if step >= SETTLE:
            judged = judged.where("kind <> 'ip'")
        again = staged(_drawn(judged.select("kind", "form", (F.col("draw") + 1).alias("draw")), key), "again")
        if again.isEmpty():
            break
        # Only the rows of a clash are drawn and checked anew; the others stay as they are.
        table = staged(table.join(again.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again), "draws")
        step += 1
    settled = table if step < SETTLE else table.where("kind <> 'ip'")
    return settled.where("draw > 0").select("kind", "form", "draw")


DRAWS = ArrayType(StructType([StructField("kind", StringType()), StructField("form", StringType()), StructField("draw", LongType())]))


def pseudonymised(documents: DataFrame, key: str, broadcast: int = BROADCAST) -> DataFrame:
    """The documents with surrogates in ``text``, and ``n_entities``, the number of replaced mentions."""
    spark, secret = documents.sparkSession, key.encode()
    later = staged(later_draws(found_entities(documents), secret), "later-draws")
    # Columns of any name: they have a number inside, but for the text.
    names = [c for c in documents.columns if c != "n_entities"]
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(names)]
    frame, own = documents.select(*[documents[f"`{c}`"].alias(i) for c, i in zip(names, inner, strict=True)]), None
    kept = list(frame.schema.fields)
    if later.count() <= broadcast:
        table = spark.sparkContext.broadcast({(r["kind"], r["form"]): r["draw"] for r in later.collect()})
    else:
        frame, own = _with_draws(frame, later), "later_draws"
        table = spark.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                lists = part.column(own).to_pylist() if own else [None] * len(texts)
                made, counts, missing = [], [], part.column("text").is_null().to_pylist()
                for raw, draws, null in zip(texts, lists, missing, strict=True):
                    known = {(d["kind"], d["form"]): d["draw"] for d in draws or []} if own else table.value
                    text = raw.decode("utf-8", "replace")
                    pieces, at, spans = [], 0, entities(text)
                    for start, stop, kind, form in spans:
                        new = surrogate(secret, kind, form, known.get((kind, form), 0))
                        pieces += [text[at:start], dressed(new, text[start:stop], kind)]
                        at = stop
                    made.append(None if null else "".join(pieces) + text[at:])
                    counts.append(len(spans))
                columns = [pa.array(made, pa.string()) if n == "text" else part.column(n) for n in inner]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*inner, "n_entities"])

    return frame.mapInArrow(run, StructType([*kept, StructField("n_entities", LongType())])).toDF(*names, "n_entities")


def _with_draws(documents: DataFrame, later: DataFrame) -> DataFrame:
    """Each document with the later draws of its own entities, by the hash of its text."""
    slim = documents.select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                rows = list({(hashlib.sha256(raw).hexdigest(), k, f) for raw in texts for _, _, k, f in entities(raw.decode("utf-8", "replace"))})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["digest", "kind", "form"])

    mentions = slim.mapInArrow(run, "digest string, kind string, form string").join(later, ["kind", "form"])
    lists = mentions.groupBy("digest").agg(F.collect_list(F.struct("kind", "form", "draw")).cast(DRAWS).alias("later_draws"))
    digest_ = F.sha2(F.col("text").cast("binary"), 256)
    return documents.withColumn("digest_", digest_).join(lists.withColumnRenamed("digest", "digest_"), "digest_", "left").drop("digest_")


def digest(documents: DataFrame, key: str = "corpus-key") -> DataFrame:
    """The registered query: every text with its surrogates."""
    return pseudonymised(documents.select("doc_id", "text"), key)
