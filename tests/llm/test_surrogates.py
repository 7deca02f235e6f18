"""Surrogates of whole small corpora: coreference, distinctness, type and format; time and odd input."""

import re
import time
from collections import defaultdict

import numpy as np

from worklens.llm import pii_surrogates as pii


def corpus(rng):
    names = ["Smith", "Baker", "Müller", "García", "Stone", "Rivers"]
    pick = lambda xs: str(rng.choice(xs))
    parts = [
        lambda: f"{pick(['ann', 'bob.k', 'c-d'])}{rng.integers(40)}@{pick(['one.org', 'two.com', 'x.io'])}",
        lambda: f"User.{rng.integers(50)}@Mail{rng.integers(3)}.example.org",
        lambda: f"10.{rng.integers(3)}.{rng.integers(256)}.{rng.integers(256)}",
        lambda: f"+1 ({rng.integers(200, 220):03d}) 555-{rng.integers(10000):04d}",
        lambda: f"4{rng.integers(10**14, 10**14 + 300)}0",
        lambda: f"{pick(['Mr', 'Mrs', 'Frau'])} {pick(names)}",
        lambda: f"{pick(['John', 'Mary'])} {pick(names)} met {pick(names).upper()}",
        lambda: "plain words here",
    ]
    return [(int(i), "; ".join(parts[int(rng.integers(len(parts)))]() for _ in range(int(rng.integers(1, 25))))) for i in range(120)]


FORMS = {"email": r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "ip": r"(\d{1,3}\.){3}\d{1,3}", "phone": r"\+?\d+", "number": r"\d+", "given": r"[mf]?:\w+", "surname": r"\w+"}


def test_coreference_distinctness_type_and_format(spark):
    rows = corpus(np.random.default_rng(5))
    frame = spark.createDataFrame([(d, t, "mine", "mine") for d, t in rows], "doc_id long, text string, later_draws string, digest_ string")
    for options in ({}, {"broadcast": -1}):
        made = {r["doc_id"]: r for r in pii.pseudonymised(frame.repartition(3), "key", **options).collect()}
        given = defaultdict(set)
        for doc, text in rows:
            spans, new, at = pii.entities(text), made[doc]["text"], 0
            assert made[doc]["n_entities"] == len(spans) and made[doc]["later_draws"] == "mine"
            pattern = ""
            for start, stop, _, _ in spans:
                pattern += re.escape(text[at:start]) + "(.+?)"
                at = stop
            match = re.fullmatch(pattern + re.escape(text[at:]), new, re.S)
            assert match, (text, new)
            for (start, stop, kind, form), seen in zip(spans, match.groups(), strict=True):
                old = text[start:stop]
                form_of = {"email": str.lower, "ip": str, "phone": lambda s: re.sub(r"[^\d+]", "", s), "number": lambda s: re.sub(r"\D", "", s)}.get(kind, str.lower)
                given[kind, form].add(form_of(seen))
                if kind == "ip":
                    assert all(0 <= int(p) <= 255 for p in seen.split("."))
                if kind in ("phone", "number") and len(seen) == len(old):
                    assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", seen)
                if kind in ("given", "surname"):
                    assert old.isupper() == seen.isupper() and old[0].isupper() == seen[0].isupper()
                if kind == "email":
                    assert re.fullmatch(FORMS["email"], seen.lower()) and seen.lower().rsplit(".", 1)[1] == old.lower().rsplit(".", 1)[1]
        assert all(len(v) == 1 for v in given.values())  # one surrogate each, in the whole corpus
        for kind in FORMS:
            surrogates = [next(iter(v)) for (k, _), v in given.items() if k == kind]
            assert len(set(surrogates)) == len(surrogates)
        domains = defaultdict(set)
        for (kind, form), v in given.items():
            if kind == "email":
                domains[form.partition("@")[2]].add(next(iter(v)).partition("@")[2])
        assert all(len(d) == 1 for d in domains.values())


def test_kinds_with_few_free_forms_end(spark):
    rows = [(i, f"{chr(97 + i)}@x.io") for i in range(26)] + [(100 + i, f"see 10.0.0.{i} here") for i in range(256)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"] for r in pii.pseudonymised(frame, "key").collect()]
    assert len(set(texts)) == len(rows)
    assert not {t for _, t in rows[:26]} & set(texts)


def test_addresses_are_permuted_under_their_prefix():
    made = {pii.surrogate(b"k", "ip", f"10.1.2.{i}") for i in range(256)}
    assert len(made) == 256 and len({m.rpartition(".")[0] for m in made}) == 1
    assert pii.surrogate(b"other", "ip", "10.1.2.3") != pii.surrogate(b"k", "ip", "10.1.2.3")


def test_a_megabyte_of_contacts_takes_seconds():
    text = "".join(f"Mr Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} <a{i}@x{i % 99}.org>, 10.0.{i // 250 % 250}.{i % 250}\n" for i in range(26_000))
    text = re.sub(r"Name(\w+)", lambda m: "N" + m.group(1), text)
    start = time.time()
    spans = pii.entities(text)
    assert len(text) > 900_000 and len(spans) == 78_000 and time.time() - start < 10


def test_null_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, None, 7), (1, "", 7), (1, "a@b.org", 7), (1, "a@b.org", 7)], "doc_id long, text string, n_entities long")
    rows = pii.pseudonymised(frame, "key").collect()
    assert sorted((r["text"] is None, r["n_entities"]) for r in rows) == [(False, 0), (False, 1), (False, 1), (True, 0)]
    assert len({r["text"] for r in rows if r["n_entities"]}) == 1
    assert pii.pseudonymised(frame.limit(0), "key").collect() == []
