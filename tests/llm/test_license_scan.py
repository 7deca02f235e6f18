"""License scan against a scan written as loops."""

import re

import pytest
from pyspark.sql import functions as F

from worklens.llm import license_scan
from worklens.llm.license_rules import BASE, RULES, VERBS

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(license_scan.UPPER, license_scan.LOWER)

TEXTS = [
    "Licensed under the Apache License, Version 2.0. (see LICENSE)",
    "Released under the MIT License. Released under the MIT-License, twice.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. CC\nBY\tNC and cc by nc sa 4.0; ccbync is none",
    "SPDX-License-Identifier: GPL-2.0-only\nSPDX-License-Identifier: BSD-3-Clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Éa license: MIT ÀMIT license undér the mit license",
    "licensed under the terms of the Mozilla Public License 2.0 or the license is Apache 2.0 license",
    "nothing of the kind, the license of poets", "", None, "   \n", "under the mit", "the mit license under", "x" * 5000,
    "\u212aelvin, distributed with \u212a under the MIT, shared as is under mpl 2.0, GPLv3 \u0130SC license", "creative commons zero; this is free and unencumbered software released into",
    "all rights reserved. Unauthorized copying of it is released into the public domain",
]


def scan(text):
    words = WORDS.findall((text or "").translate(LOWER))
    found = []
    for at, word in enumerate(words):
        window = " ".join(words[at : at + license_scan.WINDOW]) + " "
        for no, rule in enumerate(RULES):
            if word in rule.triggers and any(k in " " + window for k in rule.keywords):
                match = re.match(f"(?:{rule.pattern}) ", window)
                if match:
                    found.append((at, -(at + match.group(0).count(" ")), rule.priority, no))
    kept = []
    for start, stop, priority, no in sorted(found):
        if not kept or start >= -kept[-1][1]:
            kept.append((start, stop, priority, no))
        elif -stop > -kept[-1][1] and priority < kept[-1][2]:
            kept[-1] = (start, stop, priority, no)
    places = [(at, label) for phrase, label in BASE.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
    starts = [at for at, _ in places]
    base = {label for _, label in places}
    labels = base | {RULES[no].label for *_, no in kept}
    score = max((RULES[no].confidence for *_, no in kept), default=0.0)
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_equals_loops(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, " ; ".join(t for t in TEXTS if t) * 60])] + [(None, TEXTS[0], "x", "y"), (0, TEXTS[0], "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string, words string")
    got = sorted((tuple(r) for r in license_scan.digest(frame).collect()), key=str)
    assert got == sorted(((d, *scan(t)) for d, t, *_ in rows), key=str)
    assert license_scan.digest(frame.limit(0)).collect() == []


def test_detections_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, TEXTS[1], "mine", "mine", "mine")], "doc_id long, text string, detections string, c0 string, found string")
    row = license_scan.licenses(frame).first()
    assert (row["c0"], row["found"]) == ("mine", "mine")
    assert [(d["start"], d["stop"], d["label"]) for d in row["detections"]] == [(0, 5, "mit"), (5, 10, "mit")]
    assert [(b["start"], b["stop"], b["label"]) for b in row["base"]] == [(1, 5, "mit"), (6, 10, "mit")]


def test_every_rule_needs_a_gate_word_and_many_places_stay_fast(spark):
    assert len(RULES) > 250 and all(re.match(license_scan.gate(), g.replace(f"(?:{'|'.join(VERBS)})(?: [a-z]+){{0,2}}", "released")) for r in RULES for g in r.gates)
    long = "Released under the MIT License. Nothing else. " * 20_000
    frame = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert tuple(license_scan.digest(frame).first()) == (1, 140_000, 20_000, 1, 139_994, "mit", "mit", 0.9)


def test_plan_has_no_python_and_no_shuffle(spark):
    frame = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("the mit license").alias("text"))
    plan = license_scan.digest(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_given_table(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    want = {r["doc_id"]: scan(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in license_scan.digest(docs).collect()} == want
