"""Lexical search against all scores; bounds that prune."""

import math
import re
from collections import Counter

import numpy as np

from worklens.llm import lexical_lemp as lemp

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items, top=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in counted)
    number = sum(1 for _, c in counted if c)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for doc, terms in counted:
            m = 100 - 75 + (75 * sum(terms.values()) * number) // max(1, total)
            score = sum(n * math.floor(1000 * math.log((2 * number + 2) / (2 * holding[t] + 1))) * ((10**9 * terms[t]) // (1000 * terms[t] + 8 * m)) for t, n in query.items() if terms[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(rng, number):
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 5)))) for _ in range(300)]
    pick = lambda n: " ".join(rng.choice(words, n, p=np.array(w) / sum(w)))
    w = [1 / (i + 1) for i in range(len(words))]
    docs = [(int(i), pick(int(rng.integers(1, 80)))) for i in rng.permutation(number)]
    return docs, [(100 + i, pick(int(rng.integers(1, 30)))) for i in range(25)]


def test_equals_all_scores(spark):
    rng = np.random.default_rng(3)
    docs, items = corpus(rng, 700)
    docs += [(None, docs[0][1]), (None, None), (5000, ""), (5001, " .,"), (5002, docs[1][1]), (5002, docs[1][1])] + [(6000 + i, docs[2][1].upper()) for i in range(30)]
    items += [(100, items[0][1]), (7, None), (8, "..."), (9, "zzzznever"), (None, docs[2][1] + " " + docs[2][1])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, rank string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(docs, items)
    for options in ({}, {"block_bytes": 400}):
        assert sorted((tuple(r) for r in lemp.ranked(frame.repartition(3), bench, **options).collect()), key=str) == want
    assert lemp.ranked(frame.limit(0), bench).collect() == [] and lemp.ranked(frame, bench.limit(0)).collect() == []


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    docs, items = corpus(rng, 6000)
    texts = [t.encode() for _, t in docs]
    counted = [Counter(lemp.terms(t.encode())) for _, t in items]
    vocabulary = lemp.Vocabulary(set().union(*counted))
    number, _, term, _ = lemp.term_counts(texts, vocabulary)
    search = lemp.Search(counted, vocabulary, len(texts), int(number.sum()), np.bincount(term, minlength=len(vocabulary)))
    best = lemp.Best(search, 10)
    ids = np.array([d for d, _ in docs])
    best.add(*search.impacts(texts), ids, np.zeros(len(ids), bool))
    got = [(item, r + 1, int(d), int(s)) for i, (item, _) in enumerate(items) for r, (d, s) in enumerate(zip(best.ids[i], best.scores[i], strict=True))]
    assert sorted(got, key=str) == expected(docs, items)
    assert best.scored < 0.6 * len(texts) * len(items) and best.looked_at < len(texts) * len(items)


def test_long_text_in_pieces_and_equal_hashes(monkeypatch):
    vocabulary = lemp.Vocabulary({b"ab", b"cd", b"x" * 50})
    text = b"ab " * 1000 + b"x" * 50 + b" cd"
    whole = lemp.term_counts([b"cd", text, b"", text], vocabulary)
    monkeypatch.setattr(lemp, "PIECE", 100)
    for a, b in zip(whole, lemp.term_counts([b"cd", text, b"", text], vocabulary), strict=True):
        assert a.tolist() == b.tolist()
    assert whole[0].tolist() == [1, 1002, 0, 1002] and whole[3].tolist() == [1, 1000, 1, 1, 1000, 1, 1]
    # Words of one hash are told apart by their bytes.
    monkeypatch.setattr(lemp.Words, "hashes", lambda self, *p: [np.zeros(len(self.starts), np.uint64)])
    clash = lemp.Vocabulary({b"ab", b"cd", b"ef"})
    assert clash.longest_run == 3
    assert lemp.term_counts([b"ef ab zz ab"], clash)[2:][0].tolist() == [0, 2]
