"""Order-aware changes against all common subsequences."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from worklens.functions import sequences


def longest(old, new):
    def inside(part):
        rest = iter(new)
        return all(x in rest for x in part)

    return max(n for n in range(len(old) + 1) for p in itertools.combinations(old, n) if inside(p))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = [([], []), ([], ["a"]), (["a"], []), (["a", "a"], ["a"]), (["a", "b"], ["b", "a"]), (["a", "a", "b"], ["b", "a", "a", "a"]), (["a", None], [None, "a"])]
    pairs += [([rng.choice("abcd") for _ in range(rng.randint(0, 7))], [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for _ in range(150)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["c"] for r in frame.select("i", sequences.changes(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, (old, new) in enumerate(pairs):
        told = got[i]
        assert len(told["kept"]) == longest(old, new)
        for side in (old, new):
            rest = iter(side)
            assert all(x in rest for x in told["kept"])
        assert Counter(old) == Counter(told["kept"] + told["moved"] + told["removed"])
        assert Counter(new) == Counter(told["kept"] + told["moved"] + told["added"])
        assert not set(told["removed"]) & set(told["added"])
