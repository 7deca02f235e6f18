"""Byte helpers, components, bounded slices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from worklens.llm.batches import LOWER, Words, append, byte_table, slices
from worklens.llm.components import component_roots

SPACE = byte_table(lambda b: int(b > 32))


def test_words_do_not_cross_texts_and_hash_alike():
    words = Words([b"Ab cd", b"", b"  ab", "é é".encode()], SPACE, LOWER)
    assert words.counts().tolist() == [2, 0, 1, 2]
    whole, prefix = words.hashes(1)
    assert whole[0] == whole[2] and whole[0] != whole[1] and whole[3] == whole[4]
    assert prefix[0] == prefix[2]


def test_slices_hold_whole_rows_and_bounded_text():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "c", "d"]})
    parts = [texts for _, texts in slices(batch, "text", 20)]
    assert parts == [[b"a" * 10, b""], [b"b" * 30], [b"c", b"d"]]


def test_appended_column_replaces_one_of_its_name(spark):
    frame = spark.createDataFrame([("x", 1, "old"), (None, 2, "old")], "text string, a int, size string")
    out = append(frame, lambda texts: [pa.array([len(t) for t in texts], pa.int64())], [StructField("size", LongType())])
    assert sorted((r["a"], r["size"]) for r in out.collect()) == [(1, 1), (2, 0)]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 260)]
    label = {v: v for p in pairs for v in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    links = spark.createDataFrame(pairs, "a long, b long")
    roots = {r["node"]: r["root"] for r in component_roots(links).collect()}
    assert roots == {v: r for v, r in label.items() if v != r}
    assert component_roots(links.where(F.lit(False))).isEmpty()
