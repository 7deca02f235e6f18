"""The corpus pipeline on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from worklens.llm import simhash_vptree


def test_stages_and_result(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "stage")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "benchmark decontamination":
            assert simhash_vptree.one_of_each(docs).count() == docs.count()
    assert counts == sorted(counts, reverse=True) and 0.5 * counts[0] < counts[-1] < counts[0]
    assert docs.where("not round_trip or n_tokens <> size(ids)").isEmpty()
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_columns_with_names_of_the_operators_keep_their_values(spark):
    sf = "/root/testdata/sf0.001"
    names = ["score", "hits", "items", "n_words", "secrets", "clean_text", "node", "ids", "words_"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"not `{c}` <=> concat('{c}', doc_id)" for c in names)).isEmpty()
        assert out.count() > 50
